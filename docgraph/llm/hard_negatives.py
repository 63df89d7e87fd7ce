"""Hard-negative mining: rotated one-bit codes filter what is scored exactly.

A rotated row's signs are its code. The row is a part along its code's vector w (the signs rotated back) and a rest at right angles to
it; the alignment a = <v, w>/|w| is stored, and the rest is coded in the same way, ``STAGES`` times, each with its alignment. For a
query q, each <q, w> comes of popcounts of the code under the bit planes of the rotated, rounded query; what rounding lost bounds its error.
The sum of a <q, w>/|w| over the stages estimates <q, v>, and by Cauchy-Schwarz what the last rest r adds lies within
sqrt(|q|^2 - (<q, w>/|w|)^2) * |r| for the last w. Rows whose interval cannot reach what is asked are left out, without loss; the others are scored in integers.

Rows and queries are dealt into parts and chunks; each pair of those is a group of bounded size, and only its best rows are shuffled on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows (anchors) of a group, and of the blocks that are compared at once in it.
PART, CHUNK, ROWS, QUERIES = 65_536, 16_384, 8_192, 128
#: One-bit codes of a row, each of the rest that the one before leaves; bits of a rounded query.
STAGES, PLANES = 6, 8
#: Positives of an anchor, negatives of a positive, and the window of negatives in hundredths of the positive's score.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Stands for a null id, behind all others.
_NO_ID = 2**63 - 1

_CODED = "vec_id long, label long, vector binary, code binary, align binary, width binary, rest double"


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, vectors as integers: see ``hard_negatives``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), F.transform("embedding", lambda x: F.floor(x * 256)).alias("vector"))
    if embeddings.where("vec_id is not null").groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    one = F.min(F.struct("label", "vector")).alias("one")
    known = rows.where("vec_id is not null").groupBy("vec_id").agg(one).select("vec_id", "one.label", "one.vector")
    return known.unionByName(rows.where("vec_id is null"))


def rotation(dim: int, seed: int = 13) -> np.ndarray:
    """A matrix with orthonormal columns from ``dim`` dimensions to the next multiple of 64."""
    return np.ascontiguousarray(np.linalg.qr(np.random.default_rng(seed).standard_normal((64 * -(-dim // 64), dim)))[0])


def _padded(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def encode_rows(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes as 64-bit words, alignments, lengths of the codes' vectors, length of the last rest) of each row, stage by stage."""
    rest = vectors.astype(float)
    codes, aligns, widths = [], [], []
    for _ in range(STAGES):
        signs = rest @ turn.T >= 0
        back = np.where(signs, 1.0, -1.0) @ turn
        width = np.sqrt((back * back).sum(axis=1))
        width[width == 0] = 1.0
        align = (rest * back).sum(axis=1) / width
        rest = rest - (align / width)[:, None] * back
        codes.append(np.packbits(signs, axis=1, bitorder="little").view(np.uint64))
        aligns.append(align)
        widths.append(width)
    return np.hstack(codes), np.column_stack(aligns), np.column_stack(widths), np.sqrt((rest * rest).sum(axis=1))


class Queries:
    """Rotated and rounded queries as bit planes."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        turned = vectors.astype(float) @ turn.T
        top = 2 ** (PLANES - 1) - 1
        self.step = np.maximum(np.abs(turned).max(axis=1), 1e-300) / top
        whole = np.rint(turned / self.step[:, None])
        self.lost = np.abs(turned - whole * self.step[:, None]).sum(axis=1)
        self.sum = whole.sum(axis=1)
        shifted = (whole + 2 ** (PLANES - 1)).astype(np.uint8)
        self.planes = [np.packbits(shifted >> k & 1, axis=1, bitorder="little").view(np.uint64) for k in range(PLANES)]
        self.square = (vectors.astype(float) ** 2).sum(axis=1)

    def bounds(self, code: np.ndarray, align: np.ndarray, width: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest inner product that each query may have with each row."""
        words = code.shape[1] // STAGES
        middle, reach = np.zeros((len(self.sum), len(code))), np.zeros((len(self.sum), len(code)))
        for stage in range(STAGES):
            own = np.ascontiguousarray(code[:, stage * words : (stage + 1) * words].T)
            count = np.zeros(middle.shape, np.int32)
            for k, plane in enumerate(self.planes):
                for word in range(words):
                    count += np.bitwise_count(plane[:, word, None] & own[word]).astype(np.int32) << k
            count -= np.bitwise_count(own).sum(axis=0, dtype=np.int32) << (PLANES - 1)
            along = self.step[:, None] * (2.0 * count - self.sum[:, None]) / width[:, stage]
            off = self.lost[:, None] / width[:, stage]
            middle += align[:, stage] * along
            reach += np.abs(align[:, stage]) * off
        short = np.maximum(0.0, np.abs(along) - off)
        reach += np.sqrt(np.maximum(0.0, self.square[:, None] - short * short)) * rest
        reach += 1e-6 + 1e-9 * np.sqrt(self.square[:, None]) * (np.abs(align).sum(axis=1) + rest)  # of floating point
        return middle - reach, middle + reach


def _encoder(dim: int, turn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _padded(batch.column("vector"), dim)
            *stages, rest = encode_rows(vectors, turn)
            blobs = [pa.array([row.tobytes() for row in rows], pa.binary()) for rows in (vectors.astype("<i4"), *stages)]
            columns = [batch.column("vec_id"), batch.column("label"), *blobs, pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "vector", "code", "align", "width", "rest"])

    return run


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy()


def _nth_largest(values: np.ndarray, n: int) -> np.ndarray:
    """The nth largest of each row, minus infinity if there are fewer."""
    if values.shape[1] < n:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - n, axis=1)[:, values.shape[1] - n]


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """The places of the ``most`` first rows of each group by score (highest first), then id."""
    order = np.lexsort((ids, -score, group))
    start = np.flatnonzero(np.diff(group[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
    return order[place < most]


class _Rows:
    """The rows of a group, by label."""

    def __init__(self, table: pa.Table):
        self.ids, self.labels = _ids(table["vec_id"]), table["label"].to_numpy()
        self.vectors = _matrix(table["vector"], "<i4").astype(np.int64)
        self.code = _matrix(table["code"], "<u8")
        self.lengths = [_matrix(table["align"], "<f8"), _matrix(table["width"], "<f8"), table["rest"].to_numpy()]

    def bounds(self, queries: Queries, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return queries.bounds(self.code[places], *[x[places] for x in self.lengths])

    def scores(self, vectors: np.ndarray, asked: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The integer inner products of ``vectors[asked]`` with the rows at ``places``."""
        out = np.empty(len(asked), np.int64)
        for k in range(0, len(asked), 1 << 16):
            out[k : k + (1 << 16)] = np.einsum("ij,ij->i", vectors[asked[k : k + (1 << 16)]], self.vectors[places[k : k + (1 << 16)]])
        return out


def _table(columns: dict[str, list[np.ndarray]]) -> pa.Table:
    whole = {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in columns.items()}
    return pa.table({n: pa.array(x, pa.int64(), mask=x == _NO_ID if n.endswith("_id") else None) for n, x in whole.items()})


def _positives(turn: np.ndarray):
    """Of each anchor of the group the first rows of its label, other than itself."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {"anchor_id": [], "positive_id": [], "score": []}
        if not len(rows) or not len(anchors):
            return _table(out)
        held, ids, labels = _Rows(rows), _ids(anchors["vec_id"]), anchors["label"].to_numpy()
        vectors = _matrix(anchors["vector"], "<i4").astype(np.int64)
        for label in np.unique(labels):
            own, of_label = np.flatnonzero(held.labels == label), np.flatnonzero(labels == label)
            for a in range(0, len(of_label), QUERIES):
                some = of_label[a : a + QUERIES]
                queries, found = Queries(vectors[some], turn), []
                for r in range(0, len(own), ROWS):
                    places = own[r : r + ROWS]
                    low, high = held.bounds(queries, places)
                    itself = ids[some][:, None] == held.ids[places]
                    low[itself] = high[itself] = -np.inf
                    asked, near = np.nonzero((high >= _nth_largest(low, POSITIVES)[:, None]) & ~itself)
                    found.append((asked, places[near], held.scores(vectors[some], asked, places[near])))
                if found:
                    asked, places, score = map(np.concatenate, zip(*found))
                    first = _first(asked, score, held.ids[places], POSITIVES)
                    for name, x in zip(out, (ids[some][asked[first]], held.ids[places[first]], score[first])):
                        out[name].append(x)
        return _table(out)

    return run


def _negatives(turn: np.ndarray):
    """Of each anchor of the group and each of its positives the first rows of other labels in the window of scores."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {"anchor_id": [], "positive_id": [], "positive_score": [], "negative_id": [], "score": []}
        if not len(rows) or not len(anchors):
            return _table(out)
        held, ids, labels = _Rows(rows), _ids(anchors["vec_id"]), anchors["label"].to_numpy()
        vectors = _matrix(anchors["vector"], "<i4").astype(np.int64)
        positives = anchors["positives"].combine_chunks()
        size = positives.value_lengths().to_numpy()
        filled = np.arange(POSITIVES) < size[:, None]
        score, of = np.zeros(filled.shape, np.int64), np.zeros(filled.shape, np.int64)
        score[filled], of[filled] = positives.flatten().field("score").to_numpy(), _ids(positives.flatten().field("positive_id"))
        least, most = -(-LEAST * score // 100), MOST * score // 100
        least[~filled], most[~filled] = 1, 0  # windows that hold nothing
        for a in range(0, len(ids), QUERIES):
            some = slice(a, a + QUERIES)
            queries, found = Queries(vectors[some], turn), []
            for r in range(0, len(held.ids), ROWS):
                places = np.arange(r, min(r + ROWS, len(held.ids)))
                low, high = held.bounds(queries, places)
                other = labels[some][:, None] != held.labels[places]
                wanted = np.zeros(other.shape, bool)
                for k in range(POSITIVES):
                    bottom, top = least[some, k, None], most[some, k, None]
                    sure = other & (low >= bottom) & (high <= top)
                    enough = np.maximum(bottom, _nth_largest(np.where(sure, low, -np.inf), NEGATIVES)[:, None])
                    wanted |= (high >= enough) & (low <= top) & (bottom <= top)
                asked, near = np.nonzero(wanted & other)
                found.append((asked, places[near], held.scores(vectors[some], asked, places[near])))
            asked, places, scored = map(np.concatenate, zip(*found))
            for k in range(POSITIVES):
                inside = np.flatnonzero((scored >= least[some, k][asked]) & (scored <= most[some, k][asked]))
                first = inside[_first(asked[inside], scored[inside], held.ids[places[inside]], NEGATIVES)]
                who = a + asked[first]
                for name, x in zip(out, (ids[who], of[who, k], score[who, k], held.ids[places[first]], scored[first])):
                    out[name].append(x)
        return _table(out)

    return run


def _best(found: DataFrame, keys: list[str], other: str, most: int) -> DataFrame:
    """The ``most`` first rows of ``found`` for each key, with ``rank``."""
    order = [F.desc("score"), F.asc_nulls_last(other)]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def hard_negatives(embeddings: DataFrame, anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of (vec_id, embedding, label, ...) that ``anchor`` names.

    Rows with a null label or vector, or with a null or non-finite component, take no part. The label of a row whose vec_id is divisible by 7 becomes
    (label + 1) % 10, and each component floor(256 x). A score is an integer inner product, a shorter vector counting as filled with zeros; highest first, ties by smaller
    vec_id. An anchor's positives are its first five other rows of its label; of each the first ten rows of other labels are returned
    whose score is from 0.3 to 0.9 of the positive's. Rows that repeat a vec_id are as one, the least by label, then vector; a row
    without vec_id is no anchor, and comes after all others with its score. Scores that may leave 64 bits (components of about 10^6 and more) raise an error.
    Other columns are ignored; without rows or anchors the result is empty.
    """
    rows = quantised(embeddings)
    size = F.max(F.aggregate("vector", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x)))).alias("largest")
    n, dim, largest, n_anchors = rows.agg(F.count("*"), F.max(F.size("vector")), size, F.count_if(anchor)).first()
    dim, largest = max(1, dim or 1), largest or 0
    if dim * largest * largest >= 2**63 // 100 or largest >= 2**31:
        raise ValueError("the components are too large for scores of 64 bits")
    turn = rotation(dim)
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    parts, chunks = max(-(-n // PART), min(2 * tasks, -(-n // 1024)), 1), max(1, -(-n_anchors // CHUNK))
    deal = lambda count, *by: F.pmod(F.xxhash64(*by), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    coded = cut(rows.mapInArrow(_encoder(dim, turn), _CODED))
    anchors = coded.where(anchor).select("vec_id", "label", "vector", deal(chunks, "vec_id").alias("chunk"))
    whole = coded.withColumn("part", deal(parts, "vec_id", "code")).withColumn("chunk", every(chunks)).groupBy("part", "chunk")
    copies = lambda df: df.withColumn("part", every(parts)).groupBy("part", "chunk")

    found = whole.cogroup(copies(anchors)).applyInArrow(_positives(turn), "anchor_id long, positive_id long, score long")
    positives = _best(found, ["anchor_id"], "positive_id", POSITIVES)
    positives = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))
    asked = cut(anchors.join(positives, "vec_id"))
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, score long"
    found = whole.cogroup(copies(asked)).applyInArrow(_negatives(turn), schema)
    # A positive without id is told from others by its score; two of the same score have the same negatives.
    found = _best(found.distinct(), ["anchor_id", "positive_id", "positive_score"], "negative_id", NEGATIVES)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
