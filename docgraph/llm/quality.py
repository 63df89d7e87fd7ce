"""Quality classifier: naive Bayes support vectors, trained by dual coordinate descent.

Features are indicators of word and word-shape unigrams and bigrams, hashed to ``DIMS`` places. Class
counts of all training rows are summed in Spark and give each feature its log-count ratio; documents are
then the ratios of their features, scaled to unit length. A linear hinge-loss model is fitted on a
bounded sample of the training rows, and its margin calibrated to a probability on rows of the sample kept
out of that fit. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small
from .shingles import _SPACE, mix64, slices, text_bytes, word_hashes

DIMS, FOLDS, THRESHOLD = 1 << 17, 5, 0.3
#: Documents that the linear model is fitted on, at most; counts and ratios use all labelled rows.
MOST_FITTED = 8_000
#: Labels that may be broadcast; beyond that the texts are shuffled to them.
_BROADCAST_ROWS = 2_000_000

#: Letters of a case, other letters and digits are one byte class each; other bytes stand for themselves.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97
_STEP = mix64(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(256, 256)


def _shape_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each word's changes of byte class: Word and Text share one, WORD!! and word** do not."""
    space = _SPACE[data]
    kind = _CLASS[data].astype(np.intp)
    before = np.zeros(len(data), np.intp)
    before[1:] = np.where(space[:-1], 0, kind[:-1])
    before[bounds[:-1][bounds[:-1] < len(data)]] = 0
    value = np.where(space | (before == kind), np.uint64(0), _STEP[before, kind])
    starts = np.flatnonzero((before == 0) & ~space)
    return mix64(np.add.reduceat(value, starts)) if len(starts) else np.zeros(0, np.uint64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct features of each text, one text after the other, and n + 1 offsets."""
    data, bounds = text_bytes(column)
    words, at = word_hashes(data, bounds)
    shapes = _shape_hashes(data, bounds)
    factor = np.uint64(0x9E3779B97F4A7C15)
    grams = []
    for k, own in enumerate((words, shapes)):
        pair = mix64(own[:-1] * factor + own[1:]) if len(own) > 1 else own[:0]
        if not k:  # a word said twice in a row is one feature, whichever word it is
            pair = np.where(own[:-1] == own[1:], factor, pair)
        # Shapes say more here than words; each kind has its own part of the table.
        part = np.uint64(DIMS // 4)
        grams.append((own % part + np.uint64(2 * k) * part).astype(np.int32))
        grams.append((pair % part + np.uint64(2 * k + 1) * part).astype(np.int32))
    parts, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for i in range(len(sizes)):
        lo, hi = at[i], at[i + 1]
        if lo < hi:
            own = np.concatenate([g[lo : hi - k % 2] for k, g in enumerate(grams)])
            own.sort()
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            parts.append(own)
            sizes[i] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.concatenate(([0], np.cumsum(sizes)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts of either label each feature is; place -1 counts the texts."""
    counts, texts = np.zeros((2, DIMS), np.int64), np.zeros(2, np.int64)
    for whole in batches:
        for batch in slices(whole, "text"):
            own, at = features(batch.column("text"))
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            each = np.repeat(label, np.diff(at))
            for y in (0, 1):
                counts[y] += np.bincount(own[each == y], minlength=DIMS)
                texts[y] += int((label == y).sum())
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(([-1], some))), *[pa.array(np.concatenate((texts[y : y + 1], counts[y][some]))) for y in (0, 1)]],
        names=["place", "zeros", "ones"],
    )


def packed(own: np.ndarray) -> bytes:
    """The sorted features of one text in some two bytes each: their gaps, compressed."""
    return zlib.compress(np.diff(own, prepend=np.int32(0)).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int32), dtype=np.int32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            own, at = features(batch.column("text"))
            data = [packed(own[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("label"), pa.array(data, pa.binary())], names=["order", "label", "features"]
            )


@dataclass
class Model:
    weights: np.ndarray  # of each feature: ratio times linear weight
    norms: np.ndarray  # of each feature: ratio squared
    bias: float
    slope: float
    level: float

    def score(self, column: pa.Array) -> np.ndarray:
        own, at = features(column)
        total = lambda w: np.diff(np.concatenate(([0.0], np.cumsum(w[own], dtype=np.float64)))[at])
        margin = total(self.weights) / np.sqrt(np.maximum(total(self.norms), 1e-12)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.level, -30, 30)))


class _Scaled(Sequence):
    """The ratios of each row's features, scaled to unit length; worked out when asked for, as all of them would take twice the rows' memory."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray) -> None:
        self.rows, self.ratio = rows, ratio
        self.norms = [max(1e-6, float(np.sqrt(np.sum(ratio[x] ** 2)))) for x in rows]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ratio[self.rows[i]] / self.norms[i]


def held_out(doc_id: Column) -> Column:
    """Whether a row is never trained on: the CRC of its doc_id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def dual_coordinate_descent(rows: list[np.ndarray], values: Sequence[np.ndarray], y: np.ndarray, dims: int, cost: float, passes: int, seed: int):
    """(weights, bias) of the linear model with hinge loss, by coordinate steps in the dual.

    One more coordinate of value 1 stands for the bias.
    """
    w, bias, alpha = np.zeros(dims), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(len(rows)):
            own = values[i]
            gradient = y[i] * (float(w[rows[i]] @ own) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * own
                bias += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3 * cost:
            break
    return w, bias


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, level) of the logistic curve from margins to labels, by Newton steps with a slight penalty."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y <= 0) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(p - target) @ margin + 1e-3 * a, np.sum(p - target)])
        q = p * (1 - p) + 1e-9
        h = np.array([[q @ margin**2 + 1e-3, q @ margin], [q @ margin, q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_fitted: int = MOST_FITTED, cost: float = 1.0) -> Model:
    """Fits the model on the labelled rows that are not ``held_out``.

    Only the text is an input. Null labels are left out; without labels of both kinds every text scores 0.5
    (or near the one label that there is).
    """
    marked = labels.where(f"{label} is not null").groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    marked = broadcast_if_small(marked.where(~held_out(F.col("doc_id"))), _BROADCAST_ROWS)
    rows = docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))).join(marked, "doc_id")
    counted = rows.select("text", "label").mapInArrow(_count, "place long, zeros long, ones long")
    counts = np.zeros((2, DIMS))
    texts = np.zeros(2)
    for batch in counted.groupBy("place").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow().to_batches():
        place, *found = (batch.column(k).to_numpy() for k in range(3))
        counts[:, place[place >= 0]] = np.stack(found)[:, place >= 0]
        texts += np.stack(found)[:, place < 0].sum(axis=1)
    if not texts.all():
        level = 0.0 if not texts.any() else float(np.log((texts[1] + 1) / (texts[0] + 1)))
        return Model(np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0, level)
    smooth = counts + 1
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    ratio[counts.sum(axis=0) < 2] = 0  # seen once: nothing learnt

    share = min(1.0, most_fitted / texts.sum())
    order = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.select(order.alias("order"), "label", "text").where(F.col("order") < share)
    sample = sample.mapInArrow(_rows, "order double, label int, features binary").toArrow()
    ordered = np.lexsort((sample["label"].to_numpy(), sample["order"].to_numpy()))
    y = np.where(sample["label"].to_numpy()[ordered] > 0, 1.0, -1.0)
    pick = lambda xs, m: [x for x, k in zip(xs, m, strict=True) if k]
    sent = sample["features"]
    own = [unpacked(sent[int(i)].as_buffer()) for i in ordered]
    del sample, sent
    fit = np.arange(len(own)) % 4 != 0 if len(own) >= 40 else np.ones(len(own), bool)
    fitted = pick(own, fit)
    w, bias = dual_coordinate_descent(fitted, _Scaled(fitted, ratio), y[fit], DIMS, cost, 30, 1)
    rest = ~fit if not fit.all() else fit
    others = pick(own, rest)
    margin = np.array([float(w[x] @ v) + bias for x, v in zip(others, _Scaled(others, ratio), strict=True)])
    slope, level = _calibrate(margin, y[rest])
    return Model(ratio * w, ratio**2, bias, slope, level)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) of every whole text; null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield batch.append_column("score", pa.array(shared.value.score(batch.column("text"))))

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*columns, "score double"]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of (doc_id, text, ...).

    predicted is 1 if score >= threshold, else 0. Empty and null texts have no features and get a score
    too. A null doc_id is passed through, is never trained on and counts as not held out. Rows that repeat a doc_id
    each give a row. Other columns are ignored. An empty table gives an empty result.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
