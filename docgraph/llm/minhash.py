"""MinHash near-dedup: circulant signatures, banding, exact Jaccard on full sets, components.

Two bijections of 32-bit words, sigma and pi, give every coordinate: coordinate k of a set is
``min pi(sigma(x) + k)``, that is, pi circularly shifted by k. Bands of coordinates name buckets.

Within a bucket no all-pairs list is made. Each round takes a few hubs (first the smallest id of the
bucket), compares them exactly with the members of *other* components, links what passes, and
retires the hubs. A bucket ends as soon as all that is left in it is one component, so a group of
thousands of copies costs one comparison a member. The number of hubs grows from round to round,
so few rounds remain where a bucket holds many unlike texts; none of their links is lost.

Texts that share a frequent passage can fill a bucket without being alike. After the first round, the
members of buckets with more than ``CROWDED`` texts and several components are sketched anew with longer
bands, which unlike texts rarely share, and meet in those buckets instead. After that round, too, a parity bitmap of
each set rides along: each shingle flips one bit, so that the bits in which two bitmaps differ are at most the
shingles in which the sets differ. A pair with more of them than a link allows is no link for certain and
never becomes a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, join_groups
from .shingles import mix64, shingle_sets, slices

BANDS, ROWS = 32, 4
#: Bands for texts from crowded buckets: a pair at 0.75 is missed with probability (1 - 0.75^10)^160 = 9e-5.
LONG_BANDS, LONG_ROWS, CROWDED = 160, 10, 1024
#: A round takes so many times the hubs of the round before.
SMALL = 32
#: A bitmap has sixteen bits a shingle, up to so many longs; a wider set keeps its bitmap exact, only less sharp.
MOST_BITMAP = 64
#: Members of a bucket that one part of it may hold.
PART = 1024
#: Tables of ids with at most so many rows (a few MB) are broadcast; larger ones are shuffled.
FEW = 200_000
_BLOCK = 1 << 15


def _mix32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection on 32-bit words; in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash of each non-empty set: rows x coordinates, unsigned 32-bit."""
    out = np.empty((len(at) - 1, coordinates), np.uint32)
    start = 0
    while start < len(at) - 1:
        end = max(start + 1, int(np.searchsorted(at, at[start] + _BLOCK, "right")) - 1)
        own = sets[at[start] : at[end]]
        moved = _mix32((own ^ (own >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
        edges = at[start:end] - at[start]
        for k in range(coordinates):
            out[start:end, k] = np.minimum.reduceat(_mix32(moved + np.uint32(k), 0x21F0AAAD, 0x735A2D97), edges)
        start = end
    return out


def bitmaps(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity bitmaps of the sets, as longs one after the other, and the n + 1 offsets of the sets among them."""
    size = np.diff(at)
    longs = np.minimum(MOST_BITMAP, 1 << np.ceil(np.log2(np.maximum(size, 4) / 4)).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(longs)))
    bit = (mix64(sets) & (np.repeat(longs, size) * 64 - 1).astype(np.uint64)).astype(np.int64) + np.repeat(begin[:-1] * 64, size)
    flips = np.zeros(begin[-1] * 64, np.uint8)
    np.add.at(flips, bit, np.uint8(1))
    return np.packbits(flips & 1, bitorder="little").view(np.int64), begin


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _band_keys(sets: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bucket of each non-empty set in each band."""
    keys = np.zeros((len(at) - 1, bands), np.uint64)
    signature = signatures(sets, at, bands * rows).astype(np.uint64)
    for j in range(rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, j::rows])
    return mix64(keys + np.arange(bands, dtype=np.uint64))


def _sketcher(bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets, at = shingle_sets(batch.column("text"))
                size = np.diff(at)
                full = np.flatnonzero(size)
                lo, hi = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                keys = np.zeros((0, bands), np.uint64)
                if len(full):
                    starts = at[:-1][full]
                    lo[full] = np.add.reduceat(mix64(sets), starts)
                    hi[full] = np.add.reduceat(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    keys = _band_keys(sets, np.append(starts, at[-1]), bands, rows)
                lists = _lists(keys.reshape(-1).view(np.int64), np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("t"), pa.array(size), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), lists],
                    names=["doc_id", "t", "n_shingles", "set_lo", "set_hi", "bands"],
                )

    return sketch


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text): t tells the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text")


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, t, n_shingles, set_lo, set_hi, bands) of every row of (doc_id, text); t is a hash of the text.

    ``set_lo`` and ``set_hi`` are a 128-bit hash of the shingle set: equal sets, equal hash.
    """
    return _keyed(docs).mapInArrow(_sketcher(bands, rows), "doc_id long, t long, n_shingles long, set_lo long, set_hi long, bands array<long>")


def _resketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, t, n, bits, long): the bitmap of each text, and the long bands of those that are in crowded buckets."""
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            sets, at = shingle_sets(batch.column("text"))
            bits, begin = bitmaps(sets, at)
            crowded = np.flatnonzero(batch.column("crowded").to_numpy(zero_copy_only=False))
            size = np.diff(at)
            keys = np.zeros((0, LONG_BANDS), np.uint64)
            if len(crowded):
                own = np.concatenate([sets[at[i] : at[i + 1]] for i in crowded])
                keys = _band_keys(own, np.concatenate(([0], np.cumsum(size[crowded]))), LONG_BANDS, LONG_ROWS)
            many = np.zeros(len(size), np.int64)
            many[crowded] = LONG_BANDS
            yield pa.RecordBatch.from_arrays(
                [batch.column("v"), batch.column("t"), pa.array(size), _lists(bits, begin), _lists(keys.reshape(-1).view(np.int64), np.concatenate(([0], np.cumsum(many))))],
                names=["v", "t", "n", "bits", "long"],
            )


def _linked(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_a", 1 << 20):
                a, at_a = shingle_sets(batch.column("text_a"))
                b, at_b = shingle_sets(batch.column("text_b"))
                keep = np.zeros(batch.num_rows, bool)
                for i in range(batch.num_rows):
                    x, y = a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = np.concatenate((x, y))
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return verify


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges of one task."""
    root: dict[int, int] = {}

    def top(v: int) -> int:
        path = []
        while root.setdefault(v, v) != v:
            path.append(v)
            v = root[v]
        for x in path:
            root[x] = v
        return v

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    ids = list(root)
    tops = [top(v) for v in ids]
    weight = Counter(tops)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(tops, pa.int64()), pa.array([weight[t] for t in tops], pa.int64())], names=["id", "component", "weight"]
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, component, weight) of the vertices of (a, b): the smallest id each can reach, and how many reach it.

    At most ``FEW`` edges are joined up in one task. More of them take alternating large-star and
    small-star steps: each edge moves towards the smallest neighbour of one end, so chains halve and a hub's
    edges stay one row each.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if edges.limit(FEW + 1).count() <= FEW:
        return edges.coalesce(1).mapInArrow(_forest, "id long, component long, weight long")
    found = _stars(edges)
    weights = found.groupBy("component").agg(F.count("*").alias("weight"))
    return found.join(weights, "component").select("id", "component", "weight")


def _stars(edges: DataFrame) -> DataFrame:
    """(id, component) by large-star and small-star steps, until no edge moves."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % 1_000_003).cast("long"))).first())

    def least(neighbours: DataFrame) -> DataFrame:
        low = neighbours.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return neighbours.join(low, "a")

    now = mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = least(large.where("a <> b"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        before, now = now, mark(edges)
        if before == now:
            break
    leaves = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots.join(leaves.select("id"), "id", "left_anti"))


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds c, the member's component."""
    if labels is None:
        return members.withColumn("c", F.col("v"))
    known = broadcast_if_small(labels.select(F.col("id").alias("v"), "component"), FEW)
    return members.join(known, "v", "left").withColumn("c", F.coalesce("component", "v")).drop("component")


def _several(members: DataFrame) -> DataFrame:
    """The labelled members (bucket, v, t, n, bits, c) of buckets that hold more than one component, with size, the
    number of the bucket's members."""
    buckets = members.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"))
    buckets = cut(buckets.where("lo <> hi").select("bucket", "size"))
    return join_groups(members, buckets, ["bucket"], "size", F.xxhash64("v", "t")).where("size is not null")


def _hubs(members: DataFrame, most: int) -> DataFrame:
    """(bucket, v, t, n, bits, c, size): about ``most`` members of each bucket, all if it has no more.

    They are dealt by a hash, so that no bucket is sorted; most of them are of the bucket's largest components, which stragglers
    probably belong to. One hub is the least id.
    """
    if most == 1:
        own = F.min(F.struct("v", "t", "n", "c", "size")).alias("m")
        return members.groupBy("bucket").agg(own).select("bucket", "m.*", F.lit(None).cast("array<long>").alias("bits"))
    share = F.pmod(F.xxhash64("v", "t", F.lit(most)), F.ceil(F.col("size") / most)) == 0
    return members.where(share).select("bucket", "v", "t", "n", "c", "size", "bits")


def _differing(a: Column, b: Column) -> Column:
    """The bits in which two bitmaps differ, where the wider one is folded to the width of the other."""
    half = lambda x: F.zip_with(
        F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q)
    )
    x = F.when(F.size(a) > F.size(b), half(a)).otherwise(a)
    y = F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)


def _pairs(members: DataFrame, hubs: DataFrame, percent: int, sharp: bool) -> DataFrame:
    """(a, at, b, bt), a < b: hubs and members of their buckets, of other components, that sizes and bitmaps allow to be linked.

    The members of a large bucket are dealt over parts, and its hubs go to each part.
    """
    parts = F.ceil(F.col("size") / PART).cast("int")
    members = members.withColumn("part", F.pmod(F.xxhash64("v", "t"), parts).cast("int"))
    hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    m, h = (lambda c: F.col(f"m.{c}")), (lambda c: F.col(f"h.{c}"))
    met = (m("bucket") == h("bucket")) & (m("part") == h("part")) & (m("c") != h("c"))
    met &= F.lit(100) * F.least(m("n"), h("n")) >= F.lit(percent) * F.greatest(m("n"), h("n"))
    if sharp:
        met &= F.lit(100 + percent) * _differing(m("bits"), h("bits")) <= F.lit(100 - percent) * (m("n") + h("n"))
    low = m("v") < h("v")
    side = lambda first, c: F.when(first, m(c)).otherwise(h(c))
    return members.alias("m").join(hubs.alias("h"), met).select(
        side(low, "v").alias("a"), side(low, "t").alias("at"), side(~low, "v").alias("b"), side(~low, "t").alias("bt")
    ).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    side = lambda s: texts.select(F.col("v").alias(s), F.col("t").alias(f"{s}t"), F.col("text").alias(f"text_{s}"))
    return pairs.join(side("a"), ["a", "at"]).join(side("b"), ["b", "bt"]).mapInArrow(_linked(percent), "a long, b long")


def _links(classes: DataFrame, same_ids: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """(id, component, weight) of all classes that are linked with others; None if there are none.

    classes: (class_id, t, n_shingles, bands), a row for each set; same_ids: (a, b), classes that one doc_id joins.
    """
    members = classes.select(F.explode("bands").alias("bucket"), F.col("class_id").alias("v"), "t", F.col("n_shingles").alias("n"))
    members = cut(_several(_labelled(members, None)))
    alone = members.isEmpty()
    if alone:
        return None if same_ids.isEmpty() else cut(components(same_ids))
    needed = members.select("v", "t").distinct()  # only these texts move
    texts = cut(_keyed(docs).withColumnRenamed("doc_id", "v").join(needed, ["v", "t"]).dropDuplicates(["v", "t"]))
    labels, most = None, 1
    while not members.isEmpty():
        hubs = cut(_hubs(members, most))
        found = _verified(cut(_pairs(members, hubs, percent, most > 1)), texts, percent)
        found = found.unionByName(same_ids if labels is None else labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        labels = cut(components(found))
        met = broadcast_if_small(hubs.select("bucket", "v", "t"), FEW)
        rest = members.join(met, ["bucket", "v", "t"], "left_anti").drop("c", "size")
        if most > 1:
            members = cut(_several(_labelled(rest, labels)))
        else:
            members = cut(_resketched(cut(_several(_labelled(rest, labels))), texts, labels))
        most *= SMALL
    return labels


def _resketched(members: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """The members with bitmaps; those of crowded buckets in buckets of long bands instead."""
    left = members.groupBy("v", "t").agg(F.max(F.col("size") > CROWDED).alias("crowded"))
    again = cut(texts.join(left, ["v", "t"]).select("v", "t", "text", "crowded").mapInArrow(_resketch, "v long, t long, n long, bits array<long>, long array<long>"))
    few = members.where(F.col("size") <= CROWDED).join(again.select("v", "t", "bits"), ["v", "t"])
    long = _labelled(again.where(F.size("long") > 0), labels).select(F.explode("long").alias("bucket"), "v", "t", "n", "bits", "c")
    return few.unionByName(_several(long))


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups documents whose sets of five-word shingles have a Jaccard similarity of ``percent`` or more.

    docs: (doc_id, text, ...); other columns are ignored. One row per input row: doc_id,
    n_shingles, class_id (smallest doc_id with the same set), component_id (smallest doc_id that
    links reach), kept (doc_id = component_id). Candidates come from circulant MinHash bands (a pair at
    the threshold is missed with probability (1 - 0.75^4)^32 = 5e-6); each is confirmed on the full
    sets. Sets are held as 64-bit shingle hashes.

    Null or blank texts have no shingles and are linked with nothing. A null doc_id keeps its row, with
    null class and component, and is kept. Rows that repeat a doc_id are one vertex with several sets: what any of them is linked
    with, all are. An empty table gives an empty result.
    """
    sketch = cut(sketches(docs, bands, rows))
    same = ["n_shingles", "set_lo", "set_hi"]
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "t")).alias("m")
    classes = cut(full.groupBy(*same).agg(first, F.first("bands").alias("bands"), F.count("*").alias("n")).select(*same, F.col("m.doc_id").alias("class_id"), "m.t", "bands", "n"))
    labels = _links(classes, _same_ids(full, classes, same), docs, percent)
    groups = classes.select(*same, "class_id", "n")
    if labels is None:
        groups = groups.withColumn("component", F.col("class_id"))
    else:
        known = labels.select(F.col("id").alias("class_id"), "component")
        groups = groups.join(known, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    place = F.monotonically_increasing_id()  # texts without shingles belong to no group, and must not gather
    rows_ = sketch.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_lo")).otherwise(place).alias("set_lo"), "set_hi", place.alias("place"))
    own = F.col("doc_id").isNull()  # without an id or a set a row stands alone
    out = join_groups(rows_, cut(groups), same, "n", F.col("place"))
    component = F.when(own, None).otherwise(F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(own, None).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _same_ids(full: DataFrame, classes: DataFrame, same: list[str]) -> DataFrame:
    """(a, b): the classes of the sets that rows of one doc_id hold, each with the smallest of them."""
    one = F.struct(*same)
    several = cut(full.groupBy("doc_id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <> hi").select("doc_id"))
    of_sets = full.join(broadcast_if_small(several, FEW), "doc_id", "left_semi").select("doc_id", *same).distinct()
    held = cut(of_sets.join(classes.select(*same, "class_id"), same).select("doc_id", "class_id"))
    least = held.groupBy("doc_id").agg(F.min("class_id").alias("a"))
    return cut(held.join(least, "doc_id").select("a", F.col("class_id").alias("b")).where("a <> b").distinct())
