"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Everything is DataFrame functions. A document's windows for an item of L words are its runs of L
words. Similarity is the weighted Jaccard of their five-word shingles (weight: how often a shingle
occurs). Moving a window forward to its first shingle of an item never lowers its similarity to it, so only windows that start
there count. First the places of item shingles in documents are found, by a bit table of all item shingles, and move without
texts. They are kept by the widths of items, not by the items: a phrase that many items share costs as much as one that
one item has. A document stays with a width only if it holds one of the rarest shingles of an item of it (any window that reaches the threshold has one of an
item's n - ceil(0.75 n) + 1 rarest), and a window only if it holds enough places.

Of the windows that are left one in each ``STRIDE``-th of their width is fingerprinted, and one index of the fingerprints of all items finds the
items that a document may hold. Of such a document and item, the windows that may reach the threshold are compared, the most promising first and then
those that may still be better. Fingerprints are 64 bits. With 8 blocks of 8 bits, two fingerprints within ``RADIUS`` = 23 bits agree to
within 2 bits in some block; the index lists every item under all 37 such values of each block, so
the equality join on block and value finds all items within the radius of a window. At the threshold of 0.75
the expected distance is 11 bits with a deviation of 3, so the radius lies four deviations beyond; a window next to one that reaches
0.75 reaches 0.74 at least, by the stride. Candidates are confirmed exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, lower_ascii, words

SHINGLE, THRESHOLD = 5, 0.75
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
#: Windows to an item's width of which one is fingerprinted, where there are so many.
STRIDE = 64
#: The bit table holds 2^10 to 2^18 longs (2 MB at most), however large the benchmark.
_TABLE_CELLS = (10, 18)
_LANE, _LANES, MOST_IN_LANES = 0x0001000100010001, 16, 32_767
#: Index rows and shingles of items that may be broadcast.
_BROADCAST_ROWS = 1_000_000


def shingle_hashes(tokens: Column, width: int) -> Column:
    """The hash of each run of ``width`` words, in order."""
    starts = F.sequence(F.lit(0), F.size(tokens) - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(width)]))
    return F.when(F.size(tokens) >= width, hashes).otherwise(F.array().cast("array<long>"))


def simhash(shingles: Column) -> Column:
    """The SimHash of shingles: bit by bit the majority of their hashes.

    Sixteen longs count four bits each, two bytes a bit; where there are too many shingles for that, each bit is counted apart.
    """
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(_LANES)])
    count = lambda a, x, k: (a[f"c{k}"] + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(_LANE))).alias(f"c{k}")
    counts = F.aggregate(shingles, zero, lambda a, x: F.struct(*[count(a, x, k) for k in range(_LANES)]))
    quick = F.transform(F.array(counts), lambda c: _majority(c, F.size(shingles)))[0]
    return F.when(F.size(shingles) <= MOST_IN_LANES, quick).otherwise(_bitwise_majority(shingles))


def _bitwise_majority(shingles: Column) -> Column:
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ones = lambda k: F.aggregate(shingles, none, lambda n, x: n + F.call_function("shiftrightunsigned", x, k).bitwiseAND(one))
    mask = lambda k: F.when(ones(k) * 2 > F.size(shingles), F.call_function("shiftleft", one, k)).otherwise(none)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), none, lambda bits, k: bits.bitwiseOR(mask(k)))


def _majority(counts: Column, n: Column) -> Column:
    bits = F.lit(0).cast("long")
    for k in range(_LANES):
        for j in range(64 // _LANES):
            count = F.shiftrightunsigned(counts[f"c{k}"], _LANES * j).bitwiseAND(F.lit(65535))
            bits = bits.bitwiseOR(F.when(count * 2 > n, F.lit(_signed(1 << (_LANES * j + k)))).otherwise(F.lit(0).cast("long")))
    return bits


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller weights over sum of the larger, where a weight is a number of occurrences."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    common = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(_common_weight(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _common_weight(a: Column, b: Column) -> Column:
    """The sum of the smaller weights: both arrays are sorted as one, and each run of a shingle adds what both have of it."""
    side = lambda x, k: F.transform(x, lambda v: F.struct(v.alias("v"), F.lit(k).alias("k")))
    merged = F.sort_array(F.concat(side(a, 0), side(b, 1)))
    state = "struct<v:bigint,a:int,b:int,total:int>"
    start = F.struct(F.lit(None), F.lit(0), F.lit(0), F.lit(0)).cast(state)

    def step(s: Column, e: Column) -> Column:
        same = s["v"].eqNullSafe(e["v"])
        count = lambda name, k: F.when(same, s[name]).otherwise(0) + (e["k"] == k).cast("int")
        done = F.when(same, s["total"]).otherwise(s["total"] + F.least(s["a"], s["b"]))
        return F.struct(e["v"], count("a", 0), count("b", 1), done).cast(state)

    return F.aggregate(merged, start, step, lambda s: s["total"] + F.least(s["a"], s["b"]))


def _blocks(fingerprint: Column) -> Column:
    """(block, value) of each block of a fingerprint."""
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("block"),
                F.shiftrightunsigned(fingerprint, BLOCK_BITS * k).bitwiseAND(F.lit(255)).cast("int").alias("value"),
            )
            for k in range(BLOCKS)
        ]
    )


def _near_values() -> list[int]:
    """All differences of a block with at most RADIUS // BLOCKS bits."""
    most = RADIUS // BLOCKS
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(BLOCK_BITS), n)]


def _bit_table(known: DataFrame, cells: int) -> Column:
    """A scalar array of ``2^cells`` longs with one bit set for each shingle hash ``h`` of ``known``."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("h"), cells))
    filled = known.groupBy(_cell(F.col("h"), cells).alias("cell")).agg(F.bit_or(mask).alias("bits"))
    every = known.sparkSession.range(1 << cells).select(F.col("id").cast("int").alias("cell")).join(filled, "cell", "left")
    pairs = F.array_sort(F.collect_list(F.struct("cell", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return every.agg(F.transform(pairs, lambda c: c["bits"])).scalar()


def _cell(h: Column, cells: int) -> Column:
    return F.pmod(h, F.lit(1 << cells)).cast("int")


def _bit(h: Column, cells: int) -> Column:
    return F.shiftrightunsigned(h, cells).bitwiseAND(F.lit(63)).cast("int")


def _known(items: DataFrame) -> DataFrame:
    """(h, width, rare): the shingles of the items of each width; ``rare`` if one of those items has it among its rarest."""
    each = items.select("key", F.size("item").alias("width"), F.explode(F.array_distinct("item")).alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("often"))
    by_rarity = F.row_number().over(Window.partitionBy("key").orderBy("often", "h"))
    ranked = each.join(often, "h").withColumn("rare", by_rarity <= F.col("width") - F.ceil(F.col("width") * THRESHOLD) + 1)
    return ranked.groupBy("h", "width").agg(F.max("rare").alias("rare"))


def _hits(docs: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """(row, size, start, h): the places in documents (row, tokens) that hold a shingle of an item; ``size`` is the document's number of places."""
    hashes = known.select("h").distinct()
    cells = min(max(_TABLE_CELLS[0], (hashes.count() // 4).bit_length()), _TABLE_CELLS[1])
    h = F.xxhash64(*[F.get("tokens", F.col("start") + k) for k in range(width)])
    in_table = F.call_function("shiftrightunsigned", F.get(_bit_table(hashes, cells), _cell(h, cells)), _bit(h, cells)).bitwiseAND(F.lit(1)) == 1
    # The outer form keeps Spark from inferring a filter that would split all texts twice.
    every = F.when(F.size("tokens") >= width, F.sequence(F.lit(0), F.size("tokens") - width))
    places = docs.select("row", "tokens", F.explode_outer(every).alias("start")).where(F.col("start").isNotNull())
    return places.where(in_table).select("row", (F.size("tokens") - width + 1).alias("size"), "start", h.alias("h")).distinct()


def _windows(places: DataFrame, key: str) -> DataFrame:
    """(row, key, width, start, most): the windows that start at the ``places`` (row, key, width, size, start) of ``key`` and may reach the threshold.

    ``most`` bounds the similarity, as if every place in the window counted in full. ``places`` are dealt by row and key.
    """
    of_key = Window.partitionBy("row", key)
    hits = places.withColumn("n", F.count("*").over(of_key)).where(F.col("n") >= THRESHOLD * F.col("width"))
    # A window ends as an event of its own; the events of a document and key in order, ends before the places they exclude.
    names = list(dict.fromkeys(["row", key, "width", "own", "start"]))
    own = F.least("width", F.col("size") - F.col("start"))
    events = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("place")), F.struct((F.col("start") + own).alias("pos"), F.lit(0).alias("place")))
    events = hits.withColumn("own", own).select(*names, F.inline(events))
    so_far = F.sum("place").over(of_key.orderBy("pos", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = events.withColumn("held", F.when(F.col("place") == 1, 1 - so_far).otherwise(so_far)).groupBy(*names).agg(F.sum("held").alias("held"))
    most = F.col("held") / (F.col("width") + F.col("own") - F.col("held"))
    return counted.withColumn("most", most).where(F.col("most") >= THRESHOLD).drop("own", "held")


def _found(windows: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """(row, key): the items that the fingerprints of the ``windows`` (row, width, start) find in the index of all items."""
    near = F.array(*[F.lit(x) for x in _near_values()])
    index = items.select("key", F.size("item").alias("width"), "item_print", F.explode(_blocks(F.col("item_print"))).alias("b"))
    values = F.transform(near, lambda x: F.col("b.value").bitwiseXOR(x))
    index = cut(index.select("key", "width", "item_print", "b.block", F.explode(values).alias("value")))
    # A document's shingles are met once for each width, and its windows are cut from them there.
    wanted = windows.groupBy("row", "width").agg(F.collect_list("start").alias("starts"))
    cuts = F.transform("starts", lambda s: simhash(F.slice("own", s + 1, F.col("width"))))
    prints = wanted.join(texts, "row").select("row", "width", F.explode(F.array_distinct(cuts)).alias("print"))
    probes = prints.select("row", "width", "print", F.inline(_blocks(F.col("print"))))
    met = probes.join(broadcast_if_small(index, _BROADCAST_ROWS), ["width", "block", "value"])
    return met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("row", "key").distinct()


def _compared(starts: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """(row, doc_id, key, item_id, start, n_words, hamming, similarity) of the windows at ``starts`` (row, key, start) that are like their items."""
    whole = items.select("key", "item_id", "n_words", "item", "item_print")
    windows = starts.join(broadcast_if_small(whole, _BROADCAST_ROWS, 64 + 8 * F.size("item")), "key").join(texts, "row")
    windows = windows.withColumn("window", F.slice("own", F.col("start") + 1, F.size("item")))
    windows = windows.select("row", "doc_id", "key", "item_id", "start", "n_words", "window", "item_print", weighted_jaccard(F.col("window"), F.col("item")).alias("similarity"))
    hamming = F.bit_count(simhash(F.col("window")).bitwiseXOR(F.col("item_print"))).alias("hamming")
    return windows.where(F.col("similarity") >= THRESHOLD).select("row", "doc_id", "key", "item_id", "start", "n_words", hamming, "similarity")


def _matches(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """The windows of ``docs`` (row, doc_id, tokens) most like ``items`` (item_id, tokens), on shingles of ``width`` words.

    Ids may be null or repeated: items go by a hash of id and words, documents by ``row``.
    """
    items = items.select("item_id", F.xxhash64("item_id", "tokens").alias("key"), F.size("tokens").alias("n_words"), shingle_hashes(F.col("tokens"), width).alias("item"))
    items = cut(items.withColumn("item_print", simhash(F.col("item"))))
    known = cut(_known(items))
    hits = cut(_hits(docs, known, width))
    # By width: what may hold some item of it.
    by_width = hits.join(broadcast_if_small(known, _BROADCAST_ROWS), "h").select("row", "width", "size", "start", "rare").repartition("row", "width")
    by_width = by_width.withColumn("any", F.max("rare").over(Window.partitionBy("row", "width"))).where("any").drop("any", "rare")
    windows = _windows(by_width, "width")
    span = F.greatest(F.lit(1), F.floor(F.col("width") / STRIDE)).cast("int")
    one = F.max(F.struct("most", (-F.col("start")).alias("back"))).alias("m")
    windows = cut(windows.groupBy("row", "width", F.floor(F.col("start") / span).alias("span")).agg(one).select("row", "width", (-F.col("m.back")).alias("start")))
    rows = broadcast_if_small(cut(windows.select("row").distinct()), _BROADCAST_ROWS)
    texts = cut(docs.join(rows, "row", "left_semi").select("row", "doc_id", shingle_hashes(F.col("tokens"), width).alias("own")).distinct())
    pairs = cut(_found(windows, texts, items))
    # By document and item: the windows that start with a shingle of the item.
    each = items.select("key", F.size("item").alias("width"), F.explode(F.array_distinct("item")).alias("h"))
    asked = pairs.join(broadcast_if_small(each.groupBy("key").agg(F.first("width").alias("width"), F.collect_list("h").alias("hs")), _BROADCAST_ROWS, 64 + 8 * F.size("hs")), "key")
    places = asked.select("row", "key", "width", F.explode("hs").alias("h")).join(hits, ["row", "h"]).select("row", "key", "width", "size", "start").repartition("row", "key")
    starts = cut(_windows(places, "key").select("row", "key", "start", "most"))
    best = F.max(F.struct("most", (-F.col("start")).alias("back"))).alias("m")
    first = starts.groupBy("row", "key").agg(best).select("row", "key", (-F.col("m.back")).alias("start"), "m.most")
    found = cut(_compared(first.select("row", "key", "start"), texts, items))
    reached = found.groupBy("row", "key").agg(F.max("similarity").alias("similarity"))
    tried = first.select("row", "key", F.col("start").alias("tried")).join(reached, ["row", "key"], "left")
    # A window that may be as good and starts earlier counts too.
    better = (F.col("start") != F.col("tried")) & (F.col("similarity").isNull() | (F.col("most") > F.col("similarity")) | (F.col("most") == F.col("similarity")) & (F.col("start") < F.col("tried")))
    rest = starts.join(tried, ["row", "key"]).where(better).select("row", "key", "start")
    return found.unionByName(_compared(rest, texts, items))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents of (doc_id, text, ...) that hold a passage like an item of (item_id, text, ...).

    One row per document and item with a window of item size whose weighted shingle similarity is 0.75
    or more: doc_id, item_id, and of its best window (ties: the first) start (words before it), n_words,
    hamming (distance of the fingerprints) and similarity. Words are lower-cased (A-Z only). At the end of a
    document windows are cut short. An item of fewer than five words is one shingle: it matches where its
    words occur in order. Null, empty and blank texts and items match nothing. Null ids are
    reported as null; rows that repeat an id are as one. Other columns are ignored. Without
    documents or items the result is empty.
    """
    tokens = words(lower_ascii(F.col("text"))).alias("tokens")
    items = cut(benchmark.select("item_id", tokens).where(F.size("tokens") > 0).distinct())
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), tokens)
    widths = sorted(r[0] for r in items.select(F.least(F.size("tokens"), F.lit(SHINGLE))).distinct().collect())  # five at most
    found = docs.select(
        "doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("n_words"),
        F.lit(0).alias("hamming"), F.lit(0.0).alias("similarity"),
    ).where(F.lit(False))
    for width in widths:
        of_width = items.where((F.size("tokens") == width) if width < SHINGLE else (F.size("tokens") >= SHINGLE))
        found = found.unionByName(_matches(docs, of_width, width).select(*found.columns))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", "hamming")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("m.back")).cast("long").alias("start"), F.col("m.n_words").cast("long").alias("n_words"),
        F.col("m.hamming").cast("long").alias("hamming"), "m.similarity",
    )
