"""Mixes sources to target weights in fixed-length token blocks, in DataFrame functions only.

Each source's documents form one stream of words in a seeded pseudorandom order, cut into blocks of
``block`` words. Output shards have a fixed number of slots, and each slot draws its source by weight, so the
counts of the sources in a shard are one multinomial draw, and what a source gets is what its shards drew. Only where all shards
together drew more than ``OFF`` too much of a source, its last slots are left out, and what they drew too little (or left out of others) comes
in further shards. Slot i of a source takes the block at the place to which a pseudorandom permutation of the source's
blocks, keyed by source and pass, moves i. So no block is taken more than twice where the target is at most twice the size.
Everything is a function of the seed and the data: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, words

BLOCK, SHARD_WORDS, SEED = 128, 1 << 22, 17
WEIGHTS, SHARE, MOST_REPEATS = (5, 2, 1), 1.5, 2
#: How far the drawn slots of a source may be off its target: one part in so many.
OFF = 200
#: Parts into which the weights are cut, to look up what a slot draws.
_BINS = 4096
#: Rounds of the permutation.
_ROUNDS = 16
#: Slots that one row of a generator unfolds.
_RUN = 1024


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, source_size, target) of every source, null included.

    Sources in code-point order (null last) weigh 5, 2, 1, 5, ...; together they get 150 % of all words.
    A target stops at twice its source's size, and what is over is shared again by weight: each
    target is min(2 * size, level * weight) for the one level at which they add up.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), place)
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(MOST_REPEATS)).alias("cap"))
    level = (SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    sizes = sizes.withColumn("level", level)
    sizes = sizes.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(whole))
    return sizes.select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of each row: the texts are read and split once, whatever follows."""
    return cut(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")))


def positions(sized: DataFrame, docs_per_bucket: int = 4096, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, bucket, place, start): each document's first word in its source's stream.

    The running sum is taken in hashed buckets of bounded size and over the bucket totals, so that
    no source's documents meet in one task.
    """
    many = sized.agg(F.ceil(F.count("*") / docs_per_bucket).alias("n")).scalar()
    # Rows that repeat a doc_id are told apart by their size, so that none of them gathers.
    bucket = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.greatest(many, F.lit(1)))
    sized = sized.withColumn("bucket", bucket)
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "bucket", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("offset"))
    own = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = sized.withColumn("place", F.row_number().over(own)).withColumn("end", F.sum("size").over(own))
    joined = sized.alias("d").join(totals.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.bucket") == F.col("t.bucket")))
    return joined.select(
        "d.doc_id", "d.source", "d.size", "d.bucket", "d.place", (F.col("offset") + F.col("end") - F.col("d.size")).alias("start")
    )


def permuted(place: Column, n: Column, key: Column) -> Column:
    """The place in 0 to n - 1 to which a pseudorandom permutation of these numbers moves ``place``.

    A swap-or-not shuffle: each round pairs every x with c - x (modulo n, for a keyed c) and swaps the two or not by a keyed
    bit of the larger one. Any n will do, and no number exceeds 2n.
    """

    def swap_or_not(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        swap = F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), place.cast("long"), swap_or_not)


def _unfolded(counted: DataFrame, *keys: str) -> DataFrame:
    """``i`` from 0 to n - 1 for each row of (.., n), spread over tasks in runs.

    The number of tasks is given, as Spark would put the few rows that name the runs into one.
    """
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = counted.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {_RUN}"))).alias("run")).repartition(tasks, *keys, "run")
    last = F.least(F.col("run") * _RUN + _RUN, F.col("n")) - 1
    return runs.select(*keys, F.explode(F.sequence(F.col("run") * _RUN, last)).alias("i"))


def _drawn(counted: DataFrame, total: int, per_shard: int, seed: int) -> DataFrame:
    """(source, shard, n): what the ``total`` slots draw, each by its shard and its place there, from (source, n, from).

    ``from`` is where the source's n of the ``total`` numbers begin. The sources of a part of the numbers are one row, so a draw looks at a few sources only.
    """
    span = F.sequence(F.expr(f"`from` * {_BINS} div {total}"), F.expr(f"(`from` + n - 1) * {_BINS} div {total}"))
    bins = counted.select(F.explode(span).alias("bin"), F.struct("from", "source").alias("s")).groupBy("bin").agg(F.collect_list("s").alias("held"))
    number = F.pmod(F.xxhash64(F.expr(f"id div {per_shard}"), F.expr(f"id % {per_shard}"), F.lit(seed + 1)), F.lit(total))
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counted.sparkSession.range(0, total, 1, tasks).select(F.expr(f"id div {per_shard}").alias("shard"), number.alias("u"))
    rows = rows.withColumn("bin", F.expr(f"u * {_BINS} div {total}")).join(broadcast_if_small(cut(bins), _BINS, 32 * F.size("held")), "bin")
    source = F.array_max(F.filter("held", lambda s: s["from"] <= F.col("u")))["source"]
    return rows.groupBy(source.alias("source"), "shard").agg(F.count("*").alias("n"))


def shard_counts(sizes: DataFrame, block: int = BLOCK, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(source, blocks, shard, n, first): how many slots each output shard draws of (source, source_size, target), and how many
    the shards before it draw. blocks is the number of the source's blocks.

    The draws of all shards but the further ones are independent; what they sum up to is kept to within one part in ``OFF`` of the target, and
    to twice the blocks.
    """
    per_shard = max(1, shard_words // block)
    counted = sizes.where("source_size > 0").select("source", "source_size", "target", F.ceil(F.col("source_size") / block).alias("blocks"))
    n = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), MOST_REPEATS * F.col("blocks"))
    running = lambda last: Window.orderBy(F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, last)
    counted = counted.select("source", "blocks", n.alias("n")).where("n > 0")
    counted = cut(counted.withColumn("from", F.coalesce(F.sum("n").over(running(-1)), F.lit(0))))
    total = max(1, counted.agg(F.sum("n")).first()[0] or 0)
    drawn = cut(_drawn(counted, total, per_shard, seed))
    sums = drawn.groupBy("source").agg(F.sum("n").alias("drawn"))
    off = F.expr(f"n div {OFF}")
    wanted = F.greatest(F.col("n") - off, F.least(F.col("n") + off, MOST_REPEATS * F.col("blocks"), "drawn"))
    own = counted.alias("c").join(sums.alias("k"), F.col("c.source").eqNullSafe(F.col("k.source")), "left")
    own = own.select("c.source", "blocks", "n", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    own = cut(own.select("source", "blocks", "drawn", wanted.alias("wanted")))
    order = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ahead = drawn.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0))).alias("d")
    kept = ahead.join(own.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source"))).where("first < wanted")
    kept = kept.select("d.source", "blocks", "shard", F.least("n", F.col("wanted") - F.col("first")).alias("n"), "first")
    # What is short of its target fills further shards, one source after the other.
    short = own.where("drawn < wanted").withColumn("missing", F.col("wanted") - F.col("drawn"))
    short = short.withColumn("low", F.coalesce(F.sum("missing").over(running(-1)), F.lit(0))).withColumn("high", F.col("low") + F.col("missing"))
    short = short.select("*", F.explode(F.sequence(F.expr(f"low div {per_shard}"), F.expr(f"(high - 1) div {per_shard}"))).alias("k"))
    begin, end = F.greatest("low", F.col("k") * per_shard), F.least("high", (F.col("k") + 1) * per_shard)
    shard, first = F.col("k") + -(-total // per_shard), F.col("drawn") + begin - F.col("low")
    return kept.unionByName(short.select("source", "blocks", shard.alias("shard"), (end - begin).alias("n"), first.alias("first")))


def slots(counts: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, shard, slot, block): the slots that the counts deal to the shards, and the block of each."""
    rows = _unfolded(counts, "source", "blocks", "shard", "first").withColumn("slot", F.col("first") + F.col("i"))
    rows = rows.withColumn("key", F.xxhash64("source", F.expr("slot div blocks"), F.lit(seed)))
    return rows.select("source", "shard", "slot", permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.col("key")).alias("block"))


def segments(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks that ``positions`` rows cover: (.., block, first_word, n_words), words of the document."""
    covered = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    cuts = placed.where("size > 0").select("*", F.explode(covered).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return cuts.withColumn("first_word", low - F.col("start")).withColumn("n_words", high - low)


def mixed_segments(placed: DataFrame, drawn: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: one row for each slot and each document that its block covers, joined by block index."""
    return (
        segments(placed, block).hint("merge").alias("s")
        .join(drawn.alias("d"), F.col("s.source").eqNullSafe(F.col("d.source")) & (F.col("s.block") == F.col("d.block")))
        .select("s.doc_id", "s.source", "s.bucket", "s.place", "d.shard", "d.slot", "s.block", "s.start", "s.first_word", "s.n_words")
    )


def mixed_texts(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(shard, source, slot, text): the packed blocks of the mix, words joined by one space.

    doc_ids must be unique here. An empty block is not written.
    """
    sized = sized_documents(docs)
    mix = mixed_segments(positions(sized, seed=seed), slots(shard_counts(source_sizes(sized), block, seed), seed), block).drop("source")
    own = docs.select("doc_id", "source", words(F.col("text")).alias("words"))
    piece = F.array_join(F.slice("words", (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    pieces = mix.join(own, "doc_id").select("shard", "source", "slot", "start", piece.alias("piece"))
    lines = pieces.groupBy("shard", "source", "slot").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"))
    return lines.select("shard", "source", "slot", F.array_join(F.col("p.piece"), " ").alias("text"))


def mix_digest(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """What the mix takes from each row of (doc_id, text, source, ...).

    Rows: doc_id, size (words), source_size, target (of its source, in words), taken (words of it in
    the mix, repeats counted; at most twice its size). Null text counts as empty: size and
    taken are 0. Null source is a source of its own, last in order. Rows that repeat a doc_id are documents of
    their own. Other columns are ignored. An empty table gives an empty result.
    """
    sized = sized_documents(docs)
    placed, sizes = positions(sized, seed=seed), source_sizes(sized)
    times = slots(shard_counts(sizes, block, seed), seed).groupBy("source", "block").agg(F.count("*").alias("times"))
    # Spark takes unfolded rows for few; the hints keep it from broadcasting what grows with the corpus.
    cuts = segments(placed, block).select("source", "bucket", "place", "block", "n_words").hint("merge")
    drawn = cuts.alias("s").join(times.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s.block") == F.col("t.block")))
    drawn = drawn.groupBy("s.source", "bucket", "place").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    with_taken = placed.hint("merge").alias("p").join(
        drawn.alias("k"),
        F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p.bucket") == F.col("k.bucket")) & (F.col("p.place") == F.col("k.place")),
        "left",
    )
    return with_taken.join(sizes.alias("z"), F.col("p.source").eqNullSafe(F.col("z.source"))).select(
        "p.doc_id", "p.size", "z.source_size", "z.target", F.coalesce("taken", F.lit(0)).alias("taken")
    )
