"""Merkle manifest of a dataset: a tree for each source over its documents by doc_id, and one over the sources.

A leaf's place in its source is a rank query, not a sort: doc_ids become bitmaps of 64-bit words, of which only those that are not
empty are kept; each task makes its own and they are merged by source and word. A directory of counts by word, by container (1,024
words) and by range of containers tells how many rows stand before a word, and a popcount how many before an id in it. Then every
``BLOCK`` neighbours meet in an array of slots by their places, which one task reduces by ``DEPTH`` levels, and what remains goes on as the next round's nodes. Paths
come back down the same blocks. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Nodes that one hash joins, and levels that one array of slots reduces.
FANOUT, DEPTH = 3, 6
BLOCK = FANOUT**DEPTH
#: Rows without doc_id come first in their source: they have a word before all others.
_NO_ID = -(1 << 62)
#: Hex digits of a leaf by which rows that share a doc_id are counted before they are ordered.
_TIE_DIGITS = 4


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The leaf of a row: each value behind its number of bytes, null as a dash."""
    own = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in own])


def _words(rows: DataFrame) -> DataFrame:
    """(of, word, bits, n, before, total): the words of all bitmaps, the rows in each, before it in its source, and in the source."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    words = cut(rows.groupBy("of", "word").agg(F.bit_or(mask).alias("bits"), F.count("*").alias("n")))
    words = words.withColumn("container", F.shiftright("word", 10))
    counts = words.groupBy("of", "container").agg(F.sum("n").alias("n")).withColumn("range", F.shiftright("container", 16))
    ranges = counts.groupBy("of", "range").agg(F.sum("n").alias("n"))
    before = lambda *keys: F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])) - F.col("n")
    total = F.sum("n").over(Window.partitionBy("of"))
    ranges = ranges.select("of", "range", before("of", "range").alias("_r"), total.alias("total"))
    counts = counts.select("of", "container", "range", before("of", "range", "container").alias("_c")).join(ranges, ["of", "range"])
    words = words.select("of", "container", "word", "bits", "n", before("of", "container", "word").alias("_w")).join(counts, ["of", "container"])
    return words.select("of", "word", "bits", "n", (F.col("_r") + F.col("_c") + F.col("_w")).alias("before"), "total")


def places(rows: DataFrame) -> DataFrame:
    """``rows`` (of, doc_id, leaf, ...) with ``idx``, the place in the source by doc_id (null first, ties by leaf), and ``total``."""
    doc_id = F.col("doc_id")
    rows = rows.withColumns({
        "word": F.when(doc_id.isNull(), _NO_ID).otherwise(F.shiftright(doc_id, 6)),
        "bit": F.coalesce(doc_id.bitwiseAND(F.lit(63)), F.lit(0)).cast("int"),
    })
    words = cut(_words(rows.select("of", "word", "bit")))
    lower = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("bit")))
    once = F.bit_count("bits") == F.col("n")
    ranked = rows.join(words, ["of", "word"])
    plain = ranked.where(once).withColumn("idx", F.col("before") + F.bit_count(F.col("bits").bitwiseAND(lower)))
    if words.where(~once).isEmpty():
        return plain.drop("word", "bit", "bits", "n", "before")
    # Words in which an id stands for several rows: counted by id and the leaf's first digits, then ordered by leaf.
    repeated = cut(ranked.where(~once).withColumn("digits", F.left("leaf", F.lit(_TIE_DIGITS))))
    key = ["of", "word", "bit", "digits"]
    in_word = Window.partitionBy("of", "word").orderBy("bit", "digits").rowsBetween(Window.unboundedPreceding, -1)
    counts = repeated.groupBy(*key).agg(F.count("*").alias("_n"))
    counts = counts.select(*key, F.coalesce(F.sum("_n").over(in_word), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*key).orderBy("leaf")) - 1
    tied = repeated.withColumn("_own", own).join(counts, key)
    tied = tied.withColumn("idx", F.col("before") + F.col("_before") + F.col("_own")).drop("digits", "_own", "_before")
    return plain.unionByName(tied).drop("word", "bit", "bits", "n", "before")


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``idx``, the place of a row by ``order``: a sort by ranges, and the rows of the ranges before."""
    df = cut(df.orderBy(order).withColumn("_m", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_m", 33))
    ranges = df.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    ranges = ranges.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_from"))
    return df.join(F.broadcast(ranges), "_part").withColumn("idx", F.col("_from") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_part", "_from")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(of, block, total, slots) of nodes (of, idx, total, hash, own): slots are (slot, hash, own) in order, BLOCK at most."""
    slot = F.struct(F.pmod("idx", F.lit(BLOCK)).cast("int").alias("slot"), "hash", "own")
    grouped = nodes.groupBy("of", F.floor(F.col("idx") / BLOCK).alias("block")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(slot)).alias("slots"))
    return cut(grouped)


def _levels(blocks: DataFrame) -> DataFrame:
    """With ``levels``: the hashes of the slots, and of each level above them while the source has several nodes in the one below."""
    level = lambda own: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(own) - 1) / FANOUT).cast("int")),
        lambda i: F.sha2(F.array_join(F.slice(own, i * FANOUT + 1, FANOUT), ""), 256),
    )
    start = F.struct(F.array(F.transform("slots", lambda s: s["hash"])).alias("levels"), F.col("total").cast("long").alias("left"))

    def step(s: Column, _: Column) -> Column:
        more = F.when(s["left"] > 1, F.concat(s["levels"], F.array(level(F.element_at(s["levels"], -1))))).otherwise(s["levels"])
        return F.struct(more.alias("levels"), F.floor((s["left"] + FANOUT - 1) / FANOUT).alias("left"))

    return blocks.withColumn("levels", F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, step, lambda s: s["levels"]))


def _above(blocks: DataFrame) -> DataFrame:
    """The nodes of the next round: what is left of each block."""
    rest = F.floor((F.col("total") + BLOCK - 1) / BLOCK).alias("total")
    return _levels(blocks).select("of", F.col("block").alias("idx"), rest, F.element_at("levels", -1)[0].alias("hash"), F.lit(None).cast("boolean").alias("own"))


def _below(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """(of, idx, hash, own, path, subroot, root) of the nodes in ``blocks``, by the ``paths`` of the blocks' own nodes."""

    def steps(slot: Column) -> Column:
        def one(k: Column) -> Column:
            own = F.get("levels", k)
            at = F.floor(slot / F.pow(F.lit(float(FANOUT)), k)).cast("int")
            first, nth = at - at % FANOUT, at % FANOUT
            left, right = F.slice(own, first + 1, nth), F.slice(own, at + 2, FANOUT - 1 - nth)
            return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(DEPTH - 1)), lambda k: k < F.size("levels") - 1), one)

    nodes = F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["hash"].alias("hash"), s["own"].alias("own"), steps(s["slot"]).alias("steps")))
    rows = _levels(blocks).select("of", "block", F.inline(nodes))
    rows = rows.join(paths.select("of", F.col("idx").alias("block"), "path", "subroot", "root"), ["of", "block"])
    return rows.select("of", (F.col("block") * BLOCK + F.col("slot")).alias("idx"), "hash", "own", F.concat("steps", "path").alias("path"), "subroot", "root")


def _climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and the one node (of, hash) that is left of each source; ``most`` is the largest number of nodes."""
    rounds = []
    while most > 1:
        rounds.append(_blocks(nodes))
        nodes, most = _above(rounds[-1]), -(-most // BLOCK)
    return rounds, nodes


def proofs(docs: DataFrame, payload: Column) -> DataFrame:
    """(own, leaf, path, subroot, root) of every row of (doc_id, source, lang, n_chars, text, ...).

    ``own`` is ``payload``, a struct of what the caller wants to keep of a row. ``path`` lists, from the leaf to the root, what stands
    left and right of the row's own hash wherever hashes are joined; ``fold`` goes along it. In a source leaves ascend by
    doc_id (null first); rows that share a doc_id go by their leaves, and like rows take the places in any order.
    Null is a source of its own and the first; any column may be null. Without rows the result is empty. Other columns are ignored.
    """
    leaf = leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    of = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")).alias("of")
    rows = cut(docs.select(of, F.col("doc_id").cast("long"), leaf.alias("leaf"), payload.alias("own")))
    nodes = places(rows).select("of", "idx", "total", F.col("leaf").alias("hash"), "own")
    most = rows.groupBy("of").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rounds, left = _climb(nodes, most)
    subroots = cut(left.select("of", "hash", "own"))
    top = _numbered(subroots.select("of", "hash"), "of").withColumn("own", F.struct("of"))
    n = top.count()
    higher, rest = _climb(top.select(F.lit("").alias("of"), "idx", F.lit(n).cast("long").alias("total"), "hash", "own"), n)
    none = F.array().cast("array<struct<left:string,right:string>>")
    paths = rest.select("of", "idx", none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"), "hash", "own")
    for blocks in reversed(higher):
        paths = _below(blocks, paths)
    # A source's own path starts at its subroot, the only node of its last round.
    paths = paths.select("own.of", F.lit(0).cast("long").alias("idx"), "path", F.col("hash").alias("subroot"), "root")
    if not rounds:  # no source has two rows
        return subroots.join(paths, "of").select("own", F.col("hash").alias("leaf"), "path", "subroot", "root")
    for blocks in reversed(rounds):
        paths = _below(blocks, paths)
    return paths.select("own", F.col("hash").alias("leaf"), "path", "subroot", "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda own, s: digest(s["left"], own, s["right"]))


def siblings_digest(path: Column) -> Column:
    """One hash over all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def audit_tampered(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: the manifest, held against a copy of the rows.

    In the copy the texts of rows whose doc_id has an even CRC-32 (of its decimal form) have lost their line feeds; ``folded_root`` comes of the
    copy's leaf and the manifest's path. Rows without doc_id are copied as they are. See ``proofs`` for nulls, ties and repeats.
    """
    text = F.col("text")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    copied = F.when(hit, leaf_digest(*columns, F.replace(text, F.lit("\n"), F.lit(""))))
    found = proofs(docs, F.struct(F.col("doc_id").alias("doc_id"), copied.alias("copied")))
    folded = fold(F.coalesce("own.copied", "leaf"), F.col("path"))
    found = found.select("own.doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
