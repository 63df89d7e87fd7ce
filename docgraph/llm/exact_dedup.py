"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so (after a sentence end or line break, at 1024 to 16384
characters), so equal passages give equal chunks wherever they start. Texts never move: a chunk is known
by a 64-bit hash, and the hash counts as an identifier once all its chunks have one SHA-256; where they
have several, the chunk's SHA-256 joins the identifier. Documents are then compared by their ordered
identifier lists, which are some hundred times shorter than the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups, lower_ascii

LEAST, MOST = 1024, 16384


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The content-defined chunks of a text; joined, they are the text. None for empty text."""
    boundary = rf"(?s).{{{least},{most}}}?(?:[.!?]\s|\n)|.{{{most}}}|.+"
    return F.regexp_extract_all(text, F.lit(boundary), F.lit(0))


def chunk_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, cuts): the hash and the SHA-256 of every chunk of each row of (doc_id, text), in order."""
    cutting = F.transform(chunks(F.col("norm")), lambda c: F.struct(F.xxhash64(c).alias("hash"), F.sha2(c, 256).alias("sha")))
    return docs.select("doc_id", lower_ascii(F.col("text")).alias("norm")).select("doc_id", F.sha2("norm", 256).alias("text_sha256"), cutting.alias("cuts"))


def _long(sha: Column, start: int) -> Column:
    """Sixty bits of a digest in hexadecimal."""
    return F.conv(F.substring(sha, start, 15), 16, 10).cast("long")


def chunk_store(lists: DataFrame) -> DataFrame:
    """(chunk_hash, verified) of every distinct chunk hash: whether all its chunks have one digest (120 bits of it count)."""
    own = lists.select(F.explode("cuts").alias("c")).select(F.col("c.hash").alias("chunk_hash"), _long(F.col("c.sha"), 1).alias("x"), _long(F.col("c.sha"), 16).alias("y"))
    sides = own.groupBy("chunk_hash").agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    return sides.select("chunk_hash", ((F.col("x_lo") == F.col("x_hi")) & (F.col("y_lo") == F.col("y_hi"))).alias("verified"))


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, recipe): the ordered verified chunk identifiers of every text.

    One row per input row. Null text counts as empty and has an empty recipe.
    """
    rows = cut(chunk_lists(docs))
    plain = F.transform("cuts", lambda c: c["hash"].cast("string"))
    clashing = cut(chunk_store(rows).where("not verified").select("chunk_hash"))
    if clashing.isEmpty():  # as good as always: 64-bit hashes of unlike chunks rarely meet
        return rows.select("doc_id", "text_sha256", plain.alias("recipe"))
    # Rows are told apart by doc_id and text, which is all that a recipe depends on.
    own = rows.select("doc_id", "text_sha256", F.explode("cuts.hash").alias("chunk_hash")).join(clashing, "chunk_hash")
    own = own.groupBy("doc_id", "text_sha256").agg(F.collect_set("chunk_hash").alias("clashes"))
    same = F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.text_sha256") == F.col("o.text_sha256"))
    told = F.transform(
        "cuts",
        lambda c: F.when(F.array_contains("clashes", c["hash"]), F.concat_ws(":", c["hash"].cast("string"), c["sha"])).otherwise(
            c["hash"].cast("string")
        ),
    )
    return rows.alias("r").join(own.alias("o"), same, "left").select(
        "r.doc_id", "r.text_sha256", F.when(F.col("clashes").isNull(), plain).otherwise(told).alias("recipe")
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups documents of (doc_id, text, ...) with the same text after lower-casing A-Z only.

    One row per input row: doc_id, keep_id (largest doc_id of the group), group_size (its rows), kept
    (doc_id = keep_id), text_sha256 (of the lower-cased text). Null text counts as empty; all empty
    texts are one group. Null doc_ids are smaller than all others; a group of only such rows has a
    null keep_id, and they are kept. Rows that repeat a doc_id and its text count each, and are
    kept or not together. Other columns are ignored. An empty table gives an empty result.
    """
    lists = cut(recipes(docs))
    groups = cut(lists.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return join_groups(lists, groups, ["recipe"], "group_size", F.monotonically_increasing_id()).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )
