"""The corpus pipeline: from raw documents to a deduplicated, decontaminated mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm import decontaminate, exact_dedup, minhash, mixing, quality
from docgraph.llm.common import broadcast_if_small, cut, lower_ascii, read_table


#: Ids of dropped documents that may be broadcast (some 16 MB); more of them are joined by a shuffle.
_FEW = 500_000


def _without(docs: DataFrame, lost: DataFrame, same) -> DataFrame:
    """The documents that no row of ``lost`` is like. Texts stay where they are if the rows of ``lost`` are few."""
    return docs.join(broadcast_if_small(cut(lost), _FEW), same, "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score below 0.3)."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(f"score >= {quality.THRESHOLD}").drop("score")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    lost = exact_dedup.exact_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.sha2(lower_ascii(F.col("text")), 256) == F.col("_sha"))
    return _without(docs, lost, same)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    return _without(docs, minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "doc_id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))  # ids may be null or repeated
    found = decontaminate.contaminated(keyed.select(F.col("_row").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return _without(keyed, found.select(F.col("doc_id").alias("_row")).distinct(), "_row").drop("_row")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each remaining document the mix takes."""
    return mixing.mix_digest(docs)


#: Each function takes (spark, docs, sf_dir); doc_ids name the documents.
STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: A classifier and a seeded mix are not SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, cutting the lineage after each."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
