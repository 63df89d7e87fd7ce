"""What the training-data operators share: word rules, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty.

    ``lower`` equals that on pure ASCII text and is much faster than ``translate``.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column) -> Column:
    """The words of a text, in order; empty for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset a temporary one is taken, on a local master
    only, as executors elsewhere would not see it.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", ""):
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, most_rows: int, row_bytes: Column | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """Hints a broadcast only if ``df`` has at most ``most_rows`` rows; else Spark shuffles.

    Rows that hold arrays or texts are weighed too: ``row_bytes`` is the size of one, and all may have ``most_bytes``. Use it for
    tables that are cheap to read, such as a Parquet file or a checkpoint.
    """
    small = df.limit(most_rows + 1).count() <= most_rows
    if small and row_bytes is not None:
        small = (df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= most_bytes
    return F.broadcast(df) if small else df


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``groups``, one row a key, without a task that gets all rows of a large group.

    ``size`` names the number of rows of a group. A group of more than ``most`` rows is dealt over several parts by a hash of
    ``spread``; there are 10,000 such groups at most, whatever the size of the input, and only hashes of their keys are broadcast, so keys may be
    arrays of any length. Groups whose keys share a hash are dealt alike. Cut the lineage of ``groups`` before, as it is read three times.
    """
    most = max(256, (groups.agg(F.sum(size)).first()[0] or 0) // 10_000)
    hashed = F.xxhash64(*keys)
    large = groups.where(F.col(size) > most).groupBy(hashed.alias("_hash")).agg(F.ceil(F.max(size) / most).cast("int").alias("_parts"))
    deal = lambda df: df.withColumn("_hash", hashed).join(F.broadcast(large), "_hash", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = deal(rows).withColumn("_part", F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")).drop("_parts", "_hash")
    copies = deal(groups).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_hash")
    return dealt.join(copies, [*keys, "_part"], "left").drop("_part")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
