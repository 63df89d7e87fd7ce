"""Joins of edges with the nodes at their ends, where a few nodes may hold most of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut

#: Keys that may be heavy, at most, and what their sketch tracks.
MOST_HEAVY, TRACKED = 1024, 16384
#: A heavy key gets as many salts as its share of this many a task.
SALTS_A_TASK = 16
#: Tables of fewer rows fit into one task whatever their keys.
LEAST_ROWS = 1 << 16


class EndpointJoins:
    """``rows`` with joins on some of their columns, the ``ends``, that no heavy key holds up.

    A key is heavy if it has more than half of what a task would get if all were dealt evenly. One mergeable sketch of frequent items per end
    finds these in one pass; what it takes for heavy only costs some copies, so its errors change no result. Only the rows of heavy
    keys are salted, with a copy of the other side's rows of these keys for each salt; all others are joined plainly. The salt is a hash of the
    row, so a task that is run again deals its rows alike; equal rows share a salt.
    """

    def __init__(self, rows: DataFrame, *ends: str, least_rows: int = LEAST_ROWS):
        self.rows, self.ends = cut(rows), ends
        self.heavy = self._heavy(least_rows)

    def _heavy(self, least_rows: int) -> dict[str, list[tuple]]:
        """(key, salts) of each end's heavy keys; all salts of an end together are a small multiple of the tasks."""
        total = self.rows.count()
        if total < least_rows:
            return {end: [] for end in self.ends}
        tasks = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        least, grain = max(total // (2 * tasks), total // MOST_HEAVY), max(1, total // (SALTS_A_TASK * tasks))
        tops = self.rows.agg(*[F.expr(f"approx_top_k(`{end}`, {MOST_HEAVY}, {TRACKED})").alias(end) for end in self.ends]).first()
        return {end: [(x["item"], -(-x["count"] // grain)) for x in tops[end] or () if x["item"] is not None and x["count"] > least] for end in self.ends}

    def join(self, rows: DataFrame, table: DataFrame, end: str, how: str = "inner") -> DataFrame:
        """``rows``, which are this object's or come from them, with ``table`` on its column ``end``; how: inner or left_semi."""
        if not self.heavy[end]:
            return rows.join(table, end, how)
        kind = self.rows.select(end).schema.add("_salts", "long")
        keys = F.broadcast(rows.sparkSession.createDataFrame(self.heavy[end], kind))  # MOST_HEAVY at most
        salted = rows.withColumn("_hash", F.xxhash64(*rows.columns)).join(keys, end)
        salted = salted.withColumn("_salt", F.pmod("_hash", "_salts")).drop("_hash", "_salts")
        copies = table.join(keys, end).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
        plain = rows.join(keys, end, "left_anti").join(table, end, how)
        return plain.unionByName(salted.join(copies, [end, "_salt"], how).drop("_salt"))
