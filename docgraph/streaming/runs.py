"""Runs a stream over what is there now, and reads its result as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark) -> str:
    """A new folder under the session's spark.checkpoint.dir; a temporary one only on a local master where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-streams-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def available_now(stream: DataFrame, mode: str) -> DataFrame:
    """The rows that the stream gives for all data that is available, with batch, their batch number.

    In update mode a key has a row for each batch that changed it; the last one counts.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{folder}/out")
