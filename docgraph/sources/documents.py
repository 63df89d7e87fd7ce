"""Parsed documents as JSON, graph tables as Parquet, and saved sessions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoints import cut
from ..operators.graph import EDGE_COLUMNS, NODE_COLUMNS, merge_nodes
from ..operators.memory import MESSAGE, NOTE

_REF = "struct<number:string,identifier:string,paragraph:int,points:array<string>,text:string,url:string>"
_REFS = f"struct<articles:array<{_REF}>,chapters:array<{_REF}>,annexes:array<{_REF}>,sections:array<{_REF}>,recitals:array<{_REF}>>"


def _paragraph(depth: int) -> str:
    below = f",totalSubParagraphs:array<{_paragraph(depth - 1)}>" if depth > 1 else ""
    return f"struct<type:string,id:string,text:string,references:{_REFS},level:int{below}>"


_HEADER = "struct<name:string,number:int,id:string,identifier:string,summary:string,entryIntoForce:string>"
DOCUMENT = (
    f"article {_HEADER}, annex {_HEADER}, recital {_HEADER}, paragraphs array<{_paragraph(4)}>, "
    f"content array<struct<type:string,id:string,name:string,text:string,references:{_REFS},paragraphs:array<{_paragraph(4)}>>>, "
    f"references {_REFS}, metadata struct<extractedAt:string,sourceType:string,contentType:string,chapter:array<string>,section:array<string>>"
)
STATE = f"buffer array<{MESSAGE}>, notes array<{NOTE}>"


def read_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All documents of a folder in one read; the schema is fixed, missing keys are null."""
    return spark.read.schema(DOCUMENT).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON, a folder for each content_type."""
    documents.write.mode("overwrite").partitionBy("content_type").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replaces the graph tables: nodes by label, edges by type."""
    nodes.withColumn("label", F.get("labels", F.lit(0))).write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def merge_graph(nodes: DataFrame, edges: DataFrame, path: str, parts: int = 256) -> None:
    """Merges nodes and edges into graph tables that are dealt into ``parts`` by document, and rewrites only the parts that they touch.

    A node counts as written after what the tables hold, so its load_seq must be larger; the result is that of ``merge_nodes`` over all loads. Edges are kept once each.
    The first two parts of an id name its document, so the nodes of one and their edges to others share a part. The first load gives the
    tables their number of parts; later ones must give the same.
    """
    spark = nodes.sparkSession
    of = lambda c: F.pmod(F.xxhash64(F.substring_index(c, ".", 2)), F.lit(parts)).cast("int")
    for name, rows, key, merged in (("nodes", nodes.select(*NODE_COLUMNS), "id", merge_nodes), ("edges", edges.select(*EDGE_COLUMNS), "src", lambda df: df.distinct())):
        rows = cut(rows.where(F.col(key).isNotNull()))
        touched = [r.part for r in rows.select(of(key).alias("part")).distinct().collect()]  # ``parts`` at most
        try:
            old = spark.read.parquet(f"{path}/{name}").where(F.col("part").isin(touched))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            old = None
        if old is not None:
            rows = cut(old.select(*rows.columns).unionByName(rows))  # Spark does not overwrite what it reads
        merged(rows).withColumn("part", of(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes").select(*NODE_COLUMNS), spark.read.parquet(f"{path}/edges").select(*EDGE_COLUMNS)


def save_sessions(memory: DataFrame) -> DataFrame:
    """(session_id, state): the memory of each session as JSON."""
    return memory.select("session_id", F.to_json(F.struct("buffer", "notes")).alias("state"))


def load_sessions(wanted: DataFrame, saved: DataFrame) -> DataFrame:
    """(session_id, buffer, notes) of the wanted sessions; those that were not saved, or not readably, are empty."""
    rows = wanted.select("session_id").join(saved, "session_id", "left").select("session_id", F.from_json("state", f"struct<{STATE.replace(' array', ':array')}>").alias("s"))
    empty = lambda c, kind: F.coalesce(F.col(f"s.{c}"), F.array().cast(f"array<{kind}>")).alias(c)
    return rows.select("session_id", empty("buffer", MESSAGE), empty("notes", NOTE))
