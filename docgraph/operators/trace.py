"""Tables of agent traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import final_answer

TOOLS = ("node_retrieval", "graph_traversal", "single_node_retriever")


def answers(messages: DataFrame) -> DataFrame:
    """Adds answer: what follows FINAL:, else the whole content."""
    return messages.withColumn("answer", F.coalesce(final_answer(F.col("content")), F.col("content")))


def normalize_arguments(arguments: Column) -> Column:
    """A JSON object as a map of strings; anything else as {"input": raw}."""
    parsed = F.from_json(arguments, "map<string,string>")
    is_object = arguments.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(arguments).isNotNull()
    return F.when(is_object & parsed.isNotNull(), parsed).otherwise(F.create_map(F.lit("input"), arguments))


def flatten_trace(trace: DataFrame, tools: tuple[str, ...] = TOOLS) -> DataFrame:
    """(session_id, step, label, arguments, error): logged calls numbered in order of step, with their arguments as maps.

    A call without a name is an "Agent step"; a name that is no tool is an error.
    """
    order = Window.partitionBy("session_id").orderBy("step")
    known = F.col("name").isin(*tools)
    error = F.when(F.col("name").isNotNull() & ~known, F.concat(F.lit("Unknown tool '"), "name", F.lit("'.")))
    return trace.select(
        "session_id", F.row_number().over(order).alias("step"), F.coalesce("name", F.lit("Agent step")).alias("label"),
        normalize_arguments(F.col("arguments")).alias("arguments"), error.alias("error"), "output",
    )


#: What the tools answer: hits of a search, a node with its children and references, or a node alone.
_OUTPUT = "struct<results:array<struct<id:string,similarity:double>>,children:array<struct<id:string>>,references:array<struct<id:string>>,node:struct<id:string>>"


def tool_results(steps: DataFrame) -> DataFrame:
    """(session_id, step, label, kind, place, id, similarity): what the outputs of the steps of ``flatten_trace`` list, a row each.

    kind is hit (similarity to 3 digits, as text), child, reference or node. An output that is no JSON object lists nothing.
    """
    parsed = F.when(F.try_parse_json("output").isNotNull(), F.from_json("output", _OUTPUT))
    rows = steps.where("error is null").select("session_id", "step", "label", parsed.alias("o"))
    listed = lambda kind, ids, similarity=None: F.transform(
        ids, lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("place"), x["id"].alias("id"), (F.format_number(x["similarity"], 3) if similarity else F.lit(None).cast("string")).alias("similarity"))
    )
    none = F.array().cast("array<struct<kind:string,place:int,id:string,similarity:string>>")
    parts = [
        listed("hit", F.col("o.results"), True), listed("child", F.col("o.children")), listed("reference", F.col("o.references")),
        listed("node", F.when(F.col("o.node").isNotNull(), F.array("o.node"))),
    ]
    found = F.concat(*[F.coalesce(p, none) for p in parts])
    return rows.select("session_id", "step", "label", F.explode(found).alias("r")).select("session_id", "step", "label", "r.*")


def retrieval_lines(hits: DataFrame) -> DataFrame:
    """(query_id, rank, line): hits as "- id (similarity: 0.123)"."""
    return hits.select("query_id", "rank", F.concat(F.lit("- "), "id", F.lit(" (similarity: "), F.format_number("similarity", 3), F.lit(")")).alias("line"))


def summarize_hits(hits: DataFrame) -> DataFrame:
    """(query_id, summary): one sentence with the ids of a query's hits in order of rank."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ", ")
    return hits.groupBy("query_id").agg(F.concat(F.lit("The query returned these nodes "), listed, F.lit(".")).alias("summary"))
