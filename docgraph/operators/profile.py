"""Schema profile of the graph: what labels, properties and relationships it has, as tables and as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .endpoints import EndpointJoins

#: Names of types in the profile.
TYPE_NAMES = {"string": "str", "int": "int", "bigint": "int", "float": "float", "double": "float", "boolean": "bool"}
#: Fixed orders of labels and relationships in the text.
NODE_ORDER = ("Act", "EmbeddingNode", "Chapter", "Article", "Paragraph", "Chapter_Section", "Annex", "Annex_Section", "Recital")
TYPE_ORDER = ("CONTAINS", "NEXT", "REFERENCES")
START_ORDER = {
    "CONTAINS": NODE_ORDER,
    "NEXT": ("Chapter", "EmbeddingNode", "Article", "Paragraph", "Chapter_Section", "Annex", "Annex_Section", "Recital"),
    "REFERENCES": ("EmbeddingNode", "Paragraph", "Chapter", "Article", "Annex", "Recital", "Chapter_Section", "Annex_Section", "Act"),
}
END_ORDER = {
    "CONTAINS": ("Chapter", "EmbeddingNode", "Annex", "Recital", "Article", "Paragraph", "Chapter_Section", "Annex_Section", "Act"),
    "NEXT": START_ORDER["NEXT"],
    "REFERENCES": ("EmbeddingNode", "Recital", "Annex", "Paragraph", "Article", "Chapter", "Chapter_Section", "Annex_Section", "Act"),
}


def _type_name(kind: str) -> str:
    return "tuple" if kind.startswith("array") else "dict" if kind.startswith("map") else TYPE_NAMES.get(kind, kind.lower())


def _properties(rows: DataFrame, key: str, skip: set[str]) -> DataFrame:
    """(key, property, n): how many rows of each key have each property; 0 for none of them."""
    names = [c for c in rows.columns if c not in skip]
    counted = rows.groupBy(key).agg(*[F.count(F.col(c)).alias(c) for c in names])
    kinds = dict(rows.dtypes)
    stacked = F.array(*[F.struct(F.lit(c).alias("property"), F.lit(_type_name(kinds[c])).alias("type"), F.col(c).alias("n")) for c in names])
    return counted.select(key, F.inline(stacked))


def node_property_types(nodes: DataFrame) -> DataFrame:
    """(label, property, types, n): the properties that nodes of each label have, and on how many of them."""
    rows = nodes.select(F.explode("labels").alias("label"), *[c for c in nodes.columns if c != "labels"])
    found = _properties(rows, "label", {"label", "load_seq"}).where("n > 0")
    return found.groupBy("label", "property").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("n").alias("n"))


def edge_property_types(edges: DataFrame) -> DataFrame:
    """(type, property, types, n) of edges."""
    found = _properties(edges.withColumnRenamed("type", "edge_type"), "edge_type", {"edge_type", "src", "dst"}).where("n > 0")
    return found.groupBy(F.col("edge_type").alias("type"), "property").agg(F.array_sort(F.collect_set(found["type"])).alias("types"), F.sum("n").alias("n"))


def relationship_patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(start_label, type, end_label, n): label patterns of edges, over all labels of both ends.

    Edges are counted by label sets first, so only a handful of rows is unfolded. Nodes of very many edges hold up no task.
    """
    labels = nodes.select("id", F.array_sort("labels").alias("l")).distinct()
    ends = EndpointJoins(edges.select("src", "type", "dst"), "src", "dst")
    rows = ends.join(ends.rows, labels.select(F.col("id").alias("src"), F.col("l").alias("ls")), "src")
    rows = ends.join(rows, labels.select(F.col("id").alias("dst"), F.col("l").alias("ld")), "dst")
    sets = rows.groupBy("ls", "type", "ld").agg(F.count("*").alias("n"))
    rows = sets.select(F.explode("ls").alias("start_label"), "type", "ld", "n").select("start_label", "type", F.explode("ld").alias("end_label"), "n")
    return rows.groupBy("start_label", "type", "end_label").agg(F.sum("n").alias("n"))


def index_summary(nodes: DataFrame) -> DataFrame:
    """(labels, property, n): the property coverage of each combination of labels, joined by " + "."""
    combo = F.when(F.size("labels") > 0, F.array_join(F.array_sort("labels"), " + ")).otherwise("<no label>")
    rows = nodes.withColumn("combo", combo).drop("labels")
    return _properties(rows, "combo", {"combo", "load_seq"}).select(F.col("combo").alias("labels"), "property", "n")


def _rank(column: str, order: tuple[str, ...]) -> Column:
    places = F.create_map(*[x for k, v in enumerate(order) for x in (F.lit(v), F.lit(k))])
    return F.coalesce(F.element_at(places, F.col(column)), F.lit(len(order)))


def _by_type(column: str, orders: dict[str, tuple[str, ...]]) -> Column:
    ranks = [F.when(F.col("type") == kind, _rank(column, order)) for kind, order in orders.items()]
    return F.coalesce(*ranks, _rank(column, NODE_ORDER))


def render_schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line_no, line): the profile as text, in the fixed orders, then by name."""

    def lines(part: int, rank: Column, name: Column, line: Column, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(part).alias("part"), rank.alias("rank"), name.alias("name"), line.alias("line"))

    spark = nodes.sparkSession
    heads = spark.createDataFrame(
        [(0, "Node properties are the following:"), (2, ""), (3, "Relationship properties are the following:"), (5, ""), (6, "The relationships are the following:")],
        "part int, line string",
    ).select("part", F.array(F.lit(0)).alias("rank"), F.lit("").alias("name"), "line")
    pair = lambda: F.concat(F.lit("{'property': '"), F.col("property"), F.lit("', 'type': '"), F.array_min("types"), F.lit("'}"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("property", "pair"))), lambda x: x["pair"]), ", "), F.lit("]"))
    own = node_property_types(nodes).withColumn("pair", pair()).groupBy("label").agg(listed.alias("props"))
    own = lines(1, F.array(_rank("label", NODE_ORDER)), F.col("label"), F.concat(F.lit("Node name: '"), "label", F.lit("', Node properties: "), "props"), own)
    rel = edge_property_types(edges).withColumn("pair", pair()).groupBy("type").agg(listed.alias("props"))
    rel = lines(4, F.array(F.lit(0)), F.col("type"), F.concat(F.lit("Relationship name: '"), "type", F.lit("', Relationship properties: "), "props"), rel)
    pattern = relationship_patterns(nodes, edges)
    rank = F.array(_rank("type", TYPE_ORDER), _by_type("start_label", START_ORDER), _by_type("end_label", END_ORDER))
    text = F.concat(F.lit("(:"), "start_label", F.lit(")-[:"), "type", F.lit("]->(:"), "end_label", F.lit(")"))
    pattern = lines(7, rank, F.concat_ws("\u0001", "start_label", "type", "end_label"), text, pattern)
    every = reduce(DataFrame.unionByName, [heads, own, rel, pattern])
    return every.select(F.row_number().over(Window.orderBy("part", "rank", "name")).alias("line_no"), "line")
