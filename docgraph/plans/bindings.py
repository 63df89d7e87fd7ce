"""The driver tables seen as documents, graphs, links and sessions; each with the same thing as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ids import to_roman
from ..operators.graph import build_edges, build_nodes


#: Schemas of tables by application and path, so that a table read many times in one query has its footers read once.
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def items(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Line items, one for each order and line number (the table repeats some); with ``parts`` dealt by order into so many."""
    least = [F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")]
    rows = table(spark, sf_dir, "lineitem")
    return (rows if parts is None else rows.repartition(parts, "l_orderkey")).groupBy("l_orderkey", "l_linenumber").agg(*least)


ITEMS_SQL = """(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag,
  min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey, l_linenumber) lineitem"""


def over_items(sql: str) -> str:
    """SQL over lineitem as SQL over ``items``."""
    return sql.replace("FROM lineitem", f"FROM {ITEMS_SQL}").replace("JOIN lineitem", f"JOIN {ITEMS_SQL}")


def text_id(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- the hierarchy: root, region, nation, customer, order, line item ------------------------------------------


def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    root = spark.range(1).select(F.lit("ROOT").alias("id"), F.lit("Root").alias("name"))
    regions = t("region").select(text_id("R.", c("r_regionkey")).alias("id"), c("r_name").alias("name"), c("r_regionkey").alias("number"))
    nations = t("nation").select(text_id("R.", c("n_regionkey"), ".N.", c("n_nationkey")).alias("id"), c("n_name").alias("name"), c("n_nationkey").alias("number"))
    customers = t("customer").select(text_id("C.", c("c_custkey")).alias("id"), c("c_name").alias("name"), c("c_custkey").alias("number"))
    orders = t("orders").select(
        text_id("C.", c("o_custkey"), ".", c("o_orderkey")).alias("id"), F.concat("o_orderstatus", F.lit(" "), "o_orderpriority").alias("text"),
        c("o_orderkey").alias("number"), F.lit(0).alias("sub_level"),
    )
    own = t("orders").select("o_orderkey", "o_custkey")
    lines = items(spark, sf_dir).join(own, c("l_orderkey") == c("o_orderkey")).select(
        text_id("C.", c("o_custkey"), ".", c("o_orderkey"), ".", c("l_linenumber")).alias("id"),
        text_id(c("l_returnflag"), c("l_linestatus"), " part ", c("l_partkey")).alias("text"), c("l_linenumber").alias("number"), F.lit(1).alias("sub_level"),
    )
    nodes = build_nodes(root, "Act")
    for rows, label in ((regions, "Chapter"), (nations, "Chapter_Section"), (customers, "Article"), (orders, "Paragraph"), (lines, "Paragraph")):
        nodes = nodes.unionByName(build_nodes(rows, label))
    return nodes


NODES_SQL = """nodes AS (
  SELECT 'ROOT' AS id, 'Act' AS label, 'Root' AS name, NULL::VARCHAR AS text, NULL::VARCHAR AS number, NULL::INT AS sub_level
  UNION ALL SELECT 'R.' || r_regionkey, 'Chapter', r_name, NULL, r_regionkey::VARCHAR, NULL FROM region
  UNION ALL SELECT 'R.' || n_regionkey || '.N.' || n_nationkey, 'Chapter_Section', n_name, NULL, n_nationkey::VARCHAR, NULL FROM nation
  UNION ALL SELECT 'C.' || c_custkey, 'Article', c_name, NULL, c_custkey::VARCHAR, NULL FROM customer
  UNION ALL SELECT 'C.' || o_custkey || '.' || o_orderkey, 'Paragraph', NULL, o_orderstatus || ' ' || o_orderpriority, o_orderkey::VARCHAR, 0 FROM orders
  UNION ALL SELECT 'C.' || o_custkey || '.' || o_orderkey || '.' || l_linenumber, 'Paragraph', NULL,
    l_returnflag || l_linestatus || ' part ' || l_partkey, l_linenumber::VARCHAR, 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def contains_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child, ord); customers of nations that are no key of nation hang off nothing."""
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    pair = lambda df, parent, child, order: df.select(parent.alias("parent"), child.alias("child"), order.cast("int").alias("ord"))
    nations = t("nation")
    lines = items(spark, sf_dir).join(t("orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    order_id = text_id("C.", c("o_custkey"), ".", c("o_orderkey"))
    nation_id = text_id("R.", c("n_regionkey"), ".N.", c("n_nationkey"))
    parts = [
        pair(t("region"), F.lit("ROOT"), text_id("R.", c("r_regionkey")), c("r_regionkey")),
        pair(nations, text_id("R.", c("n_regionkey")), nation_id, c("n_nationkey")),
        pair(t("customer").join(nations, c("c_nationkey") == c("n_nationkey")), nation_id, text_id("C.", c("c_custkey")), c("c_custkey")),
        pair(t("orders"), text_id("C.", c("o_custkey")), order_id, c("o_orderkey")),
        pair(lines, order_id, F.concat(order_id, F.lit("."), c("l_linenumber").cast("string")), c("l_linenumber")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


PAIRS_SQL = """pairs AS (
  SELECT 'ROOT' AS parent, 'R.' || r_regionkey AS child, r_regionkey::BIGINT AS ord FROM region
  UNION ALL SELECT 'R.' || n_regionkey, 'R.' || n_regionkey || '.N.' || n_nationkey, n_nationkey FROM nation
  UNION ALL SELECT 'R.' || n_regionkey || '.N.' || n_nationkey, 'C.' || c_custkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'C.' || o_custkey, 'C.' || o_custkey || '.' || o_orderkey, o_orderkey FROM orders
  UNION ALL SELECT 'C.' || o_custkey || '.' || o_orderkey, 'C.' || o_custkey || '.' || o_orderkey || '.' || l_linenumber, l_linenumber
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONTAINS edges of the hierarchy, and REFERENCES of orders to the customer whose key their total price gives."""
    contains = contains_pairs(spark, sf_dir).select(F.col("parent").alias("src"), F.col("child").alias("dst"), "ord")
    return build_edges(contains, "CONTAINS").unionByName(build_edges(order_references(spark, sf_dir), "REFERENCES"))


def order_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    c = F.col
    return orders.select(
        text_id("C.", c("o_custkey"), ".", c("o_orderkey")).alias("src"),
        text_id("C.", F.floor(c("o_totalprice")).cast("long") % 200).alias("dst"), F.lit("articles").alias("ref_kind"),
    )


REFS_SQL = """refs AS (
  SELECT 'C.' || o_custkey || '.' || o_orderkey AS src, 'C.' || (floor(o_totalprice)::BIGINT % 200) AS dst FROM orders)"""

# --- citations, links and indented blocks, from line items ----------------------------------------------------

_KINDS = ("article", "chapter", "section", "annex", "recital")


def citation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, context): what follows a link, in five forms."""
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    forms = [
        text_id(" (", n, ") to (", n + s % 4, "), points (a), (b) and (c)"),
        text_id(" referred to in points ", n, " to ", n + 3, "; point ", p % 9),
        text_id(" points ", n, ", ", n + 1, " and ", n + 2, " or (", p % 5, ")(d)"),
        text_id(" of ", p),
        text_id(" (", n + 4, ") to (", n, "), point (", s % 7, ") and points (x)"),
    ]
    form = F.get(F.array(*forms), (F.col("l_orderkey") % 5).cast("int"))
    return items(spark, sf_dir).select(text_id(F.col("l_orderkey"), ".", n).alias("id"), form.alias("context"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, src_id, ord, href, text, before, after): a link for each line item, five kinds, some repeated in an order."""
    n = (F.col("l_partkey") % 12 + 1).cast("string")
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 5).cast("int"))
    text = F.concat(F.initcap(kind), F.lit(" "), n)
    trail = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit(" ("), F.col("l_linenumber").cast("string"), F.lit(")(a)"))).otherwise(F.lit(", Sections 1, 2 and 3"))
    rows = items(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), text_id("O.", F.col("l_orderkey")).alias("src_id"), F.col("l_linenumber").cast("long").alias("ord"),
        F.concat(F.lit("https://x.example/"), kind, F.lit("/"), n, F.lit("/")).alias("href"), text.alias("text"), F.lit("see").alias("before"),
        F.concat(text, trail).alias("after"),
    )
    return rows


LINKS_SQL = """links AS (
  SELECT doc_id, src_id, ord, 'https://x.example/' || kind || '/' || n || '/' AS href, kind, n,
         upper(kind[1]) || kind[2:] || ' ' || n AS text, trail, sup
  FROM (SELECT l_orderkey AS doc_id, 'O.' || l_orderkey AS src_id, l_linenumber::BIGINT AS ord, l_partkey % 12 + 1 AS n, l_suppkey AS sup,
      ['article', 'chapter', 'section', 'annex', 'recital'][(l_orderkey + l_linenumber) % 5 + 1] AS kind,
      CASE WHEN l_suppkey % 3 = 0 THEN ' (' || l_linenumber || ')(a)' ELSE ', Sections 1, 2 and 3' END AS trail FROM lineitem))"""


def indented_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, tag, style, text): the line items of an order as indented blocks, some without a marker."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    level = (n * 7 + p) % 3
    style = F.when(level > 0, text_id("padding-left: ", level * 40, "px"))
    text = F.when(p % 4 == 0, text_id("(", F.substring(F.lit("abcdefg"), 1, 1), ") item ", p)).when(p % 4 == 1, text_id(n, ". item ", p)).otherwise(text_id("item ", p))
    return items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), n.alias("pos"), F.lit("p").alias("tag"), style.alias("style"), text.alias("text"))


BLOCKS_SQL = """blocks AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS pos, ((l_linenumber * 7 + l_partkey) % 3)::INT AS level,
    CASE l_partkey % 4 WHEN 0 THEN '(a) item ' || l_partkey WHEN 1 THEN l_linenumber || '. item ' || l_partkey ELSE 'item ' || l_partkey END AS text,
    CASE l_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN l_linenumber::VARCHAR END AS own
  FROM lineitem),
parented AS (
  SELECT b.*, (SELECT max(x.pos) FROM blocks x WHERE x.doc_id = b.doc_id AND x.pos < b.pos AND x.level < b.level) AS parent_pos FROM blocks b),
marked AS (
  SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id, parent_pos ORDER BY pos ROWS UNBOUNDED PRECEDING), '0') AS marker FROM parented)"""

# --- pages of a corpus, from orders, line items and nations ------------------------------------------------------

_SITE = "https://x.example"


def _link(kind: str, number: Column, text: Column) -> Column:
    return F.concat(F.lit(f'<a href="{_SITE}/{kind}/'), number.cast("string"), F.lit('/">'), text, F.lit("</a>"))


def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): orders as articles and recitals with a paragraph a line item, nations as annexes with two sections."""
    k, n, p, s = (F.col(c) for c in ("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    numbered = lambda name, x: text_id(name, x)
    target, annex, chapter, recital = p % 50 + 1, p % 25 + 1, p % 7 + 1, p % 50 * 5
    forms = [
        F.concat(F.lit(" see "), _link("article", target, numbered("Article ", target)), text_id(" (", n, ")(a), (b) and so on.")),
        F.concat(F.lit(" see "), _link("annex", annex, F.concat(F.lit("Annex "), to_roman(annex))), F.lit(" for it.")),
        F.concat(F.lit(" see Sections 1 and 2 of "), _link("chapter", chapter, F.concat(F.lit("Chapter "), to_roman(chapter))), F.lit(", all.")),
        F.concat(F.lit(" see "), _link("recital", recital, numbered("Recital ", recital)), F.lit(".")),
        F.concat(F.lit(" see "), _link("article", target, numbered("Article ", target)), text_id(" (", n, ") to (", n + 1, ").")),
        F.lit(""),
    ]
    body = text_id("<p>", n, ". item ", p)
    for f, form in enumerate(forms):
        body = F.concat(body, F.when(p % 6 == f, form).otherwise(F.lit("")))
    other = s % 50 * 5
    indented = '<p style="padding-left: 40px">'
    sub = F.concat(F.lit(f"</p>{indented}(a) sub "), s.cast("string"), F.lit(f"</p>{indented}Related: "), _link("recital", other, numbered("Recital ", other)), F.lit("</p>"))
    # Line items are dealt by order once, into many parts, as pages come in many files: then whole pages need not be moved.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").repartition(parts, "o_orderkey").join(items(spark, sf_dir, parts), F.col("l_orderkey") == k)
    rows = rows.select(k, n, F.concat(body, F.when((s % 4 == 0) & (k % 5 > 0), sub).otherwise(F.lit("</p>"))).alias("block"))
    blocks = rows.groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "block"))), lambda x: x["block"]), "\n").alias("blocks"))
    c, q = k % 7 + 1, k % 3 + 1
    meta = F.concat(
        F.lit('<p class="meta">'), _link("chapter", c, F.concat(F.lit("Chapter "), to_roman(c), F.lit(": Part "), c.cast("string"))),
        F.when(k % 2 == 0, _link("section", q, text_id("Section ", q, ": Piece"))).otherwise(F.lit("")), F.lit("</p>"),
    )
    title = F.when(k % 5 == 0, numbered("Recital ", k)).otherwise(numbered("Article ", k))
    lettered = F.when((k % 3 == 0) & (k % 5 > 0), F.lit("<p>(a) letter text</p>")).otherwise(F.lit(""))
    page = F.concat(F.lit("<html><body><nav>Home</nav><article><h1>"), title, F.lit("</h1>"), F.when(k % 5 > 0, meta).otherwise(F.lit("")), lettered, "blocks", F.lit("</article></body></html>"))
    orders = blocks.select(k.alias("page_id"), text_id(f"{_SITE}/page/", k).alias("url"), page.alias("html"))
    m = F.col("n_nationkey")
    annexes = table(spark, sf_dir, "nation").select(
        (-1 - m).alias("page_id"), text_id(f"{_SITE}/annex/", m + 1).alias("url"),
        F.concat(
            F.lit("<article><h1>Annex "), to_roman(m + 1), F.lit("</h1><h3>Section A first</h3><p>1. of "), "n_name", F.lit("</p><p>more</p><h3>Section B second</h3><p>1. last</p></article>")
        ).alias("html"),
    )
    return orders.unionByName(annexes)


# --- lines of documents, and sessions ---------------------------------------------------------------------------


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, text): the lines of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


LINES_SQL = """lines AS (
  SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1)::INT - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, turn, id, role, content, ts): eight conversations make a session; a message a minute."""
    at = F.col("conv_id") * 100 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 8).cast("string").alias("session_id"), at.alias("turn"), text_id("m", at).alias("id"), "role",
        F.col("text").alias("content"), (at * 60).cast("double").alias("ts"),
    )


MESSAGES_SQL = """messages AS (
  SELECT (conv_id // 8)::VARCHAR AS session_id, conv_id * 100 + turn AS turn, 'm' || (conv_id * 100 + turn) AS id, role, text AS content,
         ((conv_id * 100 + turn) * 60)::DOUBLE AS ts FROM conversations)"""
