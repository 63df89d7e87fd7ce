"""Prefix joins, joins of sets, the grid of queries and nodes, and questions to contexts, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators import embedding, graph, references, retrieval, similarity
from docgraph.operators.endpoints import EndpointJoins
from docgraph.plans.questions import question_contexts

LINK = "doc_id long, src_id string, ord long, href string, text string, before string, after string"


def test_contexts_meet_anchors_of_any_length(spark):
    choose = random.Random(8)
    kinds = ("article", "annex", "chapter", "recital")
    anchors = ["", "A", "Ar", "Article 1", "Article 12", "rticle 1", "1", "x Article 1", "Annex I", "I"]
    rows = []
    for k in range(200):
        text = choose.choice(anchors)
        rows.append((1, f"s{k % 4}", k, f"/{choose.choice(kinds)}/{k % 9}/", text, "", choose.choice(["", text, text + " (2)", "y " + text, "Article 12 and"])))
    links = spark.createDataFrame(rows + [(1, "s0", 900, "/article/1/", None, "", None)], LINK)
    refs = links.select(
        "src_id", T.link_kind(F.col("href")).alias("kind"), "ord", F.lit(0).alias("sub"), F.lit(1).alias("number"), F.lit(None).cast("int").alias("paragraph"),
        F.lit(None).cast("array<string>").alias("points"), F.lit(None).cast("string").alias("section"), "text", "after",
    )
    got = sorted((r.src_id, r.ord, r.ref_ord) for r in references.match_context_to_link(links, refs).collect())
    fits = lambda kind, text, after: after.startswith(text) or (text.endswith(after) if kind == "article" else after.endswith(text))
    kind_of = lambda href: href.split("/")[1]
    expected = [
        (l[1], l[2], r[2]) for l in rows for r in rows if l[1] == r[1] and kind_of(l[3]) == kind_of(r[3]) and kind_of(l[3]) in kinds and fits(kind_of(l[3]), l[4], r[6])
    ]
    assert got == sorted(expected)


def test_a_block_of_many_links_is_not_squared(spark):
    n = 20_000
    href, text = F.concat(F.lit("/article/"), F.col("id") % 300, F.lit("/")), F.concat(F.lit("Article "), F.col("id") % 300)
    links = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit("s").alias("src_id"), F.col("id").alias("ord"), href.alias("href"), text.alias("text"), F.lit("").alias("before"), F.concat(text, F.lit(" ("), F.col("id") % 7, F.lit(")")).alias("after"))
    rows = references.element_references(links)
    assert rows.count() == 2100 and rows.select("number", "paragraph").distinct().count() == 2100
    joined = references.match_context_to_link(references.first_links(links), references.parsed_links(links))
    assert joined.count() < 40_000  # "Article 1" begins "Article 12" too


def test_places_of_links_do_not_run_into_the_next_block(spark):
    blocks = spark.range(2).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.when(F.col("id") == 0, 15_000).otherwise(2).alias("n"))
    one = F.struct(F.lit("/article/1/").alias("href"), F.lit("x").alias("text"), F.lit("").alias("before"), F.lit("x").alias("after"))
    links = references.harvest_links(blocks.withColumn("links", F.array_repeat(one, F.col("n"))))
    assert links.select("ord").distinct().count() == 15_002


@pytest.mark.parametrize("strict", [True, False])
def test_paragraph_targets(spark, strict):
    paragraphs = [("article", "1", 0, "1. one"), ("article", "1", 1, "12. twelve"), ("article", "1", 2, "(b) b"), ("annex", "2", 0, "(b) annex b"), ("annex", "2", 1, "3. x")]
    refs = [(k, n, p, pts) for k, n in (("article", "1"), ("annex", "2"), ("recital", "1")) for p, pts in ((1, None), (12, None), (3, None), (1, ["b"]), (None, ["b"]), (9, None))]
    df = spark.createDataFrame(paragraphs, "kind string, number string, idx int, text string")
    rows = spark.createDataFrame(refs, "kind string, number string, paragraph int, points array<string>")
    for r in graph.resolve_paragraph_target(rows, df, strict).collect():
        prefix = f"({r.points[0]})" if r.points else str(r.paragraph)
        hits = [i for k, n, i, t in paragraphs if k == r.kind and n == r.number and t.startswith(prefix)]
        head = {"article": "Art.1", "annex": "Annex.II"}.get(r.kind)
        assert r.dst == (f"{head}.{min(hits) + 1}" if hits and (r.kind == "article" or not strict) else None), r


def test_sets_alike(spark):
    choose = random.Random(9)
    sets = {k: [f"t{choose.randrange(12)}" for _ in range(choose.randrange(0, 14))] for k in range(150)}
    long = [f"w{k}" for k in range(40)]
    sets |= {200 + k: choose.sample(long, 40 - k % 5) + [f"own{k}"] * (k % 3) for k in range(40)} | {300: None, 301: ["a", None, "a"], 302: ["a"]}
    df = spark.createDataFrame(list(sets.items()), "id long, elements array<string>")
    own = {k: frozenset(x for x in v or () if x is not None) for k, v in sets.items()}
    for threshold in (0.5, 0.75, 0.9, 1.0):
        classes, pairs = similarity.similar_sets(df, threshold)
        reps = {}
        for k in sorted(own):
            reps.setdefault(own[k], k)
        assert {(r.id, r.rep) for r in classes.collect()} == {(k, reps[v]) for k, v in own.items() if v}
        some = sorted((k, v) for v, k in reps.items() if v)
        expected = {(a, b) for a, x in some for b, y in some if a < b and len(x & y) / len(x | y) >= threshold}
        assert {(r.a, r.b) for r in pairs.collect()} == expected


def test_grid_of_queries_equals_one_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 6 if k % 9 else 4)] if k % 13 else ([] if k % 2 else None)) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, embed array<double>")
    queries = df.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    read = lambda: sorted((r.query_id, r["rank"], r.id, round(r.similarity, 9)) for r in retrieval.vector_topk(queries, df, 4).collect())
    one = read()
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 20)
    monkeypatch.setattr(retrieval, "PART", 30)
    monkeypatch.setattr(retrieval, "ROWS", 7)
    assert read() == one and len(one) > 200
    assert retrieval.vector_topk(queries.where("false"), df).count() == 0 == retrieval.vector_topk(queries, df.where("false")).count()


def test_questions_to_contexts(spark):
    rows = [("A", ["Article"], "Article A", None), ("A.1", ["Paragraph"], None, "red apples grow"), ("A.1.a", ["Paragraph"], None, "on trees"), ("A.2", ["Paragraph"], None, "blue fish swim")]
    texts = spark.createDataFrame(rows, "id string, labels array<string>, name string, text string")
    columns = [F.lit(None).cast(kind).alias(c) for c, kind in graph.NODE_COLUMNS.items() if c in ("number", "sub_level", "load_seq")]
    nodes = embedding.embed_text(texts.select("*", *columns), embedding.hashing_embedder())
    pairs = [("A", "CONTAINS", "A.1", None, 0), ("A", "CONTAINS", "A.2", None, 1), ("A.1", "CONTAINS", "A.1.a", None, 0), ("A.2", "REFERENCES", "A.1", "articles", None)]
    edges = spark.createDataFrame(pairs, ", ".join(f"{c} {k}" for c, k in graph.EDGE_COLUMNS.items()))
    questions = spark.createDataFrame([(1, "apples red"), (2, "where fish swim"), (3, "on trees"), (4, None)], "query_id long, text string")
    got = {r.query_id: r for r in question_contexts(questions, nodes, edges, 1, embedding.hashing_embedder()).collect()}
    assert {q: (r.id, r.context) for q, r in got.items()} == {1: ("A.1", "red apples grow\non trees"), 2: ("A.2", "blue fish swim"), 3: ("A.1.a", "red apples grow\non trees")}
    assert [(x.id, x.directions, x.text) for x in got[2].references] == [("A.1", ["outgoing"], "red apples grow\non trees")]


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_heavy_endpoints_hold_up_no_task(spark, how):
    rows = spark.range(40_000).select(
        F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 101 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 7001)).alias("dst")
    )
    table = spark.range(6_000).select(F.concat(F.lit("k"), "id").alias("dst")).unionByName(spark.createDataFrame([("hot",), ("idle",)], "dst string")).withColumn("label", F.length("dst"))
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        ends = EndpointJoins(rows, "dst", least_rows=1)
        assert [k for k, _ in ends.heavy["dst"]] == ["hot"]
        found = ends.join(ends.rows, table, "dst", how)
        dealt = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
        assert len(dealt) == 16 and dealt[-1] <= 3 * dealt[8]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plain = rows.join(table, "dst", how)
    assert found.columns == plain.columns and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert EndpointJoins(rows, "dst").heavy == {"dst": []} and EndpointJoins(rows.limit(0), "dst", least_rows=0).heavy == {"dst": []}
