"""What keeps disk, memory and time of a step in bounds."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgraph.operators import graph, hierarchy, references, retrieval, similarity, traversal
from docgraph.operators.checkpoints import cut
from docgraph.plans import bindings, queries
from docgraph.sources import pages

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cut_rows_are_compressed_columns(spark):
    rows = cut(spark.range(20_000).select("id", F.lit("a text that is like all others " * 10).alias("text")))
    folder = os.path.dirname(rows.inputFiles()[0].removeprefix("file:"))
    assert rows.count() == 20_000 and sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder)) < 20_000 * 310 // 10


def test_corpus_pages_are_not_moved_whole(spark):
    assert "Repartition" not in _plan(bindings.corpus_pages(spark, SMALL)).split("Aggregate")[0]



def test_best_hits_are_found_in_tiles():
    rng = np.random.default_rng(3)
    own, asked = rng.normal(size=(12_000, 8)), rng.normal(size=(1_500, 8))
    own[5_000:5_400] = own[0]  # ties across tiles
    rows = pa.RecordBatch.from_arrays([pa.array(rng.permutation(12_000)), pa.array(own.tolist(), pa.list_(pa.float32()))], names=["id", "embed"])
    tracemalloc.start()
    found = [b for b in retrieval._best(rows, np.arange(1_500), asked, 7)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    got = pa.Table.from_batches(found).to_pandas().groupby("query_id")["id"].apply(list)
    near = own.astype(np.float32).astype(float)
    ids = rows.column("id").to_numpy()
    for q in (0, 299, 1_499):
        cosine = near @ asked[q] / np.linalg.norm(near, axis=1)
        assert got[q] == [int(ids[i]) for i in np.lexsort((ids, -np.round(cosine, 9)))[:7]]


def test_citations_are_searched_once(spark):
    assert _plan(queries.QUERIES["r06_citations"](spark, SMALL)).count("regexp_extract_all") == 3
    links = bindings.links(spark, SMALL).limit(50)
    assert "regexp_extract_all" not in _plan(references.element_references(links))


def test_like_references_are_one_before_they_are_joined(spark, monkeypatch):
    monkeypatch.setattr(graph, "existing", lambda edges, nodes: edges)
    refs = spark.range(500).select(F.lit("Art.1").alias("src_id"), F.lit("article").alias("kind"), F.lit("2").alias("number"), F.lit(3).alias("paragraph"), F.lit(None).cast("array<string>").alias("points"), F.col("id").cast("string").alias("text"))
    told = spark.createDataFrame([("article", "2", 0, "1. a"), ("article", "2", 1, "3. b")], "kind string, number string, idx int, text string")
    assert [(r.src, r.dst, r.ref_kind) for r in graph.reference_edges(refs, told, None).collect()] == [("Art.1", "Art.2.2", "articles_paragraph")]


def test_edges_are_not_made_distinct_before_a_start_meets_them(spark):
    assert "Aggregate [src#" not in _plan(queries.QUERIES["t09_subgraph_edges"](spark, SMALL))


class _Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["t08_traverse", "w03_question_contexts"])
def test_nodes_of_many_neighbours_come_in_one_row(spark, monkeypatch, name):
    def asked(*args, most_neighbours=traversal.MOST_NEIGHBOURS, **more):
        raise _Asked(most_neighbours)

    monkeypatch.setattr(traversal, "traverse", asked)
    with pytest.raises(_Asked) as told:
        queries.QUERIES[name](spark, SMALL)
    assert told.value.args[0] > 1 << 31


def test_sets_are_not_shuffled_to_find_equal_ones(spark, monkeypatch):
    plans, real = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df: plans.append(_plan(df)) or real(df))
    rows = [(3, ["x"]), (5, ["x"]), (5, ["y", "z"]), (7, ["z", "y", "y"]), (8, None), (9, [])]
    classes, pairs = similarity.similar_sets(spark.createDataFrame(rows, "id long, elements array<string>"), 0.9)
    assert sorted((r.id, r.rep) for r in classes.collect()) == [(3, 3), (5, 3), (5, 5), (7, 5)] and pairs.isEmpty()
    assert not any("Aggregate [elements" in plan for plan in plans)


def test_lone_links_have_the_references_of_joined_ones_without_a_shuffle(spark):
    heads = ["/article/3/", "/annex/2/", "/annex/3/", "/chapter/4/", "/section/2/", "/recital/7/", "/article/x/", "/chapter/3/article/5/", "/other/"]
    words = ["Article 3", "Annex II", "Chapter IV", "Section 2", "", "see Annex III"]
    trails = ["", " (1)(a), (b) and so on", " (1) to (3), (2) and points (a) and (b)", ", Sections 1, 2 and 1", " points 2 to 4; point 3", " (1)(a), (1)(b), (1)"]
    rows = [(f"b{i}", i, h, w, before, w + t if k % 5 else t.strip()) for i, (k, h, w, t, before) in enumerate(
        (k, h, w, t, before) for h in heads for w in words for k, t in enumerate(trails) for before in ("of", "Sections 5 and 6 of"))]
    rows += [("null", len(rows), "/article/3/", None, None, None)]
    links = spark.createDataFrame(rows, "src_id string, ord long, href string, text string, before string, after string")
    lone = references.lone_references(links)
    assert "Exchange" not in _plan(lone)
    told = lambda df: sorted(
        ((r.src_id, r.ord, r.kind, r.number, r.paragraph, r.points, r.text, r.url) for r in df.collect()), key=lambda r: (r[0], r[1])
    )
    in_order = lambda df: [(r[0], *r[2:]) for r in told(df)]
    assert in_order(lone) == in_order(references.element_references(links)) and len(in_order(lone)) > 300
    mixed = links.withColumn("alone", F.col("ord") % 2 == 0)
    assert in_order(references.element_references(mixed)) == in_order(lone)


def test_runs_are_the_islands_of_siblings(spark, monkeypatch):
    texts = ["1. a", "b", "c", "2. d", "(a) e", "f", "1. g", "h", "1. i"]
    levels = [0, 0, 1, 0, 1, 1, 0, 2, 0]
    rows = [(d, i, f"padding-left: {40 * x}px" if x else None, t) for d in (1, 2) for i, (t, x) in enumerate(zip(texts[d:], levels[d:]))]
    tree = cut(hierarchy.assemble_hierarchy(spark.createDataFrame(rows, "doc_id long, pos int, style string, text string"), F.lit("D")))
    told = lambda df: sorted((r.doc_id, r.pos, r.id, r.parent_id, r.level, r.text, r.n_merged) for r in df.collect())
    assert "Window" not in _plan(hierarchy.merge_runs(tree))
    assert told(hierarchy.merge_runs(tree)) == told(hierarchy.merge_same_id(tree))
    monkeypatch.setattr(hierarchy, "MOST_RUNS", 0)
    assert told(hierarchy.merge_runs(tree)) == told(hierarchy.merge_same_id(tree)) and any(r[-1] > 1 for r in told(hierarchy.merge_runs(tree)))


def test_plain_pages_are_cut_up_as_the_html_parser_does(monkeypatch):
    rng = np.random.default_rng(5)
    bits = [
        "<p>", "</p>", '<p class="x y">', '<p style="padding-left: 40px">', '<a href="/article/3/">', "</a>", "Article 3", " (1); (b). ", "&amp;", "&lt", "& ", "<br/>", "<H1 ID=\"q\">",
        "</H1>", "<article>", "</article>", "\n", "<script>", "</script>", "<!-- x -->", " < ", "<a href=/x>", "<p class>", "</p x>", "<title>T", "</title>", '<a href="/a?x=1&amp;y=2">',
    ]
    texts = ["<article>" + "".join(rng.choice(bits[: 17 if i % 3 else len(bits)], rng.integers(1, 30))) + "</article>" for i in range(1500)] + ["", "text only", "<!doctype html>\n<article><p>a</p></article>\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["page_id", "html"])
    told = lambda: [r for c in ("article", "") for whole in (False, True) for b in pages._parse(c, whole)(iter([batch])) for r in b.to_pylist()]
    quick = told()
    assert sum(pages._plain_tags(t) is not None for t in texts) > 700
    monkeypatch.setattr(pages, "_plain_tags", lambda html: None)
    assert quick == told()


def test_starts_of_one_top_meet_its_text_once_and_last(spark):
    nodes = spark.createDataFrame([("A", ["Article"], "a")] + [(f"A.{i}", ["Paragraph"], f"t{i}") for i in range(9)] + [(f"A.0.{i}", ["Paragraph"], f"s{i}") for i in range(40)], "id string, labels array<string>, text string")
    nodes = nodes.withColumns({"name": F.lit(None).cast("string"), "number": F.lit(None).cast("string"), "embed": F.lit(None).cast("array<float>")})
    rows = [("A", "CONTAINS", f"A.{i}", i) for i in range(9)] + [("A.0", "CONTAINS", f"A.0.{i}", i) for i in range(40)] + [("A.1", "REFERENCES", f"A.0.{i}", None) for i in range(9)]
    edges = spark.createDataFrame(rows, "src string, type string, dst string, ord int")
    found = traversal.traverse(nodes.select("id").unionByName(spark.createDataFrame([("X",)], "id string")), nodes, edges, most=16, most_neighbours=4)
    whole = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "descendants" in line and "Relation" in line]
    assert whole and all("top#" in line and "Relation [id#" not in line for line in whole)  # texts are kept by top, not by start
    told = sorted((r.id, r.part, r.error, r.text, len(r.references or ()), len(r.children or ())) for r in found.collect())
    text = ["t0", *[f"s{i}" for i in range(40)]]
    parts = [("\n".join(text[16 * k : 16 * k + 16]), len(text[16 * k : 16 * k + 16]) - (k == 0)) for k in range(3)]
    assert [r[3::2] for r in told if r[0] == "A.0.20"] == [p for p in parts] and ("X", 0, "Node not found", None, 0, 0) in told
    assert sum(r[4] for r in told if r[0] == "A.1") == 9 * 3 and {r[3] for r in told if r[0] == "A.1"} <= {"t1", ""}


def test_alike_sets_move_only_what_is_compared(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = [sorted({f"w{x}" for x in rng.integers(0, 60, 14)}) for _ in range(12)]
    rows = [(i, [w for w in base[i % 12] if rng.random() > 0.05] + ([f"own{i}"] if i % 3 else [])) for i in range(90)]
    rows += [(200 + i, base[i]) for i in range(12)] + [(300 + i, base[i]) for i in range(6)] + [(400, []), (401, None)]
    exact = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))

    def check(rows):
        df = spark.createDataFrame(rows, "id long, elements array<string>")
        classes, pairs = similarity.similar_sets(df, 0.8)
        smallest = {}
        for i, e in rows:
            if e and i is not None:
                smallest[tuple(sorted(set(e)))] = min(i, smallest.get(tuple(sorted(set(e))), i))
        assert sorted((r.id or -1, r.rep) for r in classes.collect()) == sorted((i or -1, smallest[tuple(sorted(set(e)))]) for i, e in rows if e)
        reps = sorted((i, e) for e, i in smallest.items())
        wanted = {(i, j): exact(a, b) for k, (i, a) in enumerate(reps) for j, b in reps[k + 1 :] if exact(a, b) >= 0.8}
        got = {(r.a, r.b): r.similarity for r in pairs.collect()}
        assert len(got) == pairs.count() and got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-12 for k in got) and len(got) > 20

    check(rows)
    check(rows + [rows[0], rows[95], (None, base[0])])
    spelt = cut(spark.createDataFrame(rows, "id long, elements array<string>").where("size(elements) > 0").withColumn("digest", F.array_join("elements", " ")))
    known = cut(spelt.groupBy("digest").agg(F.min("id").alias("rep")).join(spelt.select("id", "digest"), "digest").withColumn("rows", F.lit(1)))
    assert "hashpartitioning" not in _plan(similarity._representatives(spelt, known))
    monkeypatch.setattr(similarity, "MOST_SENT", 0)
    monkeypatch.setattr(similarity, "_HASHED", 15)  # unlike elements of one hash
    check(rows)
