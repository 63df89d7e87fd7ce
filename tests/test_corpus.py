"""From pages to a stored graph, embeddings, traces and the parts of memory that no SQL covers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.operators import embedding, hierarchy, memory, references, trace, traversal
from docgraph.operators.graph import EDGE_COLUMNS, NODE_COLUMNS, merge_nodes
from docgraph.plans.corpus import Corpus, corpus_graph
from docgraph.sources import documents, pages

SITE = "https://x.example"
PAGES = {
    1: f'<p class="meta"><a href="{SITE}/chapter/3/">Chapter III: Duties</a></p><p>1. First, see <a href="{SITE}/annex/2/">Annex II</a>.</p><p>2. Second, see <a href="{SITE}/article/2/">Article 2</a>(1)(a) and (b).</p>'
    f'<p style="padding-left: 40px">(a) sub</p><p style="padding-left: 40px">Related: <a href="{SITE}/recital/7/">Recital 7</a></p><p>2. goes on with <a href="{SITE}/article/2/">Article 2</a> (1).</p><p>[*] a note</p>',
    2: f'<p>1. Only</p><p>(a) lettered, by Sections 1 and 2 of <a href="{SITE}/chapter/3/">Chapter III</a></p>',
}
TITLES = {1: "Article 1", 2: "Article 2", 3: "Annex II", 4: "Recital 7", 5: "About us"}


@pytest.fixture(scope="module")
def graph(spark):
    bodies = PAGES | {3: "<h3>Section A first</h3><p>1. x</p>", 4: "<p>whereas</p><p>[1] note</p>", 5: "<p>x</p>"}
    rows = [(i, f"{SITE}/{i}", f"<article><h1>{TITLES[i]}</h1>{body}</article>") for i, body in bodies.items()]
    return corpus_graph(spark.createDataFrame([*rows, (6, "u", None), (7, "v", "<div>no container</div>")], "page_id long, url string, html string"))


def test_corpus_graph(graph):
    nodes, edges = graph
    got = {r.id: r.text for r in nodes.collect()}
    assert got["Art.1.2"] == "2. Second, see Article 2(1)(a) and (b). 2. goes on with Article 2 (1)." and got["Art.1.2.a"] == "(a) sub" and set(got) >= {"Annex.II.Sect.A.1", "recital7_p1", "ChaptIII", "Rec.7"}
    assert not any("note" in (t or "") for t in got.values())
    refs = {(r.src, r.ref_kind, r.dst) for r in edges.where("type = 'REFERENCES'").collect()}
    assert ("Art.1.1", "annexes", "Annex.II") in refs and ("Art.1.2.a", "recitals", "Rec.7") in refs and ("Art.1", "recitals", "Rec.7") in refs
    assert ("Art.1.2", "articles_paragraph", "Art.2.1") in refs
    assert {(r.src, r.dst) for r in edges.where("type = 'CONTAINS'").collect()} >= {("ChaptIII", "Art.1"), ("Art.1", "Art.1.2"), ("Art.1.2", "Art.1.2.a"), ("Annex.II", "Annex.II.Sect.A")}


def test_whole_graph_has_an_act_and_vectors(spark):
    rows = [(i, f"{SITE}/{i}", f"<article><h1>{title}</h1>{body}</article>") for i, title, body in (
        (1, "Article 1", '<p class="meta"><a href="/chapter/3/">Chapter III: Duties</a></p><p>1. one</p><p style="padding-left: 40px">(a) sub</p>'), (2, "Article 2", "<p>x</p>"),
        (3, "Annex II", "<h3>Section A first</h3><p>1. x</p><h3>Section B second</h3><p>1. y</p>"), (4, "Recital 7", "<p>whereas</p>"), (5, "Recital 8", "<p>whereas</p>"))]
    corpus = Corpus(spark.createDataFrame(rows, "page_id long, url string, html string"))
    edges = {(r.src, r.type, r.dst) for r in corpus.whole_edges().collect()}
    assert edges >= {("Act", "CONTAINS", x) for x in ("ChaptIII", "Annex.II", "Rec.7", "Rec.8")} and ("Act", "CONTAINS", "Art.1") not in edges
    assert edges >= {("Art.1", "NEXT", "Art.2"), ("Rec.7", "NEXT", "Rec.8"), ("Annex.II.Sect.A", "NEXT", "Annex.II.Sect.B")}
    embedder = embedding.hashing_embedder(32)
    for parent_context, text in ((False, "(a) sub"), (True, "1. one\n\n(a) sub")):
        nodes = {r.id: r for r in corpus.whole_nodes(name="The act", embedder=embedder, parent_context=parent_context).collect()}
        assert np.allclose(nodes["Art.1.1.a"].embed, embedder([text])[0]) and np.allclose(nodes["Act"].embed, embedder(["The act"])[0])
        assert all(r.embed is not None for r in nodes.values()) and len(nodes) == corpus.nodes.count() + 1
    assert "refs" not in vars(Corpus(corpus.pages)) and {r.id for r in Corpus(corpus.pages).whole_nodes().where("embed is null").collect()} == set(nodes)


def test_graph_and_documents_on_disk(spark, graph, tmp_path):
    nodes, edges = graph
    documents.write_graph(nodes, edges, str(tmp_path / "graph"))
    again = documents.read_graph(spark, str(tmp_path / "graph"))
    for before, after in zip(graph, again, strict=True):
        assert after.columns == before.columns and sorted(map(str, after.collect())) == sorted(map(str, before.collect()))
    parsed = {"article": {"name": "Article 1", "number": 1}, "paragraphs": [{"id": "Art.1.1", "text": "ä", "totalSubParagraphs": [{"id": "Art.1.1.a", "text": "b", "level": 1}], "level": 0}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps(parsed, indent=2))
    (tmp_path / "in" / "two.json").write_text(json.dumps({"recital": {"name": "Recital 2", "number": 2}, "paragraphs": []}, indent=2))
    rows = documents.read_documents(spark, str(tmp_path / "in"))
    assert rows.count() == 2 and rows.where("article.number = 1").select(F.col("paragraphs")[0]["totalSubParagraphs"][0]["text"]).first()[0] == "b"
    documents.write_documents(rows.withColumn("content_type", F.when(F.col("article").isNotNull(), "Article").otherwise("Recital")), str(tmp_path / "out"))
    back = documents.read_documents(spark, str(tmp_path / "out"), multi_line=False)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_a_second_load_rewrites_only_its_parts(spark, tmp_path):
    columns = lambda kinds: ", ".join(f"{c} {k}" for c, k in kinds.items())
    node = lambda doc, par, text, seq: (f"Art.{doc}.{par}", ["Paragraph"], None, text, str(par), seq % 3, None, seq)
    first = [node(d, p, f"t{d}", d) for d in range(300) for p in range(3)]
    second = [node(d, p, None if p == 1 else "new", 1000 + d) for d in (7, 300) for p in range(4)]
    edge = lambda rows: [(r[0], "NEXT", "Art.1.1", None, None) for r in rows]
    path = tmp_path / "graph"
    for rows in (first, second):
        written = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
        nodes, edges = spark.createDataFrame(rows, columns(NODE_COLUMNS)), spark.createDataFrame(edge(rows), columns(EDGE_COLUMNS))
        documents.merge_graph(nodes, edges, str(path), parts=50)
    kept = {f for f in path.rglob("*.parquet") if f.stat().st_mtime_ns == written.get(f)}
    assert len({f.parent for f in written} - {f.parent for f in kept}) <= 4 and len({f.parent for f in kept}) > 80
    nodes, edges = documents.read_graph(spark, str(path))
    whole = merge_nodes(spark.createDataFrame(first + second, columns(NODE_COLUMNS)))
    assert sorted(map(str, nodes.collect())) == sorted(map(str, whole.select(*nodes.columns).collect()))
    assert sorted(map(tuple, edges.collect()), key=str) == sorted(set(edge(first + second)), key=str)


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<article><h1>T</h1>\n<p>x</p></article>")
    rows = pages.read_pages(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].url.endswith("a.html") and rows[0].html.endswith("</article>")


def test_harvested_links_have_their_context(spark):
    far = "w " * 200
    html = f'<article><p>One. Before it, <b>near</b> <a href="/article/3/">Article 3</a>(1), to the end. {far}</p><p>{far}<a href="/annex/1/">Annex I</a> {far}</p></article>'
    blocks = pages.extract_blocks(spark.createDataFrame([(1, html)], "page_id long, html string"))
    links = {r.text: r for r in references.harvest_links(blocks).collect()}
    assert links["Article 3"].after.startswith("Article 3(1), to the end.") and "Before it," in links["Article 3"].before
    assert len(links["Annex I"].after) >= 300 and len(links["Annex I"].before) >= 150


@pytest.mark.parametrize("texts", [[], ["a b"], [None], ["a b", None, "c", "a b", ""], ["same"] * 5])
def test_embedded_texts(spark, texts):
    embed = embedding.hashing_embedder(8)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for run in (embedding.embed_text, embedding.embed_distinct):
        got = {r.id: r.embed for r in run(rows, embed).collect()}
        assert set(got) == set(range(len(texts)))
        for i, text in enumerate(texts):
            assert (got[i] is None) == (text is None)
            if text is not None:
                np.testing.assert_allclose(got[i], embed([text])[0], rtol=1e-6)
    assert all(r.embed is None for r in embedding.embed_text(rows, None).collect())


def test_merged_references_keep_the_first(spark):
    tree = spark.createDataFrame([(1, 0, None, "A.1"), (1, 1, None, "A.1"), (1, 2, None, "A.2"), (1, 3, None, "A.1")], "doc_id int, pos int, parent_pos int, id string")
    refs = [(1, 0, "article", "5", None, None, "Article 5", "u", 1), (1, 1, "article", "5", None, None, "Article 5", "u", 1), (1, 1, "article", "6", 2, ["a"], "Article 6", "u", 2), (1, 3, "article", "5", None, None, "Article 5", "u", 1)]
    refs = spark.createDataFrame(refs, "doc_id int, pos int, kind string, number string, paragraph int, points array<string>, text string, url string, ord int")
    got = sorted((r.id, r.number, r.ord) for r in hierarchy.merge_references(tree, refs).collect())
    assert got == [("A.1", "5", 1), ("A.1", "5", 1), ("A.1", "6", 2)]


def test_climbs_end_in_cycles_and_reach_deep_tops(spark):
    chain = [f"n{i:03}" for i in range(70)]
    edges = [(a, b) for a, b in zip(chain, chain[1:])] + [("x", "y"), ("y", "z"), ("z", "y"), ("z", "w")]
    nodes = spark.createDataFrame([(i, ["Paragraph"]) for i in [*chain, "x", "y", "z", "w"]], "id string, labels array<string>")
    frame = spark.createDataFrame([(a, "CONTAINS", b, 1) for a, b in edges], "src string, type string, dst string, ord int")
    starts = spark.createDataFrame([("n069",), ("w",), ("q",)], "id string")
    got = {r.id: r.top for r in traversal.top_level_paragraph(starts, nodes, frame).collect()}
    assert got["n069"] == "n000" and got["q"] == "q" and got["w"] in ("x", "y", "z")
    paths = traversal.contains_paths(spark.createDataFrame([("n000",)], "id string"), frame)
    assert max(len(r.path) for r in paths.collect()) == 70


def test_tool_results(spark):
    hits = json.dumps({"results": [{"id": "Art.1", "similarity": 0.98765}, {"id": "Art.2", "similarity": 0.5}]})
    walked = json.dumps({"node": {"id": "Art.1"}, "children": [{"id": "Art.1.1"}], "references": [{"id": "Rec.7"}]})
    rows = [("s", 1, "node_retrieval", "{}", hits), ("s", 2, "graph_traversal", "{}", walked), ("s", 3, None, "text", "no json"), ("s", 4, "other", "{}", hits), ("t", 1, "single_node_retriever", "{}", json.dumps({"node": {"id": "Art.9"}}))]
    steps = trace.flatten_trace(spark.createDataFrame(rows, "session_id string, step int, name string, arguments string, output string"))
    got = sorted((r.session_id, r.step, r.kind, r.place, r.id, r.similarity) for r in trace.tool_results(steps).collect())
    assert got == [
        ("s", 1, "hit", 1, "Art.1", "0.988"), ("s", 1, "hit", 2, "Art.2", "0.500"), ("s", 2, "child", 1, "Art.1.1", None), ("s", 2, "node", 1, "Art.1", None),
        ("s", 2, "reference", 1, "Rec.7", None), ("t", 1, "node", 1, "Art.9", None),
    ]


def test_messages_notes_scores_and_last_user(spark):
    chat = spark.createDataFrame([("s", "m1", "user", "hello there", 1.0), ("s", "m2", "assistant", "hi", 3.0)], "session_id string, id string, role string, content string, ts double")
    tools = spark.createDataFrame([("s", "t1", 2.0, "search", "{}", "found")], "session_id string, id string, ts double, name string, arguments string, result string")
    rows = memory.append_messages(chat, tools)
    assert [(r.turn, r.id, r.role, r.content) for r in rows.orderBy("turn").collect()] == [(1, "m1", "user", "hello there"), (2, "t1", "tool", "[tool:search] args={}\nresult=found"), (3, "m2", "assistant", "hi")]
    short = lambda older, ts: F.struct(F.concat(F.size(older).cast("string"), F.lit(" messages")).alias("text"), F.transform(older, lambda m: m["id"]).alias("turn_ids"), ts.alias("ts"))
    state = memory.reflect(rows, every=2, summarize=short)
    r = state.first()
    assert [n.text for n in r.notes] == ["1 messages"] and [m.id for m in r.buffer] == ["t1", "m2"] and r.reflections == 1
    assert [(p.turn, p.turns) for p in memory.reflection_points(rows, every=2).collect()] == [(3, 2)]
    assert [(p.turn, p.turns) for p in memory.reflection_points(rows, buffer_limit=2, every=99).collect()] == [(3, 2)]
    vector = "array<float>"
    full = state.select("session_id", F.transform("buffer", lambda m: m.withField("embed", F.array(F.lit(1.0), F.lit(0.0)).cast(vector))).alias("buffer"), F.transform("notes", lambda n: n.withField("embed", F.array(F.lit(0.0), F.lit(1.0)).cast(vector))).alias("notes"))
    queries = spark.createDataFrame([("s", 1, "found it", [1.0, 0.0]), ("s", 2, "found it", None)], f"session_id string, query_id int, query string, query_embed {vector}")
    got = {(x.query_id, x.kind, x.place): x.score for x in memory.score_candidates(full, queries, F.lit(3.0)).collect()}
    assert got[1, "msg", 2] == pytest.approx(0.95) and got[1, "note", 0] == pytest.approx(0.35) and got[2, "msg", 2] == pytest.approx(0.35)
    assert got[1, "msg", 1] == pytest.approx(0.6 + 0.35 * 2 ** (-1 / 1800) + 0.005)
    packed = spark.createDataFrame([("s", 1, [("msg", "assistant: hi")], 1)], "session_id string, query_id int, packed array<struct<kind:string,text:string>>, used int")
    held = memory.reflect(rows.where("role <> 'tool'"), every=99)
    assert [p.text for p in memory.ensure_last_user(packed, held, 3).first().packed] == ["assistant: hi", "user: hello there"]
    assert [p.text for p in memory.ensure_last_user(packed, held, 2).first().packed] == ["assistant: hi"]


def test_references_without_semicolon_stand_as_they_are(spark):
    html = f'<article><h1>A &amp; B&amp</h1><p>x &lt; y &ltz &#65; &#65 <a href="{SITE}/article/2/?a=1&copy=2">R&D &amp;amp</a></p></article>'
    rows = pages.extract_blocks(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).orderBy("pos").collect()
    assert [r.text for r in rows] == ["A & B&amp", "x < y &ltz A &#65 R&D &amp"] and rows[1].links[0].href.endswith("?a=1&copy=2")


def test_headers_of_titles_that_were_cut_off(spark):
    html = f'<article><h1>Article 1: A&ampnd</h1><p class="aia-summary">x&amp</p><a href="{SITE}/chapter/1/">no block</a></article>'
    head = pages.page_headers(pages.extract_blocks(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))).first()
    assert (head.name, head.summary) == ("Article 1: A&ampnd", "x&amp")


def test_texts_whose_words_cancel_out_have_a_direction(spark):
    embedder = embedding.hashing_embedder(16)
    words = [f"w{i}" for i in range(200)]
    alone = {w: embedder([w])[0] for w in words}
    a, b = next((x, y) for x in words for y in words if not (alone[x] + alone[y]).any())
    assert np.isclose(np.linalg.norm(embedder([f"{a} {b}"])[0]), 1) and not embedder([" "]).any()


def test_headers_of_pages_that_share_an_id(spark):
    page = lambda title, rest="": f"<article><h1>{title}</h1>{rest}</article>"
    rest = f'<p class="aia-summary">s</p><p><a href="{SITE}/chapter/1/">Chapter I: A</a><a href="{SITE}/chapter/2/">no</a></p>'
    rows = [(1, page("A")), (1, page("A")), (1, page("B", rest)), (None, page("C")), (2, "<p>none</p>"), (3, None)]
    heads = pages.headers_of_pages(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert sorted((r.doc_id or 0, r.name, r.summary, r.chapter and r.chapter.name, r.section) for r in heads) == [
        (0, "C", None, None, None), (1, "A", None, None, None), (1, "A", None, None, None), (1, "B", "s", "Chapter I: A", None)
    ]


def test_page_ids_that_reach_those_of_orders(spark, tmp_path):
    import duckdb

    import __spark_entry__

    con, source = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("orders", "lineitem", "nation"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{source}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS FROM '{source}/{name}.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (page_id + i * 1000000 AS page_id) FROM '{source}/pages.parquet', range(2) r(i)) TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet'")
    got = __spark_entry__.queries()["e05_page_headers"](spark, str(tmp_path)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(con.execute(__spark_entry__.oracle_sql()["e05_page_headers"]).fetchall(), key=key)
