"""Hand-made graphs, hierarchies and references."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from docgraph.operators import graph, hierarchy, references, retrieval, traversal, trees
from docgraph.operators.checkpoints import cut

NODES = [
    ("root", ["Act"], "Act", None), ("C", ["Chapter"], "Chapter", None), ("A", ["Article"], "Article A", None), ("B", ["Article"], "Article B", None),
    ("A.1", ["Paragraph"], None, "one"), ("A.2", ["Paragraph"], None, "two"), ("A.9", ["Paragraph"], None, "nine"), ("A.10", ["Paragraph"], None, "ten"),
    ("A.1.a", ["Paragraph"], None, "a"), ("A.1.b", ["Paragraph"], None, "b"), ("B.1", ["Paragraph"], None, "b one"), ("X", ["Paragraph"], None, "x"), ("Y", ["Paragraph"], None, "y"),
]
EDGES = [
    ("root", "CONTAINS", "C", 0), ("C", "CONTAINS", "A", 0), ("C", "CONTAINS", "B", 1), ("A", "CONTAINS", "A.1", 0), ("A", "CONTAINS", "A.2", 1),
    ("A", "CONTAINS", "A.9", 2), ("A", "CONTAINS", "A.10", 3), ("A.1", "CONTAINS", "A.1.a", 0), ("A.1", "CONTAINS", "A.1.b", 1), ("B", "CONTAINS", "B.1", 0),
    ("B.1", "CONTAINS", "A.1.b", 0), ("X", "CONTAINS", "Y", 0), ("Y", "CONTAINS", "X", 0),
    ("A.1.a", "REFERENCES", "B", None), ("B", "REFERENCES", "A.1.a", None), ("A.1.a", "REFERENCES", "B", None), ("A.2", "REFERENCES", "gone", None),
]


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(i, labels, name, text, None, None, None, 0) for i, labels, name, text in NODES], ", ".join(f"{c} {k}" for c, k in graph.NODE_COLUMNS.items()))
    edges = spark.createDataFrame([(s, t, d, None, o) for s, t, d, o in EDGES], ", ".join(f"{c} {k}" for c, k in graph.EDGE_COLUMNS.items()))
    return nodes, edges


def ids_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_children_order(spark, small):
    rows = lambda by: [r.child for r in traversal.children(ids_of(spark, "A"), small[1], by).orderBy("place").collect()]
    assert rows("ord") == ["A.1", "A.2", "A.9", "A.10"]
    assert rows("id") == ["A.1", "A.10", "A.2", "A.9"]


def test_paths_end_at_cycles(spark, small):
    rows = traversal.contains_paths(ids_of(spark, "X", "A"), small[1]).collect()
    assert sorted(r.path for r in rows if r.root == "X") == [["X"], ["X", "Y"], ["X", "Y", "X"]]
    for r in rows:
        assert len(set(r.path[:-1])) == len(r.path[:-1])
    assert len([r for r in rows if r.root == "A"]) == 7


def test_text_in_order(spark, small):
    paths = traversal.contains_paths(ids_of(spark, "A", "C", "X"), small[1])
    texts = {r.root: r.text for r in traversal.assemble_text(paths, small[0]).collect()}
    assert texts["A"] == "Article A\none\na\nb\ntwo\nnine\nten"
    assert texts["C"] == "Chapter\nArticle A\none\na\nb\ntwo\nnine\nten\nArticle B\nb one\nb"
    assert texts["X"] == "x\ny"


def test_traverse(spark, small):
    rows = {r.id: r for r in traversal.traverse(ids_of(spark, "A.1.a", "nothing"), *small).collect()}
    assert rows["nothing"].error == "Node not found"
    own = rows["A.1.a"]
    assert own.text == "one\na\nb" and own.children == ["A.1.a", "A.1.b"]
    assert [(r.id, r.directions, r.text) for r in own.references] == [("B", ["incoming", "outgoing"], "Article B\nb one\nb")]


def test_merge_is_idempotent(spark, small):
    once = graph.merge_nodes(small[0])
    twice = graph.merge_nodes(small[0].unionByName(small[0].withColumn("load_seq", F.lit(1).cast("long"))))
    assert once.drop("load_seq").exceptAll(twice.drop("load_seq")).count() == 0 and once.count() == twice.count() == len(NODES)


def test_existing_edges(spark, small):
    kept = graph.existing(small[1].where("type = 'REFERENCES'"), small[0])
    assert sorted((r.src, r.dst) for r in kept.collect()) == [("A.1.a", "B"), ("B", "A.1.a")]


def test_lookup_and_topk(spark, small):
    found = {r.id: r for r in retrieval.lookup_nodes(ids_of(spark, "A", "none"), small[0]).collect()}
    assert found["A"].label == "Article" and found["none"].label is None
    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, []), (5, None), (6, [0.0, 1.0])], "id long, embed array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, embed array<float>")
    rows = retrieval.vector_topk(queries, nodes, 3).orderBy("rank").collect()
    assert [(r.query_id, r.id, round(r.similarity, 6)) for r in rows] == [(7, 1, 1.0), (7, 2, 1.0), (7, 3, 0.0)]


@pytest.mark.parametrize("deepest", [3, 40])
def test_hierarchy_equals_a_stack(spark, deepest):
    choose = random.Random(4)
    blocks, expected = [], {}
    for doc in range(40):
        stack, markers = [], {}
        for pos in range(choose.randint(1, 14) if deepest == 3 else 90):
            level, mark = choose.randint(0, deepest), choose.choice(["", "1. ", "(a) ", "(ii) "])
            blocks.append((doc, pos, "p", f"padding-left: {40 * level}px" if level else None, f"{mark}t{pos}"))
            while stack and stack[-1][0] >= level:
                stack.pop()
            parent = (stack[-1][1], stack[-1][2]) if stack else (None, f"D{doc}")
            own = {"": None, "1. ": "1", "(a) ": "a", "(ii) ": "ii"}[mark] or markers.get(parent[0], "0")
            markers[parent[0]] = own
            node = f"{parent[1]}.{own}"
            stack.append((level, pos, node))
            expected[doc, pos] = (parent[0], parent[1], node)
    df = spark.createDataFrame(blocks, "doc_id long, pos int, tag string, style string, text string")
    rows = hierarchy.assemble_hierarchy(df, F.concat(F.lit("D"), F.col("doc_id").cast("string"))).collect()
    assert {(r.doc_id, r.pos): (r.parent_pos, r.parent_id, r.id) for r in rows} == expected


def test_hierarchy_of_a_staircase_and_a_long_document(spark):
    stairs = [(1, k, "p", f"padding-left: {40 * k}px", f"{k}. x") for k in range(40)]
    long = [(2, k, "p", f"padding-left: {40 * (k % 3)}px", "(a) x") for k in range(30_000)]
    df = spark.createDataFrame(stairs + long, "doc_id long, pos long, tag string, style string, text string")
    rows = {(r.doc_id, r.pos): r for r in hierarchy.assemble_hierarchy(df, F.lit(None)).collect()}
    assert rows[1, 39].parent_pos == 38 and rows[1, 39].id == ".".join(map(str, range(40))) and rows[1, 39].level == 39
    assert len(rows) == 30_040 and rows[2, 29_999].parent_pos == 29_998 and rows[2, 29_999].id == "a.a.a"


def test_merge_joins_neighbours_only(spark):
    rows = [(1, 0, "1. a"), (1, 1, "more"), (1, 2, "2. b"), (1, 3, "1. c")]
    df = spark.createDataFrame([(d, p, "p", None, t) for d, p, t in rows], "doc_id long, pos int, tag string, style string, text string")
    merged = hierarchy.merge_same_id(hierarchy.assemble_hierarchy(df, F.lit("D"))).orderBy("pos").collect()
    assert [(r.id, r.text) for r in merged] == [("D.1", "1. a more"), ("D.2", "2. b"), ("D.1", "1. c")]


def test_sections(spark):
    rows = [(1, 0, "p", "before"), (1, 1, "h2", "Section A One"), (1, 2, "p", "x"), (1, 3, "h3", "Section B Two"), (1, 4, "p", "y"), (2, 0, "p", "alone")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, tag string, text string")
    got = hierarchy.split_sections(df).orderBy("doc_id", "pos").collect()
    assert [(r.text, r.section_no, r.section_key) for r in got] == [("before", 1, "A"), ("x", 1, "A"), ("y", 2, "B"), ("alone", None, None)]


def test_reference_join_has_no_cartesian_product(spark):
    links = spark.createDataFrame([(1, "s", 1, "/article/2/", "Article 2", "", "Article 2 (3)(a)")], "doc_id long, src_id string, ord long, href string, text string, before string, after string")
    rows = references.element_references(links)
    assert [(r.kind, r.number, r.paragraph, r.points) for r in rows.collect()] == [("article", "2", 3, ["a"])]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def random_tree(n, seed, chain=0):
    """(parent, id, ord) of a random forest with null, negative and large orders, and a chain below its first node."""
    choose = random.Random(seed)
    rows = [(f"n{choose.randrange(max(0, k - 40), k)}", f"n{k}", choose.choice([None, -3, 0, 3, 12, 1_000_000])) for k in range(1, n) if choose.random() > 0.02]
    return rows + [(f"c{k}" if k else "n0", f"c{k + 1}", 1) for k in range(chain)]


def pre_order(rows, root):
    below = {}
    for parent, child, place in rows:
        below.setdefault(parent, []).append((place is None, place or 0, child))
    out, stack = [], [root]
    while stack:
        out.append(stack.pop())
        stack += [child for _, _, child in sorted(below.get(out[-1], []), reverse=True)]
    return out


def contains(spark, rows):
    return spark.createDataFrame([(p, "CONTAINS", c, None, o) for p, c, o in rows], ", ".join(f"{c} {k}" for c, k in graph.EDGE_COLUMNS.items()))


@pytest.mark.parametrize("most_children", [trees.MOST_CHILDREN, 3])
def test_trees_are_ranges(spark, most_children):
    rows = random_tree(300, 1)
    df = spark.createDataFrame(rows, "parent string, id string, ord int")
    got = {r.id: r for r in trees.number_trees(df, [F.asc_nulls_last("ord"), F.col("id")], most_children).collect()}
    assert set(got) == {x for row in rows for x in row[:2]}
    for i, r in got.items():
        below = pre_order(rows, i)
        assert r["size"] == len(below) and [got[x].place for x in below] == list(range(r.place, r.place + r["size"])) and r.tree == got[below[-1]].tree


def test_deep_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(trees, "cut", lambda df: rounds.append(1) or cut(df))
    up = spark.createDataFrame([(f"c{k + 1}", f"c{k}") for k in range(10_000)], "id string, parent string")
    assert {r.top for r in trees.climb(up).select("top").distinct().collect()} == {"c0"}
    assert len(rounds) <= 16  # one before the first round


def test_climbs_into_cycles(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "x"), ("0", "a"), ("p", "q")]
    got = {r.id: r.top for r in trees.climb(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert got == {"a": "b", "b": "b", "c": "b", "d": "b", "x": "x", "0": "b", "p": "q"}


def test_nulls_sort_behind_all_orders(spark):
    rows = [("r", "none", None), ("r", "twelve", 12), ("r", "three", 3), ("r", "minus", -7), ("r", "large", 2**31 - 1)]
    edges, expected = contains(spark, rows), ["r", "minus", "three", "twelve", "large", "none"]
    assert [r.id for r in traversal.contains_paths(ids_of(spark, "r"), edges).orderBy("key").collect()] == expected
    for levels in (0, 8):
        assert [r.id for r in traversal.subtree_rows(ids_of(spark, "r"), edges, levels=levels).orderBy("nth", "key").collect()] == expected
    assert [r.child for r in traversal.children(ids_of(spark, "r"), edges).orderBy("place").collect()] == expected[1:]


def test_ranges_equal_paths(spark, small):
    rows = random_tree(120, 2, chain=9)
    edges = contains(spark, rows).unionByName(small[1])
    roots = ids_of(spark, *[f"n{k}" for k in range(120)], "c3", "c9", "root", "A", "B", "X", "Y", "alone")
    walked = sorted((r.root, r.nth, r.id) for r in traversal.in_order(traversal.subtrees(roots, edges)).collect())
    for levels, most in ((0, 1000), (1000, 5)):
        rows = traversal.subtree_rows(roots, edges, levels=levels, most=most).collect()
        own = collections.defaultdict(list)
        for r in rows:
            own[r.root].append((r.nth, r.key, r.id))
        assert sorted((root, k, x[2]) for root, below in own.items() for k, x in enumerate(sorted(below))) == walked
        assert most == 5 or levels == 1000 or max(r.nth for r in rows) > 100


def test_large_subtrees_and_hubs_come_in_parts(spark, small):
    nodes, edges = small
    rows = traversal.assemble_text(traversal.subtree_rows(ids_of(spark, "A"), edges, most=3), nodes, most=3).orderBy("part").collect()
    assert "\n".join(r.text for r in rows) == "Article A\none\na\nb\ntwo\nnine\nten" and [r.part for r in rows] == [0, 1, 2]
    more = spark.createDataFrame([(s, "REFERENCES", "B", None, None) for s in ("A.1", "A.2", "A.9", "A.10", "A")], edges.schema)
    found = traversal.traverse(ids_of(spark, "B", "nothing"), nodes, edges.unionByName(more), most=2, most_neighbours=2).collect()
    assert [r.error for r in found if r.id == "nothing"] == ["Node not found"]
    own = sorted((r for r in found if r.id == "B"), key=lambda r: r.part)
    assert "\n".join(r.text for r in own if r.text) == "Article B\nb one\nb" and [c for r in own for c in r.children] == ["B.1", "A.1.b"]
    assert {x.id for r in own for x in r.references} == {"A", "A.1", "A.1.a", "A.2", "A.9", "A.10"}
    assert "\n".join(x.text for r in own for x in r.references if x.id == "A") == "Article A\none\na\nb\ntwo\nnine\nten"
