"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docgraph.llm import decontaminate, exact_dedup, html_extract, line_dedup, minhash, mixing, pii, quality, secret_scan, warc

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six seven eight", "a"), (2, None, None), (3, "", "b"), (4, " \t\n ", "b"), (5, LONG, "a"), (6, LONG + " end", "a"),
    (7, "ONE two three four five six seven eight", "c"), (7, "ONE two three four five six seven eight", "c"), (None, "no id here at all, none", "c"), (8, "two words", None),
]
#: Names that the operators use themselves.
CLASHES = ("size", "kept", "bucket", "component", "block", "label", "score", "text_sha256", "lines", "start", "n", "p", "d")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), None) for i in range(1, 9)] + [(None, 1, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, LONG[200:500]), (2, None), (3, ""), (4, "two words"), (5, "one two three four five six seven eight"), (5, "one two three four five six seven eight")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("window", F.lit(1))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u", "<article><p>Text, here.</article>"), (1, "u", "<article><p>Text, here.</article>"), (2, None, None), (None, "v", "<p>x"), (3, "w", ""), (4, "z", "<p>" + LONG)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("hash", F.lit(0)).withColumn("archive", F.lit("clash"))


def test_exact(docs, none):
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == len(ROWS) and exact_dedup.exact_duplicates(none).count() == 0
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows}
    assert {(1, 7, 3, False), (7, 7, 3, True), (2, 3, 2, False), (3, 3, 2, True), (None, None, 1, True), (5, 5, 1, True)} <= got


def test_near(docs, none):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS) and minhash.near_duplicates(none).count() == 0
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    assert {(1, 4, 1, True), (7, 4, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (8, 1, 8, True), (None, 2, None, True)} <= got
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}


def test_lines(docs, none):
    assert line_dedup.duplicate_lines(none).count() == 0
    got = [tuple(r) for r in line_dedup.duplicate_lines(docs).collect()]
    assert got == [(7, 0, 1, 0, 0)] * 2
    assert line_dedup.without_duplicate_lines(docs).where("doc_id = 7").select("text", "size").distinct().collect()[0] == ("", "clash")


def test_decontamination(docs, none, benchmark):
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0
    got = {(r.doc_id, r.item_id, r.start) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert {(1, 5, 0), (7, 5, 0), (8, 4, 0)} <= got and {(5, 1), (6, 1)} <= {x[:2] for x in got}
    assert {x[0] for x in got} == {1, 5, 6, 7, 8}


def test_null_and_repeated_ids_through_the_stages(spark, tmp_path):
    passage = "alpha beta gamma delta epsilon zeta eta theta"
    items = [(None, passage), (3, "red green blue black white grey"), (3, "one small step for a man on the moon")]
    items = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, passage), (None, "a clean text without any id at all"), (7, "red green blue black white grey"), (7, "another clean text of the same id"), (8, "Left alone."), (7, "LEFT alone.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_words, r.similarity) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(None, None, 8, 1.0), (7, 3, 6, 1.0)}
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert {tuple(r) for r in left.collect()} == set(rows) - {rows[0], rows[2]} and left.schema == docs.schema
    left = corpus_pipeline.drop_exact_copies(spark, docs.unionByName(docs.limit(0)).union(spark.createDataFrame([(None, "left ALONE.")], docs.schema)), "")
    assert {tuple(r) for r in left.collect()} == set(rows) - {rows[5]}


def test_quality(docs, none, labels):
    assert quality.classify(none, labels).count() == 0
    for marked in (labels, labels.where("false"), labels.where("quality = 1")):
        rows = quality.classify(docs, marked).collect()
        assert len(rows) == len(ROWS)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_mixing(docs, none):
    assert mixing.mix_digest(none).count() == 0
    rows = mixing.mix_digest(docs).collect()
    assert len(rows) == len(ROWS) and sorted(map(str, rows)) == sorted(map(str, mixing.mix_digest(docs).collect()))
    assert all(r.taken <= 2 * r["size"] for r in rows)
    sizes = {r.doc_id: (r["size"], r.source_size) for r in rows}
    assert sizes[2] == (0, 2) and sizes[3] == (0, 0) and sizes[8] == (2, 2)


def test_scans(docs, none):
    for scan in (secret_scan.scan_secrets, pii.scan_personal_data):
        assert scan(none).count() == 0 and scan(docs).count() == len(ROWS)
        assert {r.spans for r in scan(docs).collect()} == {""}


def test_pages(pages):
    assert html_extract.extract_text(pages.where("false")).count() == 0
    rows = {(r.page_id, r.url): r.text for r in html_extract.extract_text(pages).collect()}
    assert rows == {(1, "u"): "Text, here.", (2, None): "", (None, "v"): "x", (3, "w"): "", (4, "z"): LONG}


def test_audit(pages):
    assert warc.audit(pages, pages).count() == 0 and warc.audit(pages.where("false"), pages.where("false")).count() == 0
    lost = warc.audit(pages, pages.where("page_id <> 3 or page_id is null")).collect()
    assert {(r.page_id, r.status) for r in lost} == {(3, "missing"), (4, "moved")}
    gained = warc.audit(pages.where("page_id is not null"), pages).collect()
    assert [(r.page_id, r.status) for r in gained] == [(None, "extra")]
    html = F.when(F.col("page_id") == 3, "changed").otherwise(F.col("html"))
    assert {(r.page_id, r.status) for r in warc.audit(pages, pages.withColumn("html", html)).collect()} == {(3, "altered"), (4, "moved")}
