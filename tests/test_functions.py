import pytest
from pyspark.sql import functions as F

from docgraph.functions import ids
from docgraph.functions import text as T
from docgraph.functions.vectors import cosine


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_roman_round_trip(spark):
    rows = spark.range(0, 4002).select("id", ids.to_roman(F.col("id")).alias("r")).withColumn("back", ids.from_roman(F.col("r")))
    bad = rows.where("case when id between 1 and 3999 then not (back <=> id) else r is not null end")
    assert bad.count() == 0
    assert one(spark, ids.to_roman(F.lit(1994))) == "MCMXCIV"
    for text in ("", "IIII", "VX", "ABC", None):
        assert one(spark, ids.from_roman(F.lit(text))) is None


@pytest.mark.parametrize(
    "context, expected",
    [
        ("(5)(a), (b) and (c)", [(5, ["a", "b", "c"])]),
        ("(2) to (4)", [(2, None), (3, None), (4, None)]),
        ("(4) to (2)", [(2, None), (3, None), (4, None)]),
        ("referred to in points 2 to 8", [(None, [str(i) for i in range(2, 9)])]),
        ("points 2, 3 and 4", [(None, ["2", "3", "4"])]),
        ("points (a), (b) and (c)", [(None, ["a", "b", "c"])]),
        ("(1), point (a)", [(1, None), (None, ["a"])]),
        (", point (3)", [(3, None)]),
        ("(a) and (b)", []),
        ("", []),
        (None, []),
    ],
)
def test_citations(spark, context, expected):
    got = one(spark, T.citations(F.lit(context).cast("string")))
    assert [(c.paragraph, c.points) for c in got] == expected


def test_markers_and_levels(spark):
    texts = ["1. one", "(12) two", "(a) three", "(ii) four", "none", "(i) letter first"]
    assert [one(spark, T.paragraph_marker(F.lit(x))) for x in texts] == ["1", "12", "a", "ii", None, "i"]
    assert one(spark, T.indent_level(F.lit("color: red; padding-left: 80px"))) == 2
    assert one(spark, T.indent_level(F.lit("color: red"))) is None


def test_clean_text_and_final(spark):
    assert one(spark, T.clean_text(F.lit("Body. Related: Recitals 1, 2, and 3 "))) == "Body."
    assert one(spark, T.clean_text(F.lit("Body. Related: Recital 7"))) == "Body."
    assert one(spark, T.final_answer(F.lit("thought\nfinal: an\nanswer "))) == "an\nanswer"
    assert one(spark, T.final_answer(F.lit("no answer"))) is None


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(spark, cosine(F.lit(None).cast("array<double>"), v(1, 0))) == 0.0
    assert one(spark, cosine(v(1, 2), v(2, 4))) == pytest.approx(1.0)
