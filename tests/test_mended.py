import pytest
from pyspark.sql import functions as F

from quillgraph.functions import dates as D
from quillgraph.functions import stats as S
from quillgraph.functions import text as T
from quillgraph.operators import tables
from quillgraph.operators.retrieval import containing


def test_upsert_sets_nulls(spark):
    old = spark.createDataFrame([(1, "a", "o"), (2, "b", "o"), (None, "n", "o")], "id int, x string, made string")
    new = spark.createDataFrame([(1, None, "n"), (3, "c", "n")], "id int, x string, made string")
    got = {(r.id, r.x, r.made, r.fresh) for r in tables.upsert(old, new, ["id"], mark="fresh", keep=["made"]).collect()}
    assert got == {(1, None, "o", True), (2, "b", "o", False), (None, "n", "o", False), (3, "c", "n", True)}


def test_short_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "many counterrevolutionaries communication here"), (2, "xcounterrevolutionaries communications"), (3, None), (4, "a quite long passage of several words stands")], "doc_id int, text string")
    passages = spark.createDataFrame([(10, "counterrevolutionaries communication"), (11, "long passage of several words"), (12, "short one"), (13, None)], "item_id int, text string")
    assert {tuple(r) for r in containing(docs, passages).collect()} == {(1, 10), (2, 10), (4, 11)}
    assert containing(docs.limit(0), passages).count() == 0 and containing(docs, passages.limit(0)).count() == 0


def test_scope_parts_of_any_column(spark):
    rows = [("agents. Out of scope: games",), ("all",), (None,)]
    a, b = T.scope_parts(F.col("asked"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "asked string").select(a.alias("a"), b.alias("b")).collect()]
    assert got == [("agents. ", ": games"), ("all", "all"), (None, None)]


@pytest.mark.parametrize(
    ("day", "source", "arxiv", "year", "want"),
    [
        ("2024-05-03", "openalex", "2403.01234", 2024, ("2024-03-01", "month", "arxiv_id")), ("2024-03-09", "openalex", "2403.01234", None, ("2024-03-09", "day", "openalex")), (None, None, "2413.01234", 2020, ("2020-01-01", "year", "year_fallback")),
        ("2024-03-09", None, None, None, ("", "", "")), (None, None, None, None, ("", "", "")),
    ],
)
def test_dates_with_precision_and_source(spark, day, source, arxiv, year, want):
    row = spark.createDataFrame([(day, source, arxiv, year)], "d string, s string, a string, y int")
    assert tuple(row.select(D.dated(F.col("d"), F.col("s"), F.col("a"), F.col("y")).alias("x")).first().x) == want


def test_trust_has_two_digits(spark):
    row = spark.createDataFrame([(0.873, 0.511)], "c double, s double")
    assert row.select(S.single_trust(F.col("c"), F.col("s")).alias("t")).first().t == round(0.7 * 0.873 + 0.3 * 0.511, 2)


def test_reviews(spark):
    rows = [("Review", "x"), ("article", "A survey of things"), ("article", "Surveying things"), (None, "Notes: a review"), (None, None), ("article", "Overview of it"), ("article", "Preview of it")]
    got = [r.x for r in spark.createDataFrame(rows, "k string, t string").select(T.is_review(F.col("k"), F.col("t")).alias("x")).collect()]
    assert got == [True, True, False, True, False, True, False]
