"""A second plan follows a first row by row: nothing is written between them, and nothing is joined back."""

from pyspark.sql import functions as F

from quirelake.functions import numerals as N
from quirelake.operators import planning as P
from quirelake.plans import papers

ROLES = "doc_id int, para_idx int, role string, level int, operative boolean, text string, language string"
LINES = ["", "1. x", "01. x", "100. x", "1.5 x", "1．2 x", "(12) x", "(1.2) x", "(0) x", "12、x", "a) x", "(a) x", "(i) x", "(iiii) x", "xcix) x", "ab. x", "AB. x", "第十二条 x", "第千条 x", "（十二）x", "（子丑）x", "（甲）x", "(K) x", "(é) x", " \t(b) x", "( a ) x", "x", None]


def test_applied_rows_are_those_of_the_plan(spark):
    # the item of document 2 stands below no top clause, so its only edit is reported and not made
    rows = [(1, 0, "title", 0, False, "draft resolution 1", "en"), (1, 1, "committee", 0, False, "Committee: A", "en"), (1, 2, "item", 0, True, "1. Requests", "en"), (1, 3, "item", 1, True, "(a) work.", "en"), (2, 0, "item", 1, True, "(a) work", "en"), (3, 0, None, None, None, None, "en")]
    roles = spark.createDataFrame(rows, ROLES)
    again = P.applied_rows(P.planned_rows(roles, "draft-resolution"))
    assert "Join" not in again._jdf.queryExecution().optimizedPlan().toString()
    expected = P.apply_edits(roles, P.plan_edits(roles, "draft-resolution"))
    assert sorted(map(str, again.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    assert [r.reason for r in again.where("doc_id = 2").select(F.explode("edits").alias("e")).select("e.reason").collect()] == ["no-top-clause"]


def test_idempotence_reads_papers_once(spark):
    """Its only joins are those that make the papers; with tables written between, their plan was none of its own."""
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(papers.idempotence(spark, "/root/testdata/sf0.001")) == joins(papers.papers(spark, "/root/testdata/sf0.001"))


def test_compiled_markers(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "t string")
    for context in (True, False):
        found = N.with_marker(df.withColumn("old", N.marker_of(F.col("t"), F.lit(context))), "new", F.col("t"), F.lit(context))
        assert found.where(~F.col("new").eqNullSafe(F.col("old"))).collect() == []
