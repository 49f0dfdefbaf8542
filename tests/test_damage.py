"""Damage is the same at any partitioning, keeps words and their order, and plans made on damaged papers are stable."""

import pytest
from pyspark.sql import functions as F

from quirelake.functions.text import visible_signature
from quirelake.operators import damage as D
from quirelake.operators import lines as Z
from quirelake.operators.planning import apply_edits, plan_edits


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("doc_id", "idx").collect()]


@pytest.fixture(scope="module")
def paper(spark):
    text = ["委员会：一", " 议题: 二", "（一）背景", "正文：", "（子）甲：", "（丑）乙：", "（甲）丙；", "（子）丁；", "（二）建议：", "（寅）戊；", "1. 己："]
    data = [(doc, i, t, "7" if i in (4, 5, 6) else None, 400, -900) for doc in range(40) for i, t in enumerate(text)]
    return spark.createDataFrame(data, "doc_id int, idx int, text string, num_id string, left int, first int")


@pytest.mark.parametrize("operation", [D.strip_labels, D.drop_first_section, D.merge_subclauses, D.drop_list_number, lambda p, seed, share=1: D.scatter(p, "x", {"left": [1, 2], "first": [3]}, ["doc_id", "idx"], seed)])
def test_partitioning_changes_nothing(paper, operation):
    one, many = operation(paper.coalesce(1), 5, share=2), operation(paper.repartition(7, "text"), 5, share=2)
    assert rows(one, *paper.columns) == rows(many, *paper.columns)
    assert rows(one, *paper.columns) != rows(operation(paper, 6, share=2), *paper.columns)


def test_merged_lines(paper):
    got = [t for d, _, t in rows(D.merge_subclauses(paper), "doc_id", "idx", "text") if d == 0]
    # the line behind a merged one stays, so of three in a row the first and the third go
    assert got == ["委员会：一", " 议题: 二", "（一）背景", "正文：（子）甲：", "（丑）乙：（甲）丙；", "（子）丁；", "（二）建议：（寅）戊；", "1. 己："]
    assert [t for d, _, t in rows(D.merge_subclauses(paper, most=1), "doc_id", "idx", "text") if d == 0][3:5] == ["正文：（子）甲：", "（丑）乙："]
    marked = paper.withColumn("complex", F.col("idx") == 3)
    assert [t for d, _, t in rows(D.merge_subclauses(marked), "doc_id", "idx", "text") if d == 0][3:6] == ["正文：", "（子）甲：（丑）乙：", "（甲）丙；"]


def test_list_number_and_section_and_labels(paper):
    got = [x for x in rows(D.drop_list_number(paper), "doc_id", "idx", "num_id", "left", "first") if x[0] == 0 and 3 < x[1] < 7]
    assert got == [(0, 4, None, 0, 0), (0, 5, "7", 400, -900), (0, 6, "7", 400, -900)]
    assert [t for d, _, t in rows(D.drop_first_section(paper), "doc_id", "idx", "text") if d == 0][2] == "背景"
    assert [t for d, _, t in rows(D.strip_labels(paper), "doc_id", "idx", "text") if d == 0][:2] == ["一", "二"]


def test_fragments_say_the_same(spark):
    runs = spark.createDataFrame([(1, 0, 0, 0, 9, "abcdefghi", True), (1, 0, 1, 9, 2, "xy", False), (1, 1, 0, 0, 0, "", None), (2, 0, 0, 0, 40, "z" * 40, None)], "doc_id int, para_idx int, run_idx int, start int, len int, text string, b boolean")
    got = [tuple(r) for r in D.fragment(runs, 3).orderBy("doc_id", "para_idx", "run_idx").collect()]
    said = {}
    for doc, para, _, start, n, text, _ in got:
        assert len(said.get((doc, para), "")) == start and len(text) == n <= 4
        said[doc, para] = said.get((doc, para), "") + text
    assert said == {(1, 0): "abcdefghixy", (1, 1): "", (2, 0): "z" * 40}
    assert [x[2] for x in got if x[:2] == (2, 0)] == list(range(sum(x[:2] == (2, 0) for x in got)))
    assert {x[6] for x in got if x[:2] == (1, 0) and x[3] < 9} == {True}


def test_words_stay_in_order(paper):
    """Structural damage takes labels, markers and line ends only."""
    said = lambda df: {r["doc_id"]: r["s"] for r in df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: visible_signature(x.text)), "").alias("s")).collect()}
    assert said(D.damaged(paper, "draft-resolution", 4)) == said(paper)
    assert all(a == b.replace("委员会:", "").replace("议题:", "").replace("(一)", "") for (_, a), (_, b) in zip(sorted(said(D.damaged(paper, "position-paper", 4)).items()), sorted(said(paper).items()), strict=True))


def test_a_second_plan_is_empty_on_damaged_papers(spark):
    roles = ["title", "committee", "topic", "sponsors", "preamble", "item", "item", "prose", "item"]
    texts = ["Draft Resolution 1", "Committee: A", "Topic: B", "Sponsors: X", "Noting this", "1. Requests that:", "（a） one", "plain", "2. Urges"]
    data = [(d, i, r, 1 if t.startswith("（") else 0, i > 4, t, "en") for d in range(30) for i, (r, t) in enumerate(zip(roles, texts, strict=True))]
    p = spark.createDataFrame(data, "doc_id int, para_idx int, role string, level int, operative boolean, text string, language string")
    hurt = D.strip_labels(p.withColumnRenamed("para_idx", "idx"), 9, 2, r"^(?:Committee|Topic|Sponsors): ").withColumn("text", F.when(D.hit("blank", 9, 4, "doc_id", "idx"), F.lit(" ")).otherwise(F.col("text")))
    rules = Z.BlankRules(after=("title_block", "header", "sponsors"), before_operative=True, between_prose=True)
    lined = Z.apply_lines(hurt, Z.plan_blank_lines(hurt, rules))
    assert Z.plan_blank_lines(hurt, rules).count() > 0 and Z.plan_blank_lines(lined, rules).count() == 0 and Z.blank_audit(lined, rules).count() == 0
    texts_ = lined.where("role is not null").withColumnRenamed("idx", "para_idx")
    edited = apply_edits(texts_, plan_edits(texts_, "draft-resolution"))
    assert plan_edits(edited, "draft-resolution").where("reason is null").count() == 0


def test_blank_lines_around_protected_and_leading_ones(spark):
    p = spark.createDataFrame([(1, 0, " ", None, False, False), (1, 1, "T", "title", False, False), (1, 2, "", None, False, True), (1, 3, "", None, False, False), (1, 4, "　", None, False, False), (1, 5, "x", "prose", True, False)], "doc_id int, idx int, text string, role string, operative boolean, protected boolean")
    edits = sorted(tuple(r)[1:4] for r in Z.plan_blank_lines(p, Z.BlankRules(after=("title",))).collect())
    # the protected blank is text, so the title wants one of its own; the others go
    assert edits == [(0, 0, "empty-line"), (1, 1, "blank"), (3, 0, "empty-line"), (4, 0, "empty-line")]
    out = Z.apply_lines(p, Z.plan_blank_lines(p, Z.BlankRules(after=("title",))))
    assert rows(out, "idx", "text", "protected") == [(0, "T", False), (1, "", False), (2, "", True), (3, "x", False)]
    assert Z.plan_blank_lines(p.limit(0), Z.BlankRules()).count() == 0
