"""Windows of a header share one sort, and its cheaper functions say what the longer ones said."""

from pyspark.sql import functions as F

from quirelake.functions import clauses as C
from quirelake.functions import text as T
from quirelake.operators import recognition as R

VOCABULARY = {"en": {"preambulatory": ["Noting"], "operative": ["Requests"]}, "zh": {"preambulatory": ["回顾"], "operative": ["决定"]}}


def test_header_sorts_once(spark):
    p = spark.createDataFrame([(1, 0, "Draft Resolution 1"), (1, 1, "Committee: A")], "doc_id int, para_idx int, text string")
    plan = R.header(p, "draft-resolution", VOCABULARY)._jdf.queryExecution().sparkPlan().toString()
    planned = R.header(p, "draft-resolution", VOCABULARY)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and planned.count("Sort [") == 1


def test_later_label_and_its_list_win(spark):
    rows = ["Draft Resolution 1", "Sponsors: Republic of A", "Kingdom of B", "Committee: X", "Sponsors: Republic of C", "Kingdom of D", "1. Requests x"]
    p = spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "doc_id int, para_idx int, text string")
    found = {r.para_idx: r.role for r in R.header(p, "draft-resolution", VOCABULARY).collect()}
    assert found == {0: "title", 1: None, 2: None, 3: "committee", 4: "sponsors", 5: "+sponsors", 6: None}


def test_squeeze_takes_all_white_space(spark):
    texts = [f"{c}a{c}b{c}{c}" for c in map(chr, [*range(0, 0x250), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF])] + ["", " \r\n", "a\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~T.squeeze(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_openings_are_those_of_lower_case(spark):
    phrases = ["Asks (a)", "Taki", "决定", "Noting"]
    texts = ["  asKs (A) x", "AsKs (a)", "asks a", "TAKİ", "takı", "决定x", "决", "\tNoting", "NOTİNG", "noting", None, ""]
    low = F.lower(F.ltrim("t"))
    before = F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.startswith(low, p))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~C.starts_with_any(F.col("t"), phrases).eqNullSafe(before)).collect() == []
