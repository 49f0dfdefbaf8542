"""Recognition passes over a document's rows few times, and its cheap tests say what the longer ones said."""

from itertools import product

from pyspark.sql import functions as F

from quirelake.functions import clauses as C
from quirelake.functions import numerals as N
from quirelake.functions import text as T
from quirelake.operators import recognition as R

VOCABULARY = {"en": {"preambulatory": ["Noting"], "operative": ["Requests"]}, "zh": {"preambulatory": ["回顾"], "operative": ["决定"]}}
LINES = [
    "", "a", "A.", "(a) x", "(A) x", "a) x", "a.x", "a.决定", "ab. x", "ii. x", "1. x", "1、x", "12  x", "12 x", "第一条 x", "（一）x", "(ii) x", "(12) x", "ſ. x", "ſ) x", "K. x", "é. x", "part ii x", "PART IV", "x!", "x！ ", " x", "x\u3000", "\x1cx", "x\x85",
    "The Council,", "the the council", "联合国大会，", "The Council, ,", "The  Council,,", "THE", "tHE Council", "Theatre", "A Republic of B; C States", "法国、日本国", "a\tb Republic", "The Republic, ,the Kingdom", "国", ",", "Republic", "7 States", "A State.", "联邦/a Kingdom|b Republic", "x y",
]


def test_few_windows(spark):
    p = spark.createDataFrame([(1, 0, "Draft Resolution 1"), (1, 1, "Committee: A")], "doc_id int, para_idx int, text string")
    headed = R.header(p, "draft-resolution", VOCABULARY)
    passes = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("Window [")
    assert passes(headed) <= 6 and passes(R.document_roles(headed, "draft-resolution", VOCABULARY)) <= 6


def test_cheap_tests_agree(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "raw string").withColumn("t", T.squeeze(F.col("raw")))
    t = F.col("t")
    assert df.where(~T.trimmed(F.col("raw")).eqNullSafe(t)).collect() == []
    assert df.where(T.unmarked(t) & T.has_marker(t)).collect() == []
    assert df.where(~C.bare(t).eqNullSafe(T.squeeze(F.regexp_replace(t, "[，,]+$", "")))).collect() == []
    assert df.where(~C.without_prefix(C.bare(C.bare(t))).eqNullSafe(C.bare_organ(C.bare(t)))).collect() == []
    names = T.split_names(F.regexp_replace(t, r"[、，,\s]+$", ""))
    for regions in ([], ["x y"]):
        bare = lambda v: F.lower(T.squeeze(F.regexp_replace(v, r"(?i)^The\s+", "")))
        state = lambda v: F.when(v.rlike("[㐀-鿿]"), (F.length(v) <= 24) & v.rlike(R.STATE_ZH)).otherwise((F.length(v) <= 80) & (bare(v).isin(*regions) | v.rlike(R.STATE_EN) if regions else v.rlike(R.STATE_EN)))  # noqa: E731,B023
        full = ~t.rlike(r"[：:。！？!?；;\d]") & ~t.rlike(r"\.\s*$") & (F.size(names) > 0) & F.forall(names, state)
        assert df.where(~R.is_name_continuation(t, regions).eqNullSafe(full)).collect() == []


def test_short_numerals(spark):
    tokens = ["".join(x) for n in range(5) for x in product("ivxlcdma", repeat=n)]
    df = spark.createDataFrame([(x,) for x in tokens], "t string")
    assert df.where(~N.short_roman(F.col("t")).eqNullSafe(N.roman_sum(F.col("t")))).collect() == []


def test_early_boundary_and_tokens(spark):
    """An operative verb right before a sub-clause begins the operative part; i behind h is a letter, behind g a numeral."""
    rows = ["Draft Resolution 1", "Committee: A Council", "The A Council,", "Noting x", "Requests now:", "(a) x", "(h) x", "(i) x", "1. Requests y", "(g) x", "(i) x", "(ii) x"]
    p = spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "doc_id int, para_idx int, text string")
    found = R.clauses(R.header(p, "draft-resolution", VOCABULARY), "draft-resolution", VOCABULARY).orderBy("para_idx").collect()
    assert [(r.para_idx, r.kind[:3], r.level) for r in found] == [(2, "hea", 0), (3, "pre", 0), (4, "ope", 0), (5, "ope", 1), (6, "ope", 1), (7, "ope", 1), (8, "ope", 0), (9, "ope", 1), (10, "ope", 2), (11, "ope", 2)]
