"""Parties of treaties: one shuffle and one sort of a paper's lines, and no join with a small index."""

from pyspark.sql import functions as F

from quirelake.operators import names as M
from quirelake.operators import recognition as R

TEXTS = {
    1: ["Agreement between Japan, Trinidad and Tobago and Canada on Trade", "The parties agree."],
    2: ["", None, "日本国、ＡＢＣ和乙", "就海洋的联合声明", "四方同意。"],
    3: ["The parties agree.", "Treaty of A and B"],
    4: ["Treaty of Café and Ｂar,, and  Trinidad  and\tTobago,"],
    5: ["Ours", "Agreement between Japan and Canada", "Text"],
    6: [" ", None],
    7: ["Agreement by Canada and Trinidad and Tobago and Tobago concerning X"],
    8: ["Agreement by Japan and Chile"],
}
PARTIES = {1: ["Japan", "Trinidad and Tobago", "Canada"], 2: ["日本国", "ＡＢＣ和乙"], 3: ["A", "B"], 4: ["Café and Ｂar", "Trinidad and Tobago"], 5: ["Japan", "Canada"], 7: ["Canada", "Trinidad and Tobago", "Tobago"], 8: ["Japan", "Chile"]}


def papers(spark):
    return spark.createDataFrame([(d, i, x) for d, lines in TEXTS.items() for i, x in enumerate(lines)], "doc_id long, para_idx int, text string")


def index(spark):
    # Japan is known, so that it doesn't join with what follows although both together are known
    spellings = ["Trinidad and Tobago", "Japan", "Japan and Chile", "Café and Bar", "abc和乙"]
    return M.name_index(spark.createDataFrame(list(enumerate(spellings)), "id int, display string"), ["display"])


def test_one_pass(spark):
    found = R.split_parties(R.treaty_heads(R.titles(papers(spark))), index(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Sort ["), plan.count("Exchange hashpartitioning"), plan.count("Aggregate("), plan.count("Join ")) == (1, 1, 0, 0)
    assert {r.doc_id: r.parties for r in found.collect()} == PARTIES


def test_large_index_and_rows_of_lines(spark, monkeypatch):
    by_rows = R.split_parties(R.treaty_heads(R.title_lines(papers(spark))), index(spark))
    assert {r.doc_id: r.parties for r in by_rows.collect()} == PARTIES
    monkeypatch.setattr(M, "INDEX_LITERALS", 2)
    joined = R.split_parties(R.treaty_heads(R.titles(papers(spark))), index(spark))
    assert joined._jdf.queryExecution().executedPlan().toString().count("Join ") == 2
    assert {r.doc_id: r.parties for r in joined.collect()} == PARTIES


def test_keys_of_arrays(spark):
    names = ["Cote  d’Ivoire ", "a\tB", None, "ＡＢＣ", "", "é　x", "q\"[\n"]
    df = spark.createDataFrame([(names,), (["A ", " b  c"],), (None,), ([],)], "n array<string>")
    rows = M.with_name_keys(df, "n", "k").collect()
    single = {r.n: r.k for r in spark.createDataFrame([(x,) for x in [*names, "A ", " b  c"]], "n string").select("n", M.name_key(F.col("n")).alias("k")).collect()}
    assert [r.k for r in rows] == [r.n and [single[x] for x in r.n] for r in rows]
