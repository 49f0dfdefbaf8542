import json

from pyspark.sql import functions as F

from quirelake.functions import clauses as C
from quirelake.functions import treaty as Y
from quirelake.sources.reference_tables import build_gazetteer, gazetteer_problems, policy_tables

from .test_operators import values


def test_clauses(spark):
    kinds = values(spark, ["Recalling the past", "decides to act", "Other text"], C.classify_clause(F.col("text"), "draft-resolution", ["Recalling"], ["Decides"], F.lit(True)))
    assert [tuple(k) for k in kinds] == [("preambulatory", 0.94), ("operative", 0.94), ("unknown", 0.35)]
    assert values(spark, ["The Security Council,", "安全理事会，", "Recalling the Council,"], C.is_subject_line(F.col("text"), ["Recalling"])) == [True, True, False]
    assert values(spark, ["The Security Council,"], C.is_committee_subject(F.col("text"), F.lit("Security Council"))) == [True]
    found = values(spark, ["1. Calls upon all", "Callsign", "none"], C.longest_phrase(F.col("text"), ["Calls", "Calls upon"]))
    assert [x and tuple(x) for x in found] == [("Calls upon", 3, 10), None, None]
    assert values(spark, ["Country: France", "France", "Topic: x"], C.country_field_value(F.col("text"))) == ["France", "France", None]


def test_treaty(spark):
    assert values(spark, ["Representative of France   For Spain", "Jean   Ana"], Y.label_tokens(F.col("text"), "en")) == [["Representative of France", "For Spain"], None]
    assert values(spark, ["On behalf of the  Netherlands"], Y.party_key(Y.label_party(F.col("text"), "en"))) == ["netherlands"]
    assert values(spark, ["x"], Y.treaty_title("协定", F.array(F.lit("甲"), F.lit("乙"), F.lit("丙")), F.lit("水"), "zh")) == ["甲、乙和丙关于水的协定"]
    assert values(spark, ["x"], Y.treaty_title("Treaty", F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.lit(""), "en")) == ["Treaty between A, B and C"]


def test_reference_tables(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"prefixes": {"en": {"operative": ["Calls", "Decides"]}}, "metadata": {"topic": {"aliases": ["Topic"]}}}))
    phrases, labels = policy_tables(spark, str(tmp_path / "p.json"))
    assert sorted(map(tuple, phrases.collect())) == [("en", "operative", 0, "Calls"), ("en", "operative", 1, "Decides")] and tuple(labels.first()) == ("topic", 0, "Topic")
    names = spark.createDataFrame([("The Kingdom of X", "X", "某"), ("Republic Y", "Why", "乙"), ("Z", "Zed", "丁")], "formal_en string, short_en string, short_zh string")
    geography = spark.createDataFrame([("1", "x ", "甲"), ("2", "Y", "乙")], "id string, name_en string, name_zh string")
    table = build_gazetteer(names, geography)
    assert sorted((r.formal_en, r.id or "") for r in table.collect()) == [("Kingdom of X", "1"), ("Republic Y", "2"), ("Z", "")]
    assert [r.problem for r in gazetteer_problems(table).collect()] == ["missing"]
