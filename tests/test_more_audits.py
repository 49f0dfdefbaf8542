"""Name lists, prefixes, gazetteer assertions and audits on small tables."""

import pytest
from pyspark.sql import functions as F

from quirelake.operators import audits, layout, names
from quirelake.sources.reference_tables import build_gazetteer


def test_name_lists_against_a_second_plan(spark):
    index = names.name_index(spark.createDataFrame([(1, "Alpha"), (2, "Beta"), (3, "Gamma")], "id int, display string"), ["display"])
    given = ["beta", "ALPHA", "Beta", "Unknown", "Unknown"]
    before = spark.createDataFrame([(d, i, n) for d in range(7) for i, n in enumerate(given)], "doc_id int, pos int, name string")
    lists = {0: ["Alpha", "Beta", "Unknown", "Unknown"], 1: ["Beta", "Unknown", "Unknown"], 2: ["Alpha", "Alpha", "Beta", "Unknown", "Unknown"], 3: ["Beta", "Alpha", "Unknown", "Unknown"], 4: ["Alpha", "Be ta", "Unknown"], 5: ["Alpha", "Beta", "Unknown", "Unknown", "Gamma"]}
    after = spark.createDataFrame([(d, i, n) for d, x in lists.items() for i, n in enumerate(x)], "doc_id int, pos int, name string")
    got = sorted(map(tuple, names.name_list_audit(before, after, index, ["doc_id"], "pos", names.sort_key(F.col("display"), "en")).collect()))
    assert got == [(1, "missing-name", "Alpha"), (2, "doubled-name", "Alpha"), (3, "re-ordered", "Beta"), (4, "missing-name", "Unknown"), (5, "added-name", "Gamma"), (6, "missing-name", "Alpha"), (6, "missing-name", "Beta"), (6, "missing-name", "Unknown")]


def test_prefixes_end_at_words(spark):
    rows = spark.createDataFrame([(1, "Calls upon all"), (2, "Callsign"), (3, "Calls"), (4, "Calls, then"), (5, None), (6, "决定设立")], "id int, text string")
    vocabulary = spark.createDataFrame([("Calls",), ("Calls upon",), ("Calls up",), ("决定",), ("",), (None,)], "v string")
    got = {r.id: r.phrase for r in audits.prefix_join(rows, vocabulary, "text", "v", ["id"]).collect()}
    assert got == {1: "Calls upon", 3: "Calls", 4: "Calls"}
    loose = {r.id: r.phrase for r in audits.prefix_join(rows, vocabulary, "text", "v", ["id"], words=False).collect()}
    assert loose == {1: "Calls upon", 2: "Calls", 3: "Calls", 4: "Calls", 6: "决定"}
    assert audits.prefix_join(rows, vocabulary.limit(0), "text", "v", ["id"]).count() == 0


@pytest.mark.parametrize("names_, geography, said", [([("A", "A", None), ("B", "B", None)], [("1", "A", None)], "missing id"), ([("", "A", None)], [("1", "A", None)], "missing id"), ([("A", "A", None), ("A", "a ", None)], [("1", "A", None)], "given twice")])
def test_a_strict_gazetteer_fails_on_faults(spark, names_, geography, said):
    n = spark.createDataFrame(names_, "formal_en string, short_en string, short_zh string")
    g = spark.createDataFrame(geography, "id string, name_en string, name_zh string")
    assert build_gazetteer(n, g).count() == len(names_)
    with pytest.raises(Exception, match=said):
        build_gazetteer(n, g, strict=True).select("kind").count()


def test_layout_findings(spark):
    levels = spark.createDataFrame([(1, "1", 0, "bullet", 8.0, "Symbol", True, None, None), (1, "1", 1, "decimal", 12.0, "Serif", False, False, False), (1, "2", 0, None, None, None, None, True, None)], "doc_id int, num_id string, ilvl int, fmt string, sz double, font string, b boolean, i boolean, u boolean")
    assert sorted(tuple(r)[1:] for r in layout.marker_audit(levels, 12.0, "Serif").collect()) == [("1", 0, "marker-size"), ("2", 0, "marker-emphasis"), ("2", 0, "marker-font"), ("2", 0, "marker-size")]
    text = lambda *x: spark.createDataFrame([(1, i, t) for i, t in enumerate(x)], "doc_id int, para_idx int, text string")
    assert layout.section_marker_audit(text("（二）a", "（三）b"), text("（一）x", "（二）a", "（三）b")).count() == 0
    assert [tuple(r) for r in layout.section_marker_audit(text("（一）a", "（二）b"), text("（二）b")).collect()] == [(1, "（一）（二）", "（二）")]


def test_binaries(spark):
    files = spark.createDataFrame([("a.txt", bytearray("é".encode())), ("b.txt", bytearray(b"\xff")), ("c.docx", bytearray(b"\xff")), ("d", bytearray(b""))], "path string, content binary")
    assert [r.path for r in audits.binaries_to_review(files).collect()] == ["b.txt"]
