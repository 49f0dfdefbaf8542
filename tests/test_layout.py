from quirelake.operators import layout as L


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_styles(spark):
    styles = spark.createDataFrame([(1, "a", None, 12, None), (1, "b", "a", None, True), (1, "c", "b", 9, None), (1, "x", "y", None, None), (1, "y", "x", 7, None)], "doc_id int, style string, based_on string, size int, bold boolean")
    assert rows(L.resolve_styles(styles, ["size", "bold"])) == [(1, "a", 12, None), (1, "b", 12, True), (1, "c", 9, True), (1, "x", 7, None), (1, "y", 7, None)]
    own = spark.createDataFrame([(1, "b", 20, None)], "doc_id int, style string, size int, bold boolean")
    assert rows(L.effective_properties(own, L.resolve_styles(styles, ["size", "bold"]), ["size", "bold"]).select("size", "bold")) == [(20, True)]


def test_integrity(spark):
    s = "doc_id int, para_key string, text string"
    before = spark.createDataFrame([(1, "a", "决定。"), (1, "b", "（c） x"), (1, "c", "same"), (1, "d", "gone"), (1, "e", "Topic: x")], s)
    after = spark.createDataFrame([(1, "a", "决定；"), (1, "b", "（四） x"), (1, "c", "same"), (1, "e", "x")], s)
    edits = spark.createDataFrame([(1, "a", "ending", None), (1, "b", "marker", None), (1, "e", "label-drop", None)], "doc_id int, para_key string, kind string, expected string")
    assert rows(L.integrity_audit(before, after, edits)) == [(1, "b", "wrong-marker"), (1, "d", "unauthorised-removed")]


def test_marks(spark):
    s = "doc_id int, block int, idx int, text string, hidden boolean"
    before = spark.createDataFrame([(1, 0, 0, "ab", True), (1, 0, 1, "zz", False), (1, 0, 2, "c", True), (1, 1, 0, "ab", True)], s)
    after = spark.createDataFrame([(1, 0, 0, "axbc", True), (1, 1, 0, "ba", True)], s)
    assert rows(L.marks_audit(before, after, "hidden")) == [(1, 1)]


def test_coverage_and_geometry(spark):
    spans = spark.createDataFrame([(1, 0, 2, 5), (1, 1, 0, 3)], "doc_id int, para_idx int, start int, length int")
    runs = spark.createDataFrame([(1, 0, 0, 4, True), (1, 0, 4, 3, True), (1, 1, 0, 2, True), (1, 1, 2, 2, False)], "doc_id int, para_idx int, start int, len int, i boolean")
    assert rows(L.verb_coverage(spans, runs, runs["i"])) == [(1, 1, 0)]
    p = spark.createDataFrame([(1, 0, "body", "left", 0, 310), (1, 1, "body", "center", 40, 310)], "doc_id int, para_idx int, role string, jc string, indent int, pitch int")
    spec = spark.createDataFrame([("body", "left", 0, 310)], "role string, jc string, indent int, pitch int")
    assert rows(L.geometry_audit(p, spec)) == [(1, 1, "alignment"), (1, 1, "indent")]


def test_overrides(spark):
    data = [(1, "committee", ["x"]), (2, "evil", ["x"]), (3, "topic", ["a", "b"]), (4, "sponsors", ["n" * 201]), (5, "language", ["fr"]), (6, "topic", ["bad\x01"]), (7, "language", ["zh"])]
    out = L.validate_overrides(spark.createDataFrame(data, "request int, field string, values array<string>"), ["sponsors"], ["committee", "topic"])
    assert rows(out.select("request", "error")) == [(2, "unknown-field"), (3, "value-too-long"), (4, "list-too-long"), (5, "bad-language"), (6, "invalid-text")]


def test_paragraph_checks(spark):
    p = spark.createDataFrame([(1, 0, "Title"), (1, 1, "引言"), (1, 2, "长句子在这里结束，因为它必须有二十五个字以上才能算作一段正文。"), (1, 3, "（二）第二节"), (2, 0, "决定：（一）甲；（子）乙"), (2, 1, ""), (3, 0, "Position Paper"), (3, 1, "c"), (3, 2, "t"), (3, 3, "n"), (3, 4, "d"), (3, 5, "Body. text")], "doc_id int, para_idx int, text string")
    assert rows(L.missing_first_section(p)) == [(1, 3, 1, 0.94)]
    assert rows(L.embedded_markers(p)) == [(2, 0, 0, "（一）"), (2, 0, 1, "（子）")]
    assert [r[:3] for r in rows(L.stripped_header(p.where("doc_id = 3")))] == [(3, 1, "committee"), (3, 2, "topic"), (3, 3, "country"), (3, 4, "delegate")]
    assert rows(L.blank_balance(p, p.where("doc_id = 2"))) == [(1, 0, None), (2, 1, 1), (3, 0, None)]
    lines = spark.createDataFrame([(1, 0, "Sponsors: A"), (1, 1, "B"), (1, 2, "C"), (1, 3, "1. Stop"), (1, 4, "D")], "doc_id int, para_idx int, text string")
    found = L.list_field_lines(lines, lines["text"].rlike("^Sponsors"), lines["text"].rlike("^1\\."))
    assert rows(found.select("para_idx", "label_idx")) == [(1, 0), (2, 0)]


def test_lists_phrases_warnings(spark):
    items = spark.createDataFrame([(1, "a", 1, False, 3), (1, "b", 1, False, 3), (1, "b", 2, False, 3), (1, "c", 1, True, 3), (1, "d", 0, False, 3)], "doc_id int, list_key string, level int, unsafe boolean, value int")
    outside = spark.createDataFrame([(1, "d")], "doc_id int, list_key string")
    assert rows(L.plan_native_lists(items, outside)) == [(1, "a", None), (1, "b", "several-levels"), (1, "c", "unsafe-definition"), (1, "d", "used-outside")]
    spans = spark.createDataFrame([(1, "some phrase here", True), (1, "other", False)], "doc_id int, text string, italic boolean")
    assert rows(L.required_phrases(spans, spark.createDataFrame([(1, "phrase"), (1, "other"), (2, "x")], "doc_id int, phrase string"))) == [(1, "other"), (2, "x")]
    w = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b")], "doc_id int, pos int, warning string")
    assert rows(L.distinct_warnings(w)) == [(1, ["b", "a"])]
