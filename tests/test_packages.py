"""Package sources, rules and folds on small made packages."""

import io
import struct
import zipfile

from pyspark.sql import functions as F

from quirelake.operators import folds
from quirelake.sources import packages as S
from quirelake.streaming.ingest import stream_ingest

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = (
    f'<w:document {NS}><w:body><w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="24"/></w:rPr><w:t>Draft</w:t></w:r><w:r><w:tab/><w:t>One</w:t></w:r></w:p>'
    '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    '<w:sdt><w:sdtContent><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr></w:pPr><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:r><w:rPr><w:vanish/></w:rPr><w:t>kept</w:t></w:r></w:p></w:sdtContent></w:sdt></w:body></w:document>'
)
NUMBERING = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="(%2)"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="1"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>'
RELS = '<Relationships xmlns="r"><Relationship Id="r1" Type="t/image" Target="http://x" TargetMode="External"/></Relationships>'


def package(**parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {"[Content_Types].xml": "<Types/>", "word/document.xml": BODY, "word/numbering.xml": NUMBERING, "word/_rels/document.xml.rels": RELS, **parts}.items():
            z.writestr(name, text)
    return data.getvalue()


def table(spark, **docs):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in docs.items()], "doc_id string, content binary")


def test_parts(spark):
    docs = table(spark, a=package())
    rows = S.read_paragraphs(docs).orderBy("para_idx").collect()
    assert [(r.region, r.text, r.jc, r.num_id, r.ilvl) for r in rows] == [("flow", "Draft\tOne", "center", None, None), ("table", "cell", None, None, None), ("flow", "kept", None, "3", 1)]
    runs = S.read_runs(docs).orderBy("para_idx", "run_idx").collect()
    assert [(r.start, r.len, r.b, r.sz, r.hidden) for r in runs] == [(0, 5, True, 12.0, False), (5, 4, None, None, False), (0, 4, None, None, False), (0, 4, None, None, True)]
    assert tuple(S.read_list_levels(docs).first())[1:] == ("3", "0", 1, "lowerLetter", "(%2)", 5, True)
    assert not S.safe_to_render(S.package_entries(docs), S.read_relationships(docs)).first().safe


def test_audit(spark):
    good = package()
    at = good.index(b"word/document.xml") + len("word/document.xml")
    corrupt = good[: at + 40] + struct.pack("<I", 0xDEADBEEF) + good[at + 44 :]
    docs = table(spark, good=good, dtd=package(**{"word/x.xml": "<!DOCTYPE x><x/>"}), path=package(**{"../evil.xml": "<x/>"}), deep=package(**{"word/d.xml": "<a>" * 300 + "</a>" * 300}), broken=b"PK no zip", corrupt=corrupt, bomb=package(**{"word/b.bin": b"\0" * 2_000_000}))
    found = {(r.doc_id, r.rule) for r in S.package_audit(S.package_entries(docs)).collect()}
    assert found == {("dtd", "dtd"), ("path", "unsafe-path"), ("deep", "depth"), ("broken", "unreadable"), ("corrupt", "crc"), ("bomb", "ratio")}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(package())
    for _ in range(2):  # the second run finds nothing new
        stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out")).awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "out/paragraphs")).count() == 3


def test_hierarchy(spark):
    rows = [(1, 0, "第一条 决定：", "article", 0, None, True, False), (1, 1, "（一）甲", "chinese", 1, None, False, False), (1, 2, "（二）乙：", "chinese", 1, None, False, False), (1, 3, "（子）丙", "zodiac", 2, None, False, False), (2, 0, "（一）x", "chinese", 1, None, False, False)]
    items = spark.createDataFrame(rows, "doc_id long, idx int, text string, family string, level int, list_key string, top boolean, reset boolean")
    found = {(r.doc_id, r.idx): (r.planned_level, r.reason) for r in folds.plan_hierarchy(items, "zh").collect()}
    assert found == {(1, 0): (0, ""), (1, 1): (1, ""), (1, 2): (1, ""), (1, 3): (2, ""), (2, 0): (1, folds.NO_TOP)}


def test_signature_and_packing(spark):
    lines = spark.createDataFrame([(1, 0, True, ["A:", "B:", "C:"], [5.0, 15.0, 25.0]), (1, 1, False, ["x", "y"], [6.0, 24.0]), (2, 0, False, ["x"], [1.0])], "doc_id long, idx int, is_label boolean, tokens array<string>, centres array<double>")
    found = [(r.doc_id, r.label, r.name, r.inferred, r.ambiguous) for r in folds.read_signature_block(lines).orderBy("doc_id", "pos").collect()]
    assert found == [(1, "A:", "x", True, False), (1, "B:", None, True, False), (1, "C:", "y", True, False), (2, None, None, False, True)]
    one = spark.createDataFrame([([4.0, 4.0, 4.0, 4.0, 4.0],), ([],)], "w array<double>")
    assert [r[0] for r in one.select(folds.pack_names(F.col("w"), 10.0, 1.0)).collect()] == [[0, 0, 1, 1, 2], []]
    assert [r[0] for r in one.select(folds.signature_rows(F.col("w"), 14.0, 1.0)).collect()] == [[3, 2], []]


def test_alignment(spark):
    frame = lambda rows: spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "doc_id long, idx int, text string")
    a, b = frame(["one", "two", "three"]), frame(["one", "2", "three", "four"])
    assert [tuple(r) for r in folds.align_paragraphs(a, b).orderBy("out_idx").collect()] == [(1, 0, 0, True), (1, 1, 1, False), (1, 2, 2, True)]
    assert sorted(r.operation for r in folds.token_diff(a, b).collect()) == ["insert", "replace"]


def test_audit_hard_cases(spark):
    plain = package()
    at = plain.index(b"PK\x03\x04", 10)
    other = bytearray(plain)
    struct.pack_into("<H", other, at + 8, 0)  # the second local header names another method
    docs = table(
        spark, utf16=package(**{"word/x.XML": '<!DOCTYPE x SYSTEM "y"><x/>'.encode("utf-16")}), control=package(**{"word/a\x01.bin": "x"}), mismatch=bytes(other), twice=_twice(), fine=package(**{"word/y.xml": "<a><!-- <b> --><![CDATA[<c>]]></a>"}),
        many=package(**{"word/z.bin": b"\0" * 20_000_000}),
    )
    entries = S.package_entries(docs)
    found = {(r.doc_id, r.rule) for r in S.package_audit(entries).collect()}
    assert found == {("utf16", "dtd"), ("control", "unsafe-path"), ("mismatch", "header-mismatch"), ("twice", "duplicate"), ("many", "ratio")}
    assert entries.where("doc_id = 'many' and name = 'word/z.bin'").first().crc_ok is None  # never expanded
    assert entries.where("doc_id = 'fine' and name = 'word/y.xml'").first().xml_depth == 1


def _twice():
    import warnings

    data = io.BytesIO()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with zipfile.ZipFile(data, "w") as z:
            for name, text in (("[Content_Types].xml", "<Types/>"), ("word/document.xml", BODY), ("word/document.xml", BODY)):
                z.writestr(name, text)
    return data.getvalue()


def test_styles_switches_and_relationships(spark):
    styles = f'<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="24"/><w:rFonts w:ascii="Arial"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:styleId="A" w:default="1"><w:rPr><w:b w:val="False"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:i/></w:rPr></w:style></w:styles>'
    docs = table(spark, a=package(**{"word/styles.xml": styles}))
    rows = {r.style: r for r in S.read_styles(docs).collect()}
    assert rows["A"].b is False and rows["A"].based_on == "" and rows["A"].is_default and rows["B"].based_on == "A" and rows[""].sz == 12.0 and rows[""].font_ascii == "Arial"
    from quirelake.operators import layout

    near = {r.style: r for r in layout.resolve_styles(S.read_styles(docs), ["sz", "b", "i"]).collect()}
    assert (near["B"].sz, near["B"].b, near["B"].i) == (12.0, False, True)
    schema = "doc_id string, part string, id string, type string, target string, mode string"
    before = spark.createDataFrame([("a", "p", "1", "t/image", "x", "Internal"), ("a", "p", "2", "t/image", "y", "Internal")], schema)
    after = spark.createDataFrame([("a", "p", "1", "t/image", "http://z", "Internal"), ("a", "p", "3", "t", "q", "Internal"), ("a", "p", "3", "t", "r", "Internal")], schema)
    assert sorted(map(tuple, S.relationship_audit(before, after, spark.createDataFrame([("a", "p", "2")], "doc_id string, part string, id string")).collect())) == [("a", "p", "1", "changed"), ("a", "p", "3", "repeated")]
    entries = S.package_entries(table(spark, a=package(**{"word/_rels/document.xml.rels": "<Relationships/>"})))
    assert [r.safe for r in S.safe_to_render(entries, after).collect()] == [False] and [r.safe for r in S.safe_to_render(entries, before).collect()] == [True]
    levels = "doc_id string, num_id string, ilvl int, fmt string, lvl_text string, start int"
    a = spark.createDataFrame([("a", "1", 0, "lowerLetter", "(%1)", 3), ("a", "1", 1, "decimal", "%1", 1)], levels)
    b = spark.createDataFrame([("a", "1", 0, "chineseCounting", "（%1）", 3), ("a", "1", 1, "decimal", "%1", 2)], levels)
    rule = spark.createDataFrame([("a", "1", 0, "chineseCounting", "（%1）")], "doc_id string, num_id string, ilvl int, fmt string, lvl_text string")
    assert [tuple(r) for r in S.level_audit(a, b, rule).collect()] == [("a", "1", 1, "start")]


def test_reports_are_kept(spark, tmp_path):
    from quirelake.sources.sinks import write_reports

    out, schema = f"{tmp_path}/reports", "doc_id string, doc_type string, status string"
    assert write_reports(spark.createDataFrame([("a", "t", "one"), ("b", "t", "one")], schema), out) == 2
    assert write_reports(spark.createDataFrame([("b", "t", "two"), ("c", "t", "two")], schema), out) == 1
    assert write_reports(spark.createDataFrame([("a", "t", "three")], schema), out, overwrite=True) == 1
    assert sorted((r.doc_id, r.status) for r in spark.read.json(out).collect()) == [("a", "three"), ("b", "one"), ("c", "two")]


def test_audit_and_problems_parse_once(spark):
    docs = spark.createDataFrame([("a", b"no package"), ("b", b""), ("c", package(**{"word/document.xml": b"<d/>"}))], "doc_id string, content binary")
    audit = S.package_audit(S.package_entries(docs))
    assert audit._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.rule) for r in audit.collect() if r.doc_id != "c"} == {("a", "unreadable"), ("b", "unreadable")}
    again = S.package_problems(docs.union(docs.where("doc_id = 'a'")))
    assert sorted((r.doc_id, r.problem) for r in again.where("problem is not null").collect()) == [("a", "unreadable"), ("a", "unreadable"), ("b", "unreadable")]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
