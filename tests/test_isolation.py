"""Broken packages fail alone, exact alignments, orders of labels, long style chains, and the hierarchy's lists."""

import io
import itertools
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quirelake.operators import folds, layout
from quirelake.operators.audits import mark_notes, uniform_damage
from quirelake.operators.names import ordered_columns
from quirelake.sources import packages as S
from quirelake.streaming.ingest import stream_ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(*lines, body=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", body or f"<w:document {W}><w:body>{''.join(f'<w:p><w:r><w:t>{x}</w:t></w:r></w:p>' for x in lines)}</w:body></w:document>")
    return out.getvalue()


@pytest.fixture(scope="module")
def docs(spark):
    made = {"good": package("a", "b"), "malformed": package(body="<w:document><w:p></w:document>"), "none": b"PK", "also": package("c"), "value": package(body=f'<w:document {W}><w:body><w:p><w:pPr><w:numPr><w:ilvl w:val="x"/><w:numId w:val="3"/></w:numPr></w:pPr></w:p></w:body></w:document>'), "empty": None}
    return spark.createDataFrame([(k, v if v is None else bytearray(v)) for k, v in made.items()], "doc_id string, content binary")


def test_one_broken_package_fails_alone(docs):
    parsed = S.parse_paragraphs(docs)
    assert sorted((r.doc_id, r.text) for r in S.sound(parsed).collect()) == [("also", "c"), ("good", "a"), ("good", "b")]
    assert sorted(map(tuple, S.failures(parsed).collect())) == [("empty", "unreadable"), ("malformed", "malformed-xml"), ("none", "unreadable"), ("value", "invalid-value")]
    assert {r.doc_id for r in S.read_runs(docs).collect()} == {"also", "good"}
    assert S.read_relationships(docs).count() == 0 and S.read_styles(docs).count() == 0
    assert sorted((r.doc_id, r.rule) for r in S.package_audit(S.package_entries(docs)).collect()) == [("empty", "unreadable"), ("malformed", "malformed-xml"), ("none", "unreadable")]


def test_directory_of_packages(spark, tmp_path):
    for name, content in {"a.docx": package("x"), "~$a.docx": b"owner", "b.docx": b"not a zip", "c.txt": b"no", "large.docx": b"0" * 5000}.items():
        (tmp_path / name).write_bytes(content)
    found, large = S.read_package_dir(spark, str(tmp_path), "draft-resolution", limit=4000)
    assert sorted(r.source_name for r in found.collect()) == ["a.docx", "b.docx"]
    assert [(r.source_name, r.length) for r in large.collect()] == [("large.docx", 5000)]
    assert [r.text for r in S.read_paragraphs(found).collect()] == ["x"]


def test_stream_goes_on_behind_a_broken_package(spark, tmp_path):
    (tmp_path / "in").mkdir()
    vocabulary = {"en": {"preambulatory": ["Noting"], "operative": ["Requests"]}, "zh": {"preambulatory": [], "operative": []}}

    def run():
        stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out"), "draft-resolution", vocabulary, limit=6000).awaitTermination(120)

    (tmp_path / "in/good.docx").write_bytes(package("Draft Resolution 1", "Committee: First", "Noting this"))
    (tmp_path / "in/malformed.docx").write_bytes(package(body="<a><b></a>"))
    (tmp_path / "in/value.docx").write_bytes(package(body=f'<w:document {W}><w:body><w:p><w:pPr><w:numPr><w:ilvl w:val="x"/><w:numId w:val="3"/></w:numPr></w:pPr></w:p></w:body></w:document>'))
    (tmp_path / "in/~$good.docx").write_bytes(b"owner")
    (tmp_path / "in/large.docx").write_bytes(b"0" * 7000)
    run()
    (tmp_path / "in/next.docx").write_bytes(package("Draft Resolution 2", "Committee: Second"))
    run()
    name = F.element_at(F.split("doc_id", "/"), -1).alias("name")
    ledger = {r.name: (r.status, r.error) for r in spark.read.parquet(str(tmp_path / "out/ledger")).select(name, "status", "error").collect()}
    assert ledger == {"good.docx": ("OK", None), "malformed.docx": ("FAILED", "unsafe-package"), "value.docx": ("FAILED", "invalid-value"), "large.docx": ("FAILED", "too-large"), "next.docx": ("OK", None)}
    models = {r.name: r.committee for r in spark.read.parquet(str(tmp_path / "out/models")).select(name, "committee").collect()}
    assert models == {"good.docx": "First", "next.docx": "Second"}


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_longest_common_subsequence(spark):
    draw = random.Random(2)
    for _ in range(400):
        a, b = ([draw.randint(0, draw.choice([1, 3, 9])) for _ in range(draw.randint(0, 40))] for _ in range(2))
        pairs = folds.common_subsequence(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
        assert len(pairs) == longest(a, b)
    texts = {d: [[draw.choice("abc") for _ in range(draw.randint(0, 30))] for _ in range(2)] for d in range(40)}
    side = lambda k: spark.createDataFrame([(d, i, t) for d, both in texts.items() for i, t in enumerate(both[k])], "doc_id int, idx int, text string")
    steps = folds.aligned(side(0), side(1)).collect()
    for d, (a, b) in texts.items():
        mine = [s for s in steps if s.doc_id == d]
        assert sum(s.equal for s in mine) >= longest(a, b)  # a gap may pair equal lines besides
        assert sorted(s.a for s in mine if s.a is not None) == list(range(len(a))) and sorted(s.b for s in mine if s.b is not None) == list(range(len(b)))


def test_a_long_alignment_needs_little_memory():
    draw = random.Random(4)
    a = [draw.randint(0, 50) for _ in range(6000)]
    b = [x for x in a if draw.random() > 0.1]
    assert len(folds.common_subsequence(a, b)) == len(b)


def test_labels_keep_the_order_of_names(spark):
    draw = random.Random(1)
    blocks = [(k, sorted(float(draw.randint(0, 12)) for _ in range(draw.randint(0, 6))), sorted(float(draw.randint(0, 12)) for _ in range(draw.randint(1, 6)))) for k in range(200)]
    got = {r.k: r.c for r in spark.createDataFrame(blocks, "k int, n array<double>, l array<double>").select("k", ordered_columns(F.col("n"), F.col("l")).alias("c")).collect()}
    for k, names, labels in blocks:
        ways = [(sum(abs(labels[c] - n) for c, n in zip(w, names, strict=True)), list(w)) for w in itertools.combinations(range(len(labels)), len(names))] if names else []
        assert got[k] == (min(ways)[1] if ways else None)


def test_chains_of_styles(spark):
    chain = [(1, f"s{i}", f"s{i - 1}" if i else None, 7 if i == 0 else 9 if i == 3000 else None) for i in range(5000)]
    cycle = [(2, "a", "b", None), (2, "b", "c", None), (2, "c", "a", 5), (2, "self", "self", None), (2, "lost", "nowhere", 3)]
    got = {(r.doc_id, r.style): r.size for r in layout.resolve_styles(spark.createDataFrame(chain + cycle, "doc_id int, style string, based_on string, size int"), ["size"]).collect()}
    assert all(got[1, f"s{i}"] == (7 if i < 3000 else 9) for i in range(5000))
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {"a": 5, "b": 5, "c": 5, "self": None, "lost": 3}


def test_a_known_list_registers_no_family(spark):
    """A list that goes on under another family does not take a level for that family."""
    items = [(1, 0, "1. x:", "decimal", 0, None, True), (1, 1, "（一）", "chinese", 1, "L", False), (1, 2, "(a)", "letter", 1, "L", False), (1, 3, "(b)", "letter", 1, None, False)]
    df = spark.createDataFrame([(*x, False) for x in items], "doc_id int, idx int, text string, family string, level int, list_key string, top boolean, reset boolean")
    got = [(r.planned_level, r.reason) for r in folds.plan_hierarchy(df, "en").orderBy("idx").collect()]
    assert got == [(0, ""), (1, ""), (1, ""), (1, folds.SHARED)]


def test_blank_runs_hide_no_damage(spark):
    runs = spark.createDataFrame([(1, 0, "a", True, False), (1, 0, "　", False, False), (1, 1, "b", True, True), (2, 0, "c", True, False), (2, 1, "d", None, True), (2, 2, " ", True, True), (3, 0, " ", True, True)], "doc int, para int, text string, h boolean, s boolean")
    assert sorted(tuple(r) for r in uniform_damage(runs, "doc", F.col("h")).collect()) == [(1, True, 2, 2), (2, False, 1, 2)]
    assert sorted(tuple(r) for r in mark_notes(runs, ["doc", "para"], "doc", F.col("h"), F.col("s")).collect()) == [(1, 1, "struck"), (2, 0, "hidden"), (2, 1, "struck")]
