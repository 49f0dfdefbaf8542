"""Operators on small tables with exact expected values."""

import random

from pyspark.sql import functions as F

from quirelake.functions import numerals as N
from quirelake.functions import text as T
from quirelake.operators import audits as A
from quirelake.operators import names as M
from quirelake.operators import sequences as S


def values(spark, rows, column, schema="text string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_detect_language(spark):
    assert values(spark, ["联合国大会", "The Assembly", "一带一路 in a long English sentence here", "", None, "中a"], T.detect_language(F.col("text"))) == ["zh", "en", "en", "en", "en", "en"]


def test_label_value(spark):
    found = values(spark, ["Topic: Water ", "议题：水", "代表国家: 法国", "代表：张", "No label", "Topics: x"], T.label_value(F.col("text")))
    assert [x and tuple(x) for x in found] == [("topic", "Water"), ("topic", "水"), ("country", "法国"), ("delegate", "张"), None, None]


def test_titles(spark):
    texts = ["Draft Resolution 1.2", "决议草案", "Draft resolution on water", "决议草案 [编号]", "Draft Resolution Final"]
    assert values(spark, texts, T.looks_like_title(F.col("text"), "draft-resolution")) == [True, True, False, True, True]
    assert tuple(values(spark, ["Friendly Amendment 1.2.1"], T.title_parts(F.col("text"), "friendly-amendment"))[0]) == ("Friendly Amendment", " 1.2.1")


def test_starts_body(spark):
    texts = ["1. Calls upon", "第一条 决定", "Only five words are here.", "This one has six good words.", "Topic: what is it?", "Is it?", "Security Council", ""]
    assert values(spark, texts, T.starts_body(F.col("text"))) == [True, True, False, True, False, True, False, False]


def test_fragments_and_endings(spark):
    assert values(spark, ["（一）各国 应_当！", "1. Große Straße", None, "a）决定", "1.\tx", "a)b", "12  x"], T.canonical_fragment(F.col("text"))) == ["各国应当", "grossestrasse", "", "决定", "x", "ab", "x"]
    assert values(spark, ["a)\tx", "1.\tCalls", "a)x"], T.starts_body(F.col("text"))) == [True, True, False]
    assert values(spark, ["Ab，。", "한\t(’)", None], T.width_em(F.col("text")).cast("string")) == ["3.2", "3.9", "0.0"]
    assert values(spark, ["决定；", "decide.  ", "decide.\n", "a.）"], T.without_ending(F.col("text"))) == ["决定", "decide", "decide\n", "a.）"]
    assert values(spark, ["决定；", "decide", "x;  \n", "；"], T.set_ending(F.col("text"), "。")) == ["决定。", "decide。", "x。\n", "；"]


def test_marker_texts(spark):
    numbers = lambda lang, level, n: values(spark, [n], N.marker_text(lang, level, F.col("text")), "text int")[0]
    assert [numbers("en", i, 4) for i in range(4)] == ["4.", "(d)", "(iv)", "iv."]
    assert numbers("zh", 2, 13) == "（子子）" and numbers("zh", 3, 11) == "（甲甲）" and numbers("zh", 0, 21) == "第二十一条"
    assert numbers("en", 1, 27) is None and numbers("en", 0, 100) is None


def test_markers_round_trip(spark):
    df = spark.range(1, 100).select(F.col("id").cast("int").alias("n"))
    for family in ("chinese", "zodiac", "stem", "roman"):
        token = N.to_numeral(F.col("n"), family)
        assert df.where(N.from_numeral(token, family) != F.col("n")).count() == 0


def test_marker_of(spark):
    texts = ["1.5 million", "1.1", "12. Calls", "123. no", "(i) one", "（c）", "第三条 x", "(12) y", "iv. z", "（子子）", "word", "007. x"]
    found = [x and (x.family, x.value) for x in values(spark, texts, N.marker_of(F.col("text")))]
    assert found == [None, None, ("decimal", 12), None, ("letter", 9), ("letter", 3), ("article", 3), ("paren-decimal", 12), ("roman-dot", 4), ("zodiac", 13), None, ("decimal", 7)]
    assert [x and (x.family, x.value) for x in values(spark, ["(i) one"], N.marker_of(F.col("text"), F.lit(True)))] == [("roman", 1)]
    pairs = spark.createDataFrame([("（c） x；", "（三） x。"), ("(c) x", "(d) x"), ("(i) x", "(i) y")], "a string, b string")
    assert [r[0] for r in pairs.select(N.valid_marker_change(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def fold(items):
    """The fold that the window form must equal."""
    last, issues, previous = {}, [], None
    for i, (level, value) in enumerate(items):
        for key in [k for k in last if k > level]:
            del last[key]
        restart = value == 1 and previous is not None and previous[0] < level
        if level in last and value != last[level] + 1 and not restart:
            issues.append((i, last[level]))
        last[level] = value
        previous = (level, value)
    return issues


def test_sequence_issues_equal_fold(spark):
    random.seed(3)
    docs = {d: [(random.randrange(3), random.randrange(1, 4)) for _ in range(12)] for d in range(200)}
    rows = [(d, i, lv, "x", v) for d, items in docs.items() for i, (lv, v) in enumerate(items)]
    df = spark.createDataFrame(rows, "doc long, idx int, level int, family string, value int")
    found = {(r.doc, r.idx, r.previous) for r in S.sequence_issues(df, ["doc"]).collect()}
    assert found == {(d, i, p) for d, items in docs.items() for i, p in fold(items)}


def test_quote_depth_equal_fold(spark):
    random.seed(4)
    rows = [(d, i, random.choice([-1, 0, 1])) for d in range(50) for i in range(30)]
    found = {(r.d, r.i): r.depth for r in S.quote_depth(spark.createDataFrame(rows, "d int, i int, s int"), ["d"], ["i"], F.col("s")).collect()}
    for d in range(50):
        depth = 0
        for x, i, s in rows:
            if x == d:
                depth = max(0, depth + s)
                assert found[(d, i)] == depth


def test_header(spark):
    rows = ["Draft Resolution 1", "Topic: Water", "Topic: Air", "Security Council", "1. Calls upon all", "Topic: not a header"]
    p = spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "doc_id long, para_idx int, text string")
    assert tuple(S.header_bounds(p, "draft-resolution").first()) == (1, 0, 4, 1)
    assert [tuple(r) for r in S.header_fields(p, "draft-resolution").collect()] == [(1, "topic", "Air", 2)]


def test_names(spark):
    gazetteer = spark.createDataFrame([(1, "People's Republic of China", "China"), (2, "United Kingdom", "UK"), (3, "Republic of the Congo", "Congo"), (4, "Democratic Republic of the Congo", "Congo")], "id int, display string, short string")
    index = M.name_index(gazetteer, ["display", "short"])
    names = spark.createDataFrame([(0, "ｕｋ"), (1, "china "), (2, "Congo"), (3, "Atlantis"), (4, "People’s Republic of China")], "pos int, name string")
    found = {r.pos: (r.status, r.id) for r in M.resolve_names(names, index).collect()}
    assert found == {0: ("resolved", 2), 1: ("resolved", 1), 2: ("ambiguous", None), 3: ("unknown", None), 4: ("resolved", 1)}
    kept = M.dedupe_names(M.resolve_names(names, index).withColumn("doc", F.lit(1)), ["doc"], "pos")
    assert sorted(r.pos for r in kept.collect()) == [0, 1, 2, 3]


def test_secrets(spark):
    rows = [(0, "AKIA" + "A" * 16), (1, 'password = "hunter2hunter2"'), (2, 'password = "example-value"'), (3, "a@example.com b@corp.io"), (4, "ghp_" + "a" * 24), (5, None)]
    found = sorted((r.i, r.rule) for r in A.secret_scan(spark.createDataFrame(rows, "i int, text string"), ["i"]).collect())
    assert found == [(0, "aws-access-key"), (1, "literal-credential-review"), (3, "personal-email-review"), (4, "github-token")]


def test_duplicates(spark):
    docs = spark.createDataFrame([(1, "Straße 1\nB"), (2, "STRASSE 1\r\nb!"), (3, "other"), (4, None)], "doc_id long, text string")
    assert [(r.first_doc, r.n) for r in A.duplicate_groups(A.document_fingerprint(docs)).collect()] == [(1, 2)]
