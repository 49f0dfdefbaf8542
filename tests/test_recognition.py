"""Recognition of whole documents: the sample papers and what has to be found in them."""

import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import names as M
from quirelake.operators import recognition as R

VOCABULARY = {
    "zh": {"preambulatory": ["回顾", "注意到", "支持"], "operative": ["要求", "决定", "鼓励", "建议", "修改", "加入", "支持"]},
    "en": {"preambulatory": ["Recalling", "Recognizing"], "operative": ["Requests", "Decides", "Encourages", "Add"]},
}
#: Sample papers by type, one paragraph a line, and the fields found in them.
SAMPLES = {
    1: ("position-paper", "立场文件\n委员会：联合国环境大会\n议题：塑料污染治理\n国家/席位：日本国\n代表：示例代表\n塑料污染跨越国界，需要多边合作与可执行的时间表。", {"language": "zh", "committee": "联合国环境大会", "topic": "塑料污染治理", "country": "日本国", "delegate": "示例代表"}),
    4: ("working-paper", "WORKING PAPER [number]\nCommittee: United Nations Environment Assembly\nTopic: Plastic Pollution\nSponsors: Japan, Brazil, Canada\n1. Establishes a technical exchange platform\n(a) Collects replicable practices\n(i) Reports progress every six months\n2. Encourages voluntary financial support", {"language": "en", "committee": "United Nations Environment Assembly", "topic": "Plastic Pollution", "sponsors": ["Japan", "Brazil", "Canada"]}),
    6: ("draft-directive", "Draft Directive [number]\nCommittee: Security Council\nSponsors: Japan, France, Brazil\nSignatories: Canada, Australia\nThe Committee,\n1. Requests the Secretary-General to report within forty-eight hours\n2. Decides to establish a temporary coordination mechanism", {"language": "en", "committee": "Security Council", "sponsors": ["Japan", "France", "Brazil"], "signatories": ["Canada", "Australia"]}),
    7: ("draft-resolution", "决议草案 [编号]\n委员会：联合国大会\n议题：塑料污染治理\n起草国：日本国，中国，巴西联邦共和国\n附议国：加拿大，澳大利亚\n联合国大会，\n回顾大会关于海洋环境保护的相关决议，\n注意到塑料污染对沿海社区造成的影响，\n第一条 要求各会员国制定可衡量的国家行动计划；\n（一）鼓励在计划中列明阶段性目标；\n（子）建议明确阶段性目标的核验方法；\n（甲）要求每年提交一次执行说明；\n第二条 决定在现有资源范围内建立信息共享机制。", {"language": "zh", "committee": "联合国大会", "topic": "塑料污染治理", "sponsors": ["日本国", "中国", "巴西联邦共和国"], "signatories": ["加拿大", "澳大利亚"]}),
    10: ("unfriendly-amendment", "非友好修正案 [编号]\n委员会：联合国大会\n议题：塑料污染治理\n起草国：法国\n附议国：加拿大，澳大利亚\n1. 修改第二条，将“每年”改为“每两年”。", {"language": "zh", "committee": "联合国大会", "topic": "塑料污染治理", "sponsors": ["法国"], "signatories": ["加拿大", "澳大利亚"]}),
    20: ("draft-resolution", "Draft Resolution\nSecurity Council\nSponsors: France,\nthe Kingdom of X, Republic of Y\nThe Security Council,\nRecalling its past,\nDecides to act:\n(a) now;\n1. Requests more.", {"language": "en", "committee": "Security Council", "sponsors": ["France", "the Kingdom of X", "Republic of Y"]}),
    21: ("position-paper", "Position Paper\nAssembly\nWater\nFrance\nAnn Person\nThis is the text of the paper and it ends here.\nTopic: not a header", {"language": "en", "committee": "Assembly", "topic": "Water", "country": "France", "delegate": "Ann Person"}),
}
LEVELS = {4: [0, 1, 2, 0], 6: [0, 0, 0], 7: [0, 0, 0, 0, 1, 2, 3, 0], 20: [0, 0, 0, 1, 0]}
KINDS = {7: ["heading"] + ["preambulatory"] * 2 + ["operative"] * 5, 6: ["heading", "operative", "operative"], 10: ["operative"], 20: ["heading", "preambulatory", "operative", "operative", "operative"]}


def paragraphs(spark, ids):
    rows = [(d, i, x) for d in ids for i, x in enumerate(SAMPLES[d][1].split("\n"))]
    return spark.createDataFrame(rows, "doc_id long, para_idx int, text string")


@pytest.mark.parametrize("document_type", sorted({t for t, *_ in SAMPLES.values()}))
def test_fields_and_clauses(spark, document_type):
    ids = [d for d, (t, *_) in SAMPLES.items() if t == document_type]
    headed = R.header(paragraphs(spark, ids), document_type, VOCABULARY)
    found = {r.doc_id: r for r in R.models(headed).collect()}
    for d in ids:
        expected = {"committee": None, "topic": None, "country": None, "delegate": None, "sponsors": [], "signatories": [], **SAMPLES[d][2]}
        assert {k: found[d][k] for k in expected} == expected, d
    rows = R.clauses(headed, document_type, VOCABULARY).orderBy("doc_id", "para_idx").collect()
    for d in ids:
        if d in LEVELS:
            assert [r.level for r in rows if r.doc_id == d] == LEVELS[d], d
        if d in KINDS:
            assert [r.kind for r in rows if r.doc_id == d] == KINDS[d], d


def test_roles_and_repeats(spark):
    headed = R.header(paragraphs(spark, [7, 20]), "draft-resolution", VOCABULARY)
    rows = R.roles(headed, R.clauses(headed, "draft-resolution", VOCABULARY), "draft-resolution").orderBy("para_idx").collect()
    assert [r.role for r in rows if r.doc_id == 7] == ["title", "committee", "topic", "sponsors", "signatories", "subject", "preamble", "preamble", "item", "item", "item", "item", "item"]
    assert [r.role for r in rows if r.doc_id == 20] == ["title", "committee", "sponsors", "header", "subject", "preamble", "prose", "item", "item"]
    assert [(r.doc_id, r.levels) for r in R.max_level(R.clauses(headed, "draft-resolution", VOCABULARY)).orderBy("doc_id").collect()] == [(7, 4), (20, 2)]
    twice = spark.createDataFrame([(1, i, x) for i, x in enumerate(["Draft Directive", "Sponsors: A Republic", "Sponsors: B Republic", "Topic: x", "Topic: y"])], "doc_id long, para_idx int, text string")
    assert [tuple(r) for r in R.repeated_header_fields(R.header(twice, "draft-directive", VOCABULARY)).collect()] == [(1, "sponsors", 2)]


def test_treaties(spark):
    texts = {
        12: ["日本国、巴西联邦共和国与加拿大关于海洋塑料污染监测合作的协定", "", "鉴于塑料污染跨越国界，三方达成协议如下：", "第一条 三方共同建立机制；", "", "日本国代表        巴西联邦共和国代表", "示例甲        示例乙"],
        13: ["日本国、法兰西共和国、巴西联邦共和国、加拿大", "就海洋塑料污染治理的联合声明", "四方在东京举行会谈，共同声明如下：", "四方同意每年举行一次会议。"],
        14: ["Joint Statement of Japan, Trinidad and Tobago and Canada on Ocean Plastic Monitoring", "The parties hereby declare as follows:", "The parties will share data.", "Representative of Japan    Representative of Canada", "Sample Delegate A    Sample Delegate B"],
    }
    p = spark.createDataFrame([(d, i, x) for d, lines in texts.items() for i, x in enumerate(lines)], "doc_id long, para_idx int, text string")
    index = M.name_index(spark.createDataFrame([(1, "Trinidad and Tobago"), (2, "Japan"), (3, "日本国"), (4, "大不列颠及北爱尔兰联合王国")], "id int, display string"), ["display"])
    parties = {r.doc_id: r.parties for r in R.split_parties(R.treaty_heads(R.title_lines(p)), index).collect()}
    assert parties == {12: ["日本国", "巴西联邦共和国", "加拿大"], 13: ["日本国", "法兰西共和国", "巴西联邦共和国", "加拿大"], 14: ["Japan", "Trinidad and Tobago", "Canada"]}
    body = R.treaty_body(p).groupBy("doc_id").agg(F.sort_array(F.collect_list("para_idx")).alias("i"))
    assert {r.doc_id: r.i for r in body.collect()} == {12: [2, 3], 13: [2, 3], 14: [1, 2]}


def test_name_continuation(spark):
    lines = ["法兰西共和国、日本国", "French Republic, the Kingdom of X", "The Executive Council,", "日本", "A Republic.", "7 States", "england"]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    assert [r[0] for r in df.select(R.is_name_continuation(F.col("text"), ["england"])).collect()] == [True, True, False, False, False, False, True]
    assert T.UNICODE


def test_native_lists_nest_behind_colons(spark):
    lines = [("item", 0, "1. Requests:", None), ("item", 0, "first", "7:0"), ("item", 0, "second:", "7:0"), ("item", 0, "own list", "7:0"), ("item", 0, "deeper:", "8:0"), ("prose", 0, "text", None), ("item", 0, "still", "8:0"), ("item", 1, "(a) typed", "8:0")]
    rows = spark.createDataFrame([(1, i, *x) for i, x in enumerate(lines)], "doc_id long, para_idx int, role string, level int, text string, list_key string")
    assert [r.level for r in R.nest_native_items(rows).orderBy("para_idx").collect()] == [0, 1, 1, 1, 0, 0, 0, 1]
    after = rows.withColumn("list_key", F.when(F.col("para_idx") == 4, "8:0").otherwise(F.col("list_key"))).where("para_idx <> 3")
    assert [r.level for r in R.nest_native_items(after).orderBy("para_idx").collect()] == [0, 1, 1, 2, 0, 2, 1]


def test_roles_in_one_pass(spark):
    """Roles without a join back to the rows, and without a second read of them: the same as from both tables."""
    for document_type in ("draft-resolution", "working-paper", "draft-directive", "position-paper"):
        ids = [d for d, sample in SAMPLES.items() if sample[0] == document_type]
        p = paragraphs(spark, ids).union(spark.createDataFrame([(d, 100, " ") for d in ids], "doc_id long, para_idx int, text string"))
        headed = R.header(p, document_type, VOCABULARY)
        once = R.document_roles(headed, document_type, VOCABULARY)
        both = R.roles(headed, R.clauses(headed, document_type, VOCABULARY), document_type)
        assert once.columns == both.columns
        assert sorted(map(str, once.collect())) == sorted(map(str, both.collect()))
        plan = once._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("LogicalRDD") <= 2


def test_levels_of_headings_alone(spark):
    """A document of headings has no levels; a document with one clause has one. The kind isn't worked out for a filter."""
    rows = [(1, 0, "heading", 0), (2, 0, "heading", 0), (2, 1, "operative", 0), (3, 0, "operative", 2)]
    c = spark.createDataFrame(rows, "doc_id long, para_idx int, kind string, level int")
    assert sorted(map(tuple, R.max_level(c).collect())) == [(2, 1), (3, 3)]
