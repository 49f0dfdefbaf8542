"""Texts are judged before they are shuffled."""

from quirelake.operators import layout as L


def test_texts_stay_behind(spark):
    long = "这一段正文很长，超过了二十五个字，因此它前面的短行可以是一个小标题。"
    rows = [(1, 0, "委员会："), (1, 1, "背景"), (1, 2, long), (1, 3, "（二）建议"), (1, 4, long), (2, 0, "（一）背景"), (2, 1, long), (2, 2, "（二）建议")]
    found = L.missing_first_section(spark.createDataFrame(rows, "doc_id int, para_idx int, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not any("text#" in line for line in plan.splitlines() if "Exchange" in line or "Window [" in line)
    assert [tuple(r) for r in found.collect()] == [(1, 3, 1, 0.94)]
