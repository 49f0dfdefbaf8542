"""What a task holds: few sorts, and partitions by the rows of a table."""

from pyspark.sql import functions as F

from quirelake.operators import damage as D
from quirelake.plans import suites


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merging_sorts_once(spark):
    texts = ["x：", "（子）a：", "（丑）b：  ", "（甲）c；", "（子）d；", "y：　\n", "（寅）e；", "（卯）f；", None, "（子）g"]
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, idx int, text string")
    merged = D.merge_subclauses(p)
    assert executed(merged).count("Sort [") == 1
    assert [r.text for r in merged.orderBy("idx").collect()] == ["x：（子）a：", "（丑）b：  （甲）c；", "（子）d；", "y：　\n（寅）e；", "（卯）f；", None, "（子）g"]


def test_partitions_follow_the_rows(spark, monkeypatch):
    df = spark.range(1000).withColumn("k", F.col("id") % 100)
    assert suites.spread(df, 1000, "k") is df
    monkeypatch.setattr(suites, "TASK_ROWS", 50)
    assert suites.spread(df, 1000, "k").rdd.getNumPartitions() == 20
    assert suites.spread(df, 10_000, "k").rdd.getNumPartitions() == 200
