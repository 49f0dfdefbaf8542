"""Two runs are compared with two joins, dealt by the rows of the tables; odd keys stay apart."""

from quirelake.operators import snapshots as X

SCHEMA = "k long, r int, size long, blocked boolean"


def test_flags_need_no_join(spark):
    a = spark.createDataFrame([(1, 1, 5, False), (1, 2, 6, None), (2, 1, 5, True), (3, 1, 5, None), (4, None, 1, False), (5, 1, 1, False), (5, 1, 2, False), (None, 1, 5, True)], SCHEMA)
    b = spark.createDataFrame([(1, 1, 5, False), (1, 3, 6, False), (2, 1, 5, False), (3, 1, 6, True), (4, None, 1, False), (5, 1, 2, None), (6, 1, 1, True), (None, 1, 5, True)], SCHEMA)
    found = X.compare_runs(a, b, "k", "r", ["size"], parts=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2
    assert sum(", 5), REPARTITION_BY_NUM" in line for line in plan.splitlines()) >= 3, [line for line in plan.splitlines() if "Exchange" in line]
    rows = sorted((tuple(r) for r in found.collect()), key=str)
    assert rows == sorted([
        (None, None, "blocked", "true", "false"), (None, None, "blocked", "false", "true"), (2, None, "blocked", "true", "false"), (3, None, "blocked", "false", "true"), (6, None, "blocked", "false", "true"),
        (1, 2, "missing", None, None), (1, 3, "extra", None, None), (4, None, "missing", None, None), (4, None, "extra", None, None), (5, 1, "size", "1", "2"),
    ], key=str)
