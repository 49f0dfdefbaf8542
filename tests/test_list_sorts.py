"""Labels of a list keep its order: one sort, whatever levels it has."""

from pyspark.sql import functions as F

from quirelake.operators import sequences as S


def test_list_labels_sort_once(spark, monkeypatch):
    levels = [0, 1, 1, 2, 1, 2, 2, 0, 2, 1, 2, 0, 1]
    items = spark.createDataFrame([(d, i, "ab"[(i + d) % 5 % 2], v) for d in range(3) for i, v in enumerate(levels)], "doc int, idx int, list string, level int")
    few = S.list_labels(items, ["doc"], "idx", "list", "level", F.col("doc"))
    assert few._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    with monkeypatch.context() as m:
        m.setattr(S, "SORTED_LEVELS", 0)
        many = S.list_labels(items, ["doc"], "idx", "list", "level", F.col("doc"))
    assert few.schema == many.schema and few.exceptAll(many).isEmpty() and few.count() == many.count()
