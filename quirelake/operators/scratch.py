"""Cutting the lineage of iterative operators, and settings of a session: batches of Python workers, sizes of methods."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What a Python worker gets at a time: a row may be a package of 20 MiB.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "200", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Python workers get few rows and bytes at a time, whatever action reads a lazy result."""
    for k, v in BATCHES.items():
        spark.conf.set(k, v)


def short_methods(spark: SparkSession) -> None:
    """From now on this session makes no methods of more than 8,000 bytes of code: the JVM only interprets such."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to the folder that driver and executors share (spark.checkpoint.dir).

    Only a local session may do without that setting: it gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not where:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="quirelake-")
        context.setCheckpointDir(where)
    return df.checkpoint()
