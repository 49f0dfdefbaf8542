"""Report and ledger sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_reports(reports: DataFrame, out: str, overwrite: bool = False) -> int:
    """One JSON line per document, in folders by document type and document; the number written.

    Without overwrite, documents that have a report keep it and the others are added; with it, only the folders of the
    given documents are replaced.
    """
    spark = reports.sparkSession
    rows = reports.withColumn("_doc", F.col("doc_id").cast("string"))
    if not overwrite:
        try:
            there = spark.read.json(out).select("doc_type", F.col("_doc").cast("string")).distinct()
        except Exception as problem:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER_SCHEMA" not in str(problem):
                raise
        else:
            rows = rows.join(there.hint("merge"), ["doc_type", "_doc"], "left_anti")
    rows = rows.persist()
    n = rows.count()
    writer = rows.write.partitionBy("doc_type", "_doc")
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").json(out)
    else:
        writer.mode("append").json(out)
    rows.unpersist()
    return n


def write_ledger(ledger: DataFrame, out: str, overwrite: bool = False) -> None:
    ledger.write.mode("overwrite" if overwrite else "errorifexists").parquet(out)
