"""Arriving packages: each file is read, audited and recognised once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelake.operators.recognition import header, models
from quirelake.sources.packages import LIMITS, failures, package_audit, package_entries, parse_paragraphs, sound

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_ingest(spark: SparkSession, path: str, checkpoint: str, out: str, doc_type: str | None = None, vocabulary: dict | None = None, limit: int = LIMITS["upload"]) -> StreamingQuery:
    """What has arrived below path since the last run, by batch, each batch in folders of its own that a retry replaces:

    findings (package_audit), paragraphs of the packages that passed and could be parsed, ledger (doc_id, status, error:
    too-large, unsafe-package or what the parser says), and, where doc_type is given, models (recognised fields). A
    package fails alone: it has its row in the ledger, and the others and the next batch go on.
    """
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.docx").load(path)
    files = files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))

    def batch(df: DataFrame, number: int) -> None:
        def stored(rows: DataFrame, name: str) -> DataFrame:
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
            return spark.read.parquet(f"{out}/{name}/batch={number}")

        df = df.select(F.col("path").alias("doc_id"), "length", "content").persist()
        docs = df.where(F.col("length") <= limit)
        findings = stored(package_audit(package_entries(docs)), "findings")
        bad = findings.select("doc_id").distinct()
        parsed = stored(parse_paragraphs(docs.join(bad.hint("merge"), "doc_id", "left_anti")), "parsed")
        paragraphs = stored(sound(parsed), "paragraphs")
        errors = failures(parsed).union(bad.select("doc_id", F.lit("unsafe-package"))).union(df.where(F.col("length") > limit).select("doc_id", F.lit("too-large")))
        ledger = df.select("doc_id").join(errors.withColumnRenamed("problem", "error").hint("merge"), "doc_id", "left")
        stored(ledger.select("doc_id", F.when(F.col("error").isNull(), "OK").otherwise("FAILED").alias("status"), "error"), "ledger")
        if doc_type:
            stored(models(header(paragraphs.where("region = 'flow'").select("doc_id", "para_idx", "text"), doc_type, vocabulary)), "models")
        df.unpersist()

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
