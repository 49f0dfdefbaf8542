"""Helpers shared by the corpus operators: shared scratch tables, sized joins and byte-level word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many narrow rows may be broadcast; beyond it joins are sort-merge joins.
BROADCAST_ROWS = 500_000

#: Settings under which tables are written: a query's shuffle files go when it ends, and Python workers get few rows and
#: bytes at a time, as a row may be a long text or a large set.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Java regular expression of the blanks that separate words.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session may do without: it gets one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quirelake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for written tables."""
    return f"{shared_dir(spark)}/quirelake/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. Its shuffle files go when it is written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WHILE_WRITING}
    try:
        for k, v in WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def lean(spark: SparkSession) -> None:
    """From now on this session's Python workers get few rows and bytes at a time, whatever action reads a lazy result.

    Long texts in batches of the usual 10,000 rows take a few hundred MB of an executor's memory outside its heap.
    """
    for k, v in WHILE_WRITING.items():
        if ".arrow." in k:
            spark.conf.set(k, v)


def discard(table: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application has written; call it when the results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint for a written table of narrow rows: broadcast if it has at most limit rows, else sort-merge."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table.hint("merge")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """Words of a text: maximal runs without blanks; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def byte_words(text: str | None) -> list[bytes]:
    """The same words, A-Z lower-cased, as UTF-8 bytes; bytes.split cuts at exactly the blanks of BLANKS."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


def bundled(docs: DataFrame, *beside: str) -> DataFrame:
    """doc_id, text and the columns of `beside`; all columns but doc_id and text in a struct, safe from clashing names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *beside, F.struct(*rest, F.lit(True).alias("_")).alias("_rest"))


def unbundled(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that bundled() took, doc_id and text as they are now, others as given in `changed`."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else changed[c].alias(c) if c in changed else F.col(f"_rest.`{c}`") for c in columns])
