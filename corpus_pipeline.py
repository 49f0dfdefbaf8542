"""Corpus pipeline: documents through the stages below, each written as Parquet and reread as the next one's input.

Every stage applies one operator of quirelake.llm to all that its predecessor kept, and its verdict takes effect: the
classifier, near-dedup and decontamination drop rows, substring dedup shortens texts (a text that loses all its words
goes), packing returns the pieces. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import bundled, lean, unbundled, written
from quirelake.llm.decontaminate import decontaminate
from quirelake.llm.near_dedup import without_copies
from quirelake.llm.packing import pack
from quirelake.llm.quality_classifier import classify
from quirelake.llm.substring_dedup import deduplicate

#: Words of a shingle in the near-duplicate stage; the query op6 takes 2.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    lean(spark)
    judged = classify(bundled(docs, "source", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unbundled(judged.where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id. Rows are judged by their own text, so
    of rows that repeat an id with other texts each stays or goes with its group; of equal rows one stays."""
    lean(spark)
    return unbundled(without_copies(bundled(docs), size=SHINGLE), docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that repeat an earlier span; n_chars follows the text."""
    lean(spark)
    short = deduplicate(bundled(docs)).where("kept")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("_rest.n_chars"))
    return unbundled(short, docs.columns, n_chars=n_chars)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    lean(spark)
    found = decontaminate(bundled(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unbundled(found.where("kept"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences."""
    lean(spark)
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]
#: Tokenisation and similarity by sketches have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
