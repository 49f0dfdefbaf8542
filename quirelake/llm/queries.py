"""Registered queries of the corpus operators: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.substring_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "kept", "item_id", "overlap", "n_items")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.near_dedup import cluster

    return cluster(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.katz_words import score

    return score(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.quality_rules import rate

    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.quality_classifier import classify

    judged = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "evidence", "site_posterior", "posterior", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.piece_codec import digests, encode_decode

    return digests(encode_decode(table(spark, sf_dir, "documents")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.source_divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.llm.conversation_repair import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")), times="times")


def queries() -> dict:
    return {f.__name__: f for f in (op1_html_extraction, op2_license_scan, op3_sharding, op4_substring_dedup, op5_decontamination, op6_near_dedup, op7_lm_scoring, op8_quality_rules, op9_quality_classifier, op10_packing, op11_sentencepiece, op12_source_divergence, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    from quirelake.llm import source_divergence

    return {"op12_source_divergence": source_divergence.SQL}
