"""Evaluation of runs: scores, excess error, roll-ups, ledgers, deterministic damage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators.damage import hit
from quirelake.operators.names import missing_fields
from quirelake.operators.sequences import top_k_per_group

#: Weights of the parts of a comparison.
WEIGHTS = {"content": 50.0, "ws": 2.0, "marker_kind": 1.0, "para": 3.0, "char": 0.2, "blank": 3.0, "page": 10.0, "noise": 1.0}


def weighted_score(parts: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    return parts.withColumn("score", F.round(sum((F.coalesce(c, F.lit(0)) * w for c, w in weights.items()), F.lit(0.0)), 1))


def excess_error(scores: DataFrame, case: str, variant: str, clean: str, blocked: Column) -> DataFrame:
    """Per variant: mean and largest excess over the clean run of the same case (100 more if blocked), and how many were blocked."""
    base = scores.where(F.col(variant) == clean).groupBy(case).agg(F.max("score").alias("base"))
    rows = scores.where(F.col(variant) != clean).join(base.hint("merge"), case).withColumn("excess", F.col("score") - F.col("base") + F.when(blocked, 100).otherwise(0))
    return rows.groupBy(variant).agg(F.round(F.avg("excess"), 2).alias("mean_excess"), F.round(F.max("excess"), 2).alias("max_excess"), F.count_if(blocked).alias("blocked"))


def diff_rollup(diffs: DataFrame, kind: str, order: list[Column], k: int, example: str) -> DataFrame:
    """Per kind: how many, and the first k examples in order."""
    counts = diffs.groupBy(kind).agg(F.count("*").alias("n"))
    first = top_k_per_group(diffs, [kind], order, k).groupBy(kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(example).cast("string").alias("e")))), lambda x: x.e), ",").alias("examples"))
    return counts.join(first, kind)


def value_pair_counts(rows: DataFrame, prop: str, x: str, y: str, example: str) -> DataFrame:
    return rows.groupBy(prop, x, y).agg(F.count("*").alias("n"), F.min(example).alias("example"))


def batch_ledger(results: DataFrame, group: str, ok: Column) -> DataFrame:
    """Rows per group and status, with totals (null group, null status)."""
    return results.withColumn("status", F.when(ok, "OK").otherwise("FAILED")).rollup(group, "status").agg(F.count("*").alias("n"))


def diagnostic_report(docs: DataFrame, findings: DataFrame, doc: str) -> DataFrame:
    """doc, status (failed, checked, not_run) and number of errors and warnings."""
    f = findings.groupBy(doc).agg(F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "warning").alias("warnings"))
    j = docs.select(doc).join(f.hint("merge"), doc, "left")
    status = F.when(F.col("errors").isNull(), "not_run").when(F.col("errors") > 0, "failed").otherwise("checked")
    return j.select(doc, status.alias("status"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def diagnostic_documents(models: DataFrame, clauses: DataFrame, findings: DataFrame, required: DataFrame) -> DataFrame:
    """One nested report per document: status, missing fields, number of paragraphs, clauses in order, findings.

    models: doc_id, doc_type, paragraphs and fields. clauses: doc_id, para_idx, kind, level, confidence, text. findings:
    doc_id, code, status, detail. required: doc_type, field.
    """
    fields = [c for c in models.columns if c not in ("doc_id", "doc_type", "paragraphs")]
    missing = missing_fields(models, required, fields).groupBy("doc_id").agg(F.sort_array(F.collect_list("field")).alias("missing"))
    listed = F.struct("para_idx", "kind", "level", "confidence", "text")
    ordered = clauses.groupBy("doc_id").agg(F.array_sort(F.collect_list(listed)).alias("clauses"))
    found = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("code", "status", "detail"))).alias("findings"), F.bool_or(F.col("status") == "error").alias("_failed"))
    j = models.select("doc_id", "doc_type", "paragraphs")
    for side in (missing, ordered, found):
        j = j.join(side.hint("merge"), "doc_id", "left")
    status = F.when(F.col("_failed").isNull(), "not_run").when(F.col("_failed"), "failed").otherwise("checked")
    return j.select("doc_id", "doc_type", status.alias("status"), "paragraphs", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), "clauses", "findings")


def error_ledger(results: DataFrame, group: str, error: str) -> DataFrame:
    """Rows per group, status and error class (null where all went well), with the group's number of failures."""
    counted = results.withColumn("status", F.when(F.col(error).isNull(), "OK").otherwise("FAILED")).groupBy(group, "status", error).agg(F.count("*").alias("n"))
    return counted.withColumn("failures", F.sum(F.when(F.col("status") == "FAILED", F.col("n")).otherwise(0)).over(Window.partitionBy(group)))


def edit_summary(edits: DataFrame, doc: str, note: str, idx: str) -> DataFrame:
    """Distinct notes of a document in first-seen order."""
    first = edits.groupBy(doc, note).agg(F.min(idx).alias("_i"))
    return first.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", note))), lambda x: x[note]), ";").alias("notes"))


def perturb(p: DataFrame, share: int, seed: int, change: Column, keys: list[str]) -> DataFrame:
    """p with text changed in one row of `share`, drawn by a hash of the keys, so the same rows at any partitioning and in
    other engines (see `damage` for the operations of papers)."""
    return p.withColumn("text", F.when(hit("perturb", seed, share, *keys), change).otherwise(F.col("text")))
