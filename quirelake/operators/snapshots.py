"""Two states of the same rows: differences, order, multisets, manifests, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators.scratch import cut


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, kind (unchanged, changed, removed, created), before and after of every key on either side."""
    a = before.select(*keys, F.col(value).alias("before"), F.lit(1).alias("_a"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(1).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "created").when(F.col("_b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed")
    return a.join(b.hint("merge"), keys, "full_outer").withColumn("kind", kind).drop("_a", "_b")


def snapshot_kinds(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and kind only: values are compared by hash, so texts are not shuffled."""
    hashed = lambda df: df.select(*keys, F.when(F.col(value).isNotNull(), F.sha2(F.col(value).cast("string").cast("binary"), 256)).alias("_v"))
    return snapshot_diff(hashed(before), hashed(after), keys, "_v").select(*keys, "kind")


def multiset_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one side that the other lacks, with how often: n_missing (only in a) and n_added (only in b).

    Rows are counted by a hash of their values; values travel once per distinct row, with the partial sums.
    """
    key = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    signed = a.select(*columns, F.lit(1).alias("n")).union(b.select(*columns, F.lit(-1).alias("n"))).withColumn("_k", key)
    both = signed.groupBy("_k").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in columns]).where("n <> 0")
    return both.select(*columns, F.greatest("n", F.lit(0)).alias("n_missing"), F.greatest(-F.col("n"), F.lit(0)).alias("n_added"))


def order_broken(before: DataFrame, after: DataFrame, doc: str, key: str, pos: str) -> DataFrame:
    """Survivors that stand before their predecessor afterwards."""
    both = before.select(doc, key, F.col(pos).alias("p")).join(after.select(doc, key, F.col(pos).alias("q")).hint("merge"), [doc, key])
    return both.withColumn("_last", F.lag("q").over(Window.partitionBy(doc).orderBy("p"))).where("q < _last").select(doc, key)


def manifest_verify(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """path and finding (missing, extra, changed) of a path, sha256 manifest."""
    d = snapshot_diff(manifest, actual, ["path"], "sha256").where("kind <> 'unchanged'")
    return d.select("path", F.when(F.col("kind") == "removed", "missing").when(F.col("kind") == "created", "extra").otherwise("changed").alias("finding"))


def file_manifest(files: DataFrame, path: Column, content: Column) -> DataFrame:
    return files.select(path.alias("path"), F.sha2(content, 256).alias("sha256"))


def output_collisions(plan: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """Case-folded outputs that several inputs map to, or that are inputs themselves (a table with `path`)."""
    made = plan.groupBy(F.lower("output").alias("output")).agg(F.count("*").alias("inputs"))
    if inputs is None:
        return made.where("inputs > 1")
    own = inputs.select(F.lower("path").alias("output"), F.lit(True).alias("is_input")).distinct()
    both = made.join(own.hint("merge"), "output", "left").withColumn("is_input", F.coalesce("is_input", F.lit(False)))
    return both.where("inputs > 1 or is_input")


def parity(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per field: cases on both sides, equal ones, and cases on one side only."""
    side = lambda df, mark: df.select(*keys, *[F.col(f).cast("string").alias(f"{mark}_{f}") for f in fields], F.lit(1).alias(f"_{mark}"))
    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    rows = both.select(paired.alias("paired"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")).alias("same")) for f in fields])).alias("x"))
    return rows.groupBy("x.field").agg(F.count_if("paired").alias("paired"), F.count_if(F.col("paired") & F.col("x.same")).alias("equal"), F.count_if(~F.col("paired")).alias("unpaired"))


def compare_runs(a: DataFrame, b: DataFrame, case: str, row: str, properties: list[str], blocked: str = "blocked", parts: int | None = None) -> DataFrame:
    """Differences of two runs over the same cases: case, row, kind, in_a, in_b.

    A case that only one run blocked gives one row (blocked); one that both blocked none. Of others, rows that only one
    side has (extra, missing) and each property that differs. parts: partitions of the joins (Spark's setting if None).
    """
    dealt = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    # both runs' flags in one pass; cases without a name are never the same case
    state = lambda df, mark: df.select(case, *[(F.col(blocked) if m == mark else F.lit(None).cast("boolean")).alias(f"_{m}") for m in "ab"], F.when(F.col(case).isNull(), mark).alias("_of"))
    cases = state(a, "a").union(state(b, "b")).groupBy(case, "_of").agg(*[F.coalesce(F.bool_or(m), F.lit(False)).alias(m) for m in ("_a", "_b")]).drop("_of")
    # written once for both readers, else a task would work out both runs, the flags and the joins together
    cases = cut(cases)
    none = F.lit(None).cast("string")
    one = cases.where("_a <> _b").select(case, F.lit(None).cast(dict(a.dtypes)[row]).alias(row), F.lit("blocked").alias("kind"), F.col("_a").cast("string").alias("in_a"), F.col("_b").cast("string").alias("in_b"))
    side = lambda df, mark: df.select(case, row, *[F.col(p).cast("string").alias(f"{mark}_{p}") for p in properties], F.lit(1).alias(f"_{mark}"))
    both = dealt(side(a, "a"), case, row).join(dealt(side(b, "b"), case, row).hint("merge"), [case, row], "full_outer")
    both = dealt(both, case).join(cases.where("not _a and not _b").select(case).hint("merge"), case)
    found = F.when(F.col("_a").isNull(), F.array(F.struct(F.lit("extra").alias("kind"), none.alias("x"), none.alias("y")))).when(F.col("_b").isNull(), F.array(F.struct(F.lit("missing").alias("kind"), none.alias("x"), none.alias("y")))).otherwise(
        F.filter(F.array(*[F.when(~F.col(f"a_{p}").eqNullSafe(F.col(f"b_{p}")), F.struct(F.lit(p).alias("kind"), F.col(f"a_{p}").alias("x"), F.col(f"b_{p}").alias("y"))) for p in properties]), lambda d: d.isNotNull())
    )
    rows = both.select(case, row, F.explode_outer(found).alias("d")).where("d is not null")
    return one.union(rows.select(case, row, "d.kind", F.col("d.x").alias("in_a"), F.col("d.y").alias("in_b")))


def structure_counts(rows: DataFrame, doc: str, html: Column, tags: list[str]) -> DataFrame:
    """Count of each opening tag in each document that has one."""
    counted = rows.select(doc, F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.regexp_count(html, F.lit(f"<{t}[ >]")).cast("long").alias("n")) for t in tags])).alias("x"))
    return counted.select(doc, "x.tag", "x.n").where("n > 0")


def structure_losses(before: DataFrame, after: DataFrame, doc: str) -> DataFrame:
    """Tags that became fewer."""
    b = after.select(doc, "tag", F.col("n").alias("now"))
    return before.join(b.hint("merge"), [doc, "tag"], "left").select(doc, "tag", (F.col("n") - F.coalesce("now", F.lit(0))).alias("lost")).where("lost > 0")
