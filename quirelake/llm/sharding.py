"""Sharding by proportional stratified interleaving.

Rows of each source get a seeded random order; the row of rank r of n gets the fraction (r + 1/2) / n; rows sorted by
fraction mix all sources in proportion everywhere, so equal cuts of that order give shards that match the mixture.
The law is `rows`: shard sizes differ by one row at most. Both sorts use counts of hash or range buckets (about as
many buckets as rows in one), so neither a hot source nor the global order ever meets in one task, and only ids and
sizes are shuffled, never texts.

Nulls and edge cases: a null text has no bytes (size 16, crc 0); a null source is a source of its own; a null doc_id
is a row like any other; repeated rows each get a slot; other columns are ignored; an empty table has no shards.
Which of several equal rows gets which slot is left open, as they cannot be told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import written

SHARDS = 40
ROW_BYTES = 16
SEED = 17


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = written(docs.select("doc_id", "source", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    total = rows.count()
    buckets = max(1, int(total**0.5))
    mixed = F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32")
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = rows.withColumns({"_source": source, "_mixed": mixed}).withColumn("_bucket", F.pmod(F.col("_mixed"), F.lit(buckets)).cast("int"))
    counts = written(rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n")))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.join(counts.groupBy("_source").agg(F.sum("_n").alias("_all")).hint("merge"), "_source")
    first = written(counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_mixed", "doc_id")
    ranked = rows.withColumn("_in", F.row_number().over(within) - 1).join(first.hint("merge"), ["_source", "_bucket"])
    fraction = (F.col("_first") + F.col("_in") + 0.5) / F.col("_all")
    spread = ranked.select("doc_id", "source", "size", "text_crc32", "_source", "_mixed", fraction.alias("_at"))
    spread = written(spread.withColumn("_cut", F.least(F.floor(F.col("_at") * buckets), F.lit(buckets - 1)).cast("int")))
    # one number per cut, and about the square root of the rows as cuts
    cuts = spread.groupBy("_cut").agg(F.count("*").alias("_n"))
    cuts = written(cuts.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n"))
    inside = Window.partitionBy("_cut").orderBy("_at", "_source", "_mixed", "doc_id")
    placed = spread.withColumn("_in", F.row_number().over(inside) - 1).join(cuts.hint("merge"), "_cut")
    at = F.col("_first") + F.col("_in")
    # row p goes to shard floor(p * shards / total); the shard's first row is the ceiling of shard * total / shards
    number = F.floor(at * shards / F.lit(max(1, total))) if total * shards < 2**52 else F.expr(f"({shards} * (_first + _in)) div {total}")
    placed = placed.withColumn("shard", number.cast("int")).withColumn("_p", at)
    begin = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_p") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
