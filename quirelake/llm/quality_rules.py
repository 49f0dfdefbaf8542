"""Quality rules: exact counts per text, and the length-normalised log-likelihood ratio of hashed n-grams between a
trusted target and the raw corpus. DataFrame expressions only.

Tokens of the ratio are runs of letters and digits or runs of other visible characters; their 1- and 2-grams are hashed
into a fixed number of buckets. The raw multinomial counts every document; the target counts a bounded sample of
documents labelled good (`trusted` at most, the smallest by a hash of doc_id). A document's score is the mean over its
n-grams of log target - log raw, and it is kept if that reaches a fixed threshold, so every document's verdict depends
on the corpus counts and its own text only. Scoring is row by row: no text is shuffled, repeated rows stay.

Nulls and edge cases: a null text has no words; without n-grams the score is null and the base rule (fewer than ten
words) rejects; without any trusted document all scores are 0 and only base rules decide; labels may hold nulls,
repeated ids and ids that no document has; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import word_array, written

WINDOW = 5
BUCKETS = 2**16
TRUSTED = 20_000
THRESHOLD = -0.45
SYMBOLS = "#*$%&|<>"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({
        "_h": F.transform(word_array("text"), lambda w: F.xxhash64(w)),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_lines": lines,
    })
    at = lambda i: [F.get("_h", i + k) for k in range(1, WINDOW)]
    df = df.withColumns({
        "n_words": F.size("_h").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_w": F.transform(F.slice("_h", F.lit(1), F.greatest(F.lit(0), F.size("_h") - (WINDOW - 1))), lambda x, i: F.xxhash64(x, *at(i))),
    })
    # most texts repeat no window; only the others are sorted
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    flagged = F.transform("_s", lambda x, j: F.when(F.coalesce(x.h == F.get("_s", j - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("_s", j + 1).h, F.lit(False)), x.i))
    df = df.withColumn("_p", F.sort_array(F.filter(flagged, lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_lines", "_w", "_s", "_p")


def grams(text: Column) -> tuple[Column, Column]:
    """Token hashes of a text, and (given them as column _t) the buckets of its 1- and 2-grams."""
    hashed = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))
    single = F.transform("_t", lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    double = F.transform(F.slice("_t", F.lit(1), F.greatest(F.lit(0), F.size("_t") - 1)), lambda x, i: F.pmod(F.xxhash64(x, F.get("_t", i + 1)), F.lit(BUCKETS)).cast("int"))
    return hashed, F.concat(single, double)


def ratio_model(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> DataFrame:
    """One row: the array of log target - log raw by bucket."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = written(good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted).withColumn("_good", F.lit(1)))
    hashed, buckets = grams(F.col("text"))
    # at most `trusted` ids are broadcast
    marked = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select(hashed.alias("_t"), F.coalesce("_good", F.lit(0)).alias("_good"))
    # the outer form, as the plain one also filters on the array, which would compute it twice
    counts = marked.select(F.explode_outer(buckets).alias("b"), "_good").where("b is not null").groupBy("b").agg(F.count("*").alias("raw"), F.sum("_good").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    full = every.join(written(counts).hint("merge"), "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    # one row per bucket, a fixed number: one array
    row = full.groupBy().agg(F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("x"), F.sum("raw").alias("R"), F.sum("target").alias("T"))
    llr = F.when(F.col("T") > 0, F.transform("x", lambda x: F.log((x.target + 1) / (F.col("T") + BUCKETS)) - F.log((x.raw + 1) / (F.col("R") + BUCKETS)))).otherwise(F.transform("x", lambda x: F.lit(0.0)))
    return written(row.select(llr.alias("llr")))


def rate(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept for every row."""
    model = ratio_model(docs, labels, trusted)
    hashed, buckets = grams(F.col("text"))
    df = base_counts(docs.select("doc_id", "text")).withColumn("_t", hashed).withColumn("_b", buckets)
    # the model is one row of a fixed number of buckets: a scalar subquery, evaluated once
    df = df.withColumn("_llr", model.select("llr").scalar())
    score = F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get("_llr", b)) / F.when(F.size("_b") > 0, F.size("_b"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), score.alias("score"))
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))
