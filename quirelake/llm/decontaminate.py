"""Benchmark decontamination by spaced-seed hashing. DataFrame expressions only.

Words are lower-cased runs of letters and digits. A mask picks some positions of a window and ignores the others; the
hash of the picked words is a seed, so a substituted word spoils only the seeds that pick it. Seeds of all documents
are joined with those of all benchmark items; a hit fixes the diagonal on which the item lies in the document. Around
each hit the item is laid over the text along that diagonal and the best stretch is taken, where an equal word counts
1 and a substituted one -`penalty`; a document is contaminated if some stretch reaches `least`, or the whole item if
it is shorter.

A verdict belongs to a text: copies of one text are one candidate, and equal items are one item. The benchmark's seeds
and the hits are broadcast only if their measured row counts allow it, else joined by sort-merge. Documents without hits
are read once and never shuffled in the broadcast case. What is laid beside an item is cut out of the text before it is
joined with anything, so no row but a document's own holds all its words.

The masks are such that every stretch which reaches `least` at `penalty` has a window that seeds (checked over all
patterns of substitutions by a test). Items shorter than a mask are hashed whole, against windows of their length.

Nulls and edge cases: null texts and items have no words and contaminate nothing; every row is judged by its own text,
so rows that repeat a doc_id or have none stay or go each on its own; items without an item_id are left out; an empty
benchmark flags nothing; equal best items resolve to the smallest item_id; columns named like the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import sized, written

#: Fixed masks: 1 picks a word, 0 ignores it. Both span 8 words and pick 5; found by enumeration.
MASKS = ("11110001", "11001101")
LEAST = 9
PENALTY = 2


def words_hashed(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at (position) and seed for each mask and position. df has the word hashes in _h."""
    span = len(MASKS[0])
    room = F.greatest(F.lit(0), F.size("_h") - (span - 1))

    def masked(number: int) -> Column:
        picked = [k for k, bit in enumerate(MASKS[number]) if bit == "1"]
        return F.transform(F.slice("_h", F.lit(1), room), lambda x, i: F.xxhash64(F.lit(number), *[F.get("_h", i + k) for k in picked]))

    df = df.select(*keys, room.alias("_room"), F.concat(*map(masked, range(len(MASKS)))).alias("_seeds"))
    # the outer form, as the plain one also filters on the array, which would compute it twice
    df = df.select(*keys, "_room", F.posexplode_outer("_seeds").alias("_i", "seed")).where("seed is not null")
    return df.select(*keys, F.pmod("_i", "_room").alias("at"), "seed")


def windows(df: DataFrame, keys: list[str], length: int) -> DataFrame:
    """keys, at and seed for each window of length words. df has the word hashes in _h."""
    room = F.greatest(F.lit(0), F.size("_h") - (length - 1))
    hashes = F.transform(F.slice("_h", F.lit(1), room), lambda x, i: F.xxhash64(*[F.get("_h", i + k) for k in range(length)]))
    return df.select(*keys, F.posexplode_outer(hashes).alias("at", "seed")).where("seed is not null")


def stretch(equal: Column, penalty: int) -> Column:
    """The best sum over consecutive elements, an equal word counting 1 and another -penalty."""
    start = F.struct(F.lit(0).alias("here"), F.lit(0).alias("best"))

    def step(a: Column, same: Column) -> Column:
        here = F.greatest(F.lit(0), a.here + F.when(same, 1).otherwise(-penalty))
        return F.struct(here.alias("here"), F.greatest(a.best, here).alias("best"))

    return F.aggregate(equal, start, step, lambda a: a.best)


#: Names a text: 128 bits of it.
KEY = ["__text_1", "__text_2"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({KEY[0]: F.xxhash64("text"), KEY[1]: F.xxhash64(F.lit(1), "text")})


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, penalty: int = PENALTY) -> DataFrame:
    """KEY, item_id, items and overlap of each text and item that overlap enough (a written table). Of equal items the
    smallest item_id stands for all; items: how many they are."""
    items = benchmark.where("item_id is not null").select("item_id", words_hashed(F.col("text")).alias("_h")).where(F.size("_h") > 0)
    items = written(items.groupBy("_h").agg(F.min("item_id").alias("item_id"), F.count("*").alias("items")).withColumns({"n": F.size("_h"), "row": F.monotonically_increasing_id()}))
    known = written(seeds(items, ["row", "n"]).withColumnRenamed("at", "item_at"))
    texts = keyed(docs.select("text")).select(*KEY, words_hashed(F.col("text")).alias("_h"))
    hits = seeds(texts, KEY).join(sized(known), "seed").select(*KEY, "row", "n", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    # at most as many lengths as a mask spans; one place of a whole item is enough
    for (length,) in items.select("n").distinct().where(F.col("n") < len(MASKS[0])).collect():
        short = written(windows(items.where(F.col("n") == length), ["row", "n"], length).drop("at"))
        places = windows(texts, KEY, length).join(sized(short), "seed").groupBy(*KEY, "row", "n").agg(F.min("at").alias("shift"))
        hits = hits.unionByName(places)
    hits = written(hits)
    # the hits of one text: an item lies on few diagonals, in degenerate texts on one for each word
    places = written(hits.groupBy(*KEY).agg(F.collect_list(F.struct("row", "n", "shift")).alias("_hits")))
    found = keyed(docs.select("text")).join(sized(places.select(*KEY), 100_000), KEY, "left_semi")
    one = written(found.groupBy(*KEY).agg(F.first("text").alias("text")))  # of copies one
    at, begin = lambda x: F.greatest(x.shift, F.lit(0)), lambda x: F.greatest(-x.shift, F.lit(0))
    cut = lambda x: F.struct(x.row.alias("row"), begin(x).alias("_from"), F.slice("_d", at(x) + 1, F.greatest(F.lit(0), F.least(F.size("_d") - at(x), x.n - begin(x)))).alias("_part"))
    laid = one.select(*KEY, words_hashed(F.col("text")).alias("_d")).join(places.hint("merge"), KEY)
    laid = laid.select(*KEY, F.explode_outer(F.transform("_hits", cut)).alias("_x")).where("_x is not null").select(*KEY, "_x.*")
    total = items.agg(F.sum("n")).first()[0] or 0  # item texts are broadcast only below 16 MB
    whole = F.broadcast(items) if total <= 2_000_000 else items.hint("merge")
    over = laid.join(whole.select("row", "item_id", "items", "n", F.col("_h").alias("_w")), "row")
    equal = F.zip_with("_part", F.slice("_w", F.col("_from") + 1, F.size("_part")), lambda x, y: x == y)
    scored = over.where(F.size("_part") > 0).select(*KEY, "row", "item_id", "items", "n", stretch(equal, penalty).alias("overlap"))
    return written(scored.where(F.col("overlap") >= F.least(F.lit(least), F.col("n"))).groupBy(*KEY, "row", "item_id", "items").agg(F.max("overlap").cast("long").alias("overlap")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, penalty: int = PENALTY) -> DataFrame:
    """docs with kept (false if contaminated), item_id and overlap of the best item, and n_items."""
    found = contaminated(docs, benchmark, least, penalty)
    best = F.max(F.struct("overlap", (-F.col("item_id")).alias("minus")))
    flagged = found.groupBy(*KEY).agg(best.alias("best"), F.sum("items").alias("n_items")).select(*KEY, (-F.col("best.minus")).alias("item_id"), F.col("best.overlap").alias("overlap"), "n_items")
    clean = keyed(docs.drop("item_id", "overlap", "n_items", "kept", *KEY))
    return clean.join(sized(written(flagged)), KEY, "left").drop(*KEY).withColumn("kept", F.col("n_items").isNull())
