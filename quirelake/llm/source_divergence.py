"""Source divergence audit: how far apart the term distributions of the sources of a language are, by count-level bitmaps.

1. Words are counted where they stand (bounded dictionaries in each task), then summed by (lang, source, term).
2. A language keeps the terms that enough of its documents hold. Its kept terms are dealt into chunks of a few hundred
   terms of about the same frequency, so that a chunk has few different counts.
3. In a chunk every group has a bitset of terms for each count. AND and popcount of two bitsets give the number of terms
   with that pair of counts (a cell of the pair's joint table); cells with a count of zero on one side are complements.
   Cells times abs(p - q) sum up to the pair's distance over the chunk; chunks are summed.

Probabilities are p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)) in whole numbers (decimals of 38 digits), N the
group's occurrences of kept terms, V the language's kept terms.

All pairs of sources of a language are the result asked for; they are made chunk by chunk inside tasks that hold one
chunk of terms and two blocks of at most about BLOCK sources, whatever the number of documents, terms or sources.

Nulls and edge cases: null text, lang and source are ''; groups without terms count (N = 0) and pair with the others at
distance; where a language keeps no term (V = 0) p and q are not needed and every distance is 0; a language with one
source has no pairs; doc_id may be null or repeated (each row is a document); other columns are ignored, whatever their
names; texts are counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import LOWER, UPPER, sized, written

#: What a term is, documents that make a term kept, scale and prior of the probabilities.
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
AT_LEAST, SCALE, PRIOR = 30, 1_000_000_000, 5
TOP = 50

#: Terms of a chunk and sources of a block, about; words that a task counts before it hands them on.
CHUNK, BLOCK, COUNTED = 384, 128, 400_000

LOWERED = str.maketrans(UPPER, LOWER)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs (documents with it); a row without a term for every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], dict[str, list[int]]] = {}
        held = 0

        def flushed() -> pa.RecordBatch:
            rows = [(lang, source, term, n, n_docs) for (lang, source), terms in counts.items() for term, (n, n_docs) in terms.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "term", "n", "n_docs"])

        for batch in batches:
            for lang, source, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = counts.setdefault((lang, source), {None: [0, 0]})
                before = len(terms)
                for term, n in Counter(TERM.findall(cell.as_py().translate(LOWERED))).items():
                    if found := terms.get(term):
                        found[0] += n
                        found[1] += 1
                    else:
                        terms[term] = [n, 1]
                held += len(terms) - before
                if held >= COUNTED:
                    yield flushed()
                    held = 0
        yield flushed()

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = named.mapInArrow(run, "lang string, source string, term string, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """Exact whole-number probability; null where there are no terms to share it."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(PRIOR)).cast("decimal(20,0)")
    return F.when(terms > 0, F.lit(1) + F.call_function("div", scaled, (total + F.lit(PRIOR) * terms).cast("decimal(20,0)")).cast("long"))


def chunked(kept: DataFrame) -> DataFrame:
    """kept terms (lang, term, total) with their chunk's number in the language: terms of about one frequency, dealt by
    hash over as many chunks as the frequency class needs."""
    classed = kept.withColumn("_class", F.floor(F.log2("total") * 2).cast("int"))
    needs = classed.groupBy("lang", "_class").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("_chunks"))
    # a language has at most about a hundred classes, but the number of languages is the data's
    spread = classed.join(needs.hint("merge"), ["lang", "_class"])
    return spread.select("lang", "term", "total", (F.col("_class").cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("term"), F.col("_chunks"))).alias("chunk"))


def distances(chunk: pd.DataFrame) -> pd.DataFrame:
    """Pairs of sources of one chunk and one pair of blocks with their summed distance over the chunk's terms.

    chunk: a row for each (source, term) that occurs (term, n, p) and one for each source of the two blocks (term null, n
    the number of terms in the chunk, which may also be those of other blocks, p that of a term that doesn't occur).
    """
    first, second = int(chunk["block_a"].iloc[0]), int(chunk["block_b"].iloc[0])
    lang, none = chunk["lang"].iloc[0], chunk["term"].isna()
    groups = chunk[none].drop_duplicates("source").sort_values("source")
    names, zero, block = groups["source"].to_list(), groups["p"].to_numpy(np.int64), groups["block"].to_numpy()
    there = chunk[~none]
    slot, terms = pd.factorize(there["term"])
    size, words = int(groups["n"].iloc[0]), (len(terms) + 63) // 64
    # one level for each (source, count): its bitset of terms, its number of terms and its p
    source = pd.Index(names).get_indexer(there["source"])
    levels, level = np.unique(np.stack([source, there["n"].to_numpy(np.int64)]), axis=1, return_inverse=True)
    level = level.reshape(-1)
    bits = np.zeros((levels.shape[1], words), np.uint64)
    np.bitwise_or.at(bits, (level, slot // 64), np.left_shift(np.uint64(1), (slot % 64).astype(np.uint64)))
    p = np.zeros(levels.shape[1], np.int64)
    p[level] = there["p"].to_numpy(np.int64)
    cardinal = np.bitwise_count(bits).sum(1, dtype=np.int64)
    begin = np.searchsorted(levels[0], np.arange(len(names) + 1))

    rows = []
    for a, one in enumerate(names):
        if block[a] != first and block[a] != second:
            continue
        mine = slice(begin[a], begin[a + 1])
        others = [b for b in range(a + 1, len(names)) if {block[a], block[b]} == {first, second}]
        if not others:
            continue
        low = begin[a + 1]
        joint = np.zeros((begin[a + 1] - begin[a], levels.shape[1] - low), np.int64)
        for word in range(words):
            joint += np.bitwise_count(bits[mine, word][:, None] & bits[low:, word][None, :])
        both = (joint * np.abs(p[mine][:, None] - p[low:][None, :])).sum(0)
        met_by_a = joint.sum(0)
        for b in others:
            theirs, at = slice(begin[b], begin[b + 1]), slice(begin[b] - low, begin[b + 1] - low)
            value = int(both[at].sum())
            value += int(((cardinal[mine] - joint[:, at].sum(1)) * np.abs(p[mine] - zero[b])).sum())  # only a has the term
            value += int(((cardinal[theirs] - met_by_a[at]) * np.abs(p[theirs] - zero[a])).sum())  # only b has it
            neither = size - int(cardinal[mine].sum()) - int(cardinal[theirs].sum()) + int(met_by_a[at].sum())
            rows.append((lang, one, names[b], value + neither * abs(int(zero[a]) - int(zero[b]))))
    return pd.DataFrame(rows, columns=["lang", "a", "b", "value"]).astype({"value": "int64"})


def audit(docs: DataFrame) -> DataFrame:
    """Parts `pair` (other sources of the language by distance) and `term` (the terms that a source has more of than its
    language, at most TOP): lang, source, part, item, value, rank."""
    counts = written(term_counts(docs))
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= AT_LEAST)
    kept = written(chunked(written(terms.select("lang", "term", "total"))))
    length = kept.agg(F.sum(F.octet_length("term"))).first()[0] or 0  # terms may be long, so their bytes are counted, too
    known = sized(kept) if length <= 16 * 2**20 else kept.hint("merge")
    rows = written(counts.where("term is not null").select("lang", "source", "term", "n").join(known, ["lang", "term"]))

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.where("term is null").select("lang", "source").join(own.hint("merge"), ["lang", "source"], "left").join(langs.hint("merge"), ["lang"], "left")
    groups = groups.select("lang", "source", F.coalesce("group_n", F.lit(0)).alias("group_n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    groups = groups.join(sizes.hint("merge"), ["lang"]).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    groups = written(groups.withColumn("zero", F.coalesce(probability(F.lit(0), F.col("group_n"), F.col("v")), F.lit(0))))

    scored = rows.join(sized(groups), ["lang", "source"])
    scored = scored.withColumn("p", probability(F.col("n"), F.col("group_n"), F.col("v"))).withColumn("q", probability(F.col("total"), F.col("lang_n"), F.col("v")))
    scored = written(scored.select("lang", "source", "term", "chunk", "n", "p", "q", "block", "blocks"))

    return pairs(scored, groups, kept).unionByName(top_terms(scored))


def pairs(scored: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    # every chunk gets the sources of its language, and so does one without terms: there a language that keeps none has its pairs
    chunks = kept.groupBy("lang", "chunk").agg(F.count("*").alias("n"))
    chunks = written(chunks.unionByName(groups.select("lang", F.lit(-(1 << 62)).cast("long").alias("chunk"), F.lit(0).cast("long").alias("n")).distinct()))
    sources = groups.select("lang", "source", "block", "blocks", F.col("zero").alias("p"), F.lit(None).cast("string").alias("term"))
    present = chunks.join(sized(sources), ["lang"]).unionByName(scored.drop("q"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    blocked = present.withColumn("other", other).withColumn("block_a", F.least("block", "other")).withColumn("block_b", F.greatest("block", "other"))
    found = blocked.groupBy("lang", "chunk", "block_a", "block_b").applyInPandas(distances, "lang string, a string, b string, value long")
    summed = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = summed.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_s"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sides.select("lang", "_s.*", "value").select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(first).alias("rank"))


def top_terms(scored: DataFrame) -> DataFrame:
    more = scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return more.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= TOP)


#: The same rows in DuckDB's SQL.
SQL = r"""
with docs as (
  select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as found
  from documents
), words as (select row_id, lang, source, unnest(found) as term from docs
), kept as (select lang, term from words group by lang, term having count(distinct row_id) >= 30
), counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by lang, source, term
), grp as (
  select g.lang, g.source, coalesce((select sum(n) from counts c where c.lang = g.lang and c.source = g.source), 0)::hugeint as total, (select count(*) from kept k where k.lang = g.lang)::hugeint as v
  from (select distinct lang, source from docs) g
), cell as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) as p
  from grp g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), lang_n as (select lang, sum(n)::hugeint as total, (select count(*) from kept k where k.lang = counts.lang)::hugeint as v from counts group by lang
), whole as (
  select t.lang, t.term, 1 + (1000000000::hugeint * (t.n + 5)) // (l.total + 5 * l.v) as q
  from (select lang, term, sum(n) as n from counts group by lang, term) t join lang_n l on l.lang = t.lang
), pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce((select sum(abs(x.p - y.p)) from cell x join cell y on y.lang = x.lang and y.term = x.term where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
), term as (select c.lang, c.source, 'term' as part, c.term as item, c.p - w.q as value from cell c join whole w on w.lang = c.lang and w.term = c.term where c.n > 0 and c.p > w.q
), ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""
