"""Substring deduplication by sliding sentence spans.

A text is cut into sentences at closing marks followed by a blank and at line ends; a sentence of more than `unit`
words is also cut after every word whose hash is 0 modulo CUT, so that long unpunctuated passages have several and
the cuts do not depend on what stands before. A span starts at every sentence
and runs over at least `run` consecutive sentences and at least `words` words. Spans are hashed and joined over all
documents; the first occurrence of a repeated span (smallest doc_id, then position) stays, and sentences that any
other occurrence covers are removed.

A hash that many documents share is counted with partial sums, and its occurrences meet the one row of the repeated
span in a sort-merge join of written tables, which AQE splits where it is skewed. No pairs are made.

Nulls and edge cases: a null or empty text stays as it is; texts with fewer sentences than a span are never changed; a
row with a null doc_id takes no part and stays as it is; rows that repeat doc_id and text count as one document and are
shortened alike; rows that repeat a doc_id with other texts are documents of their own, in the order of a hash of the
text; other columns pass through, but for `n_sentences`, `n_removed` and `kept`, which the result defines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import written

RUN = 3
WORDS = 20
UNIT = 16
CUT = 6

SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+(?![\s.!?]|$)[^\n.!?]*)*(?:[.!?]+(?=\s|$))?[^\S\n]*\n?\s*")
WORD = re.compile(r"\S+\s*")


def sentences(text: str, unit: int = UNIT) -> list[tuple[int, int, str, int]]:
    """(start, end, words joined by one blank, number of words) of each sentence; the ranges cover the whole text."""
    found = []
    for m in SENTENCE.finditer(text):
        if m.end() == m.start():
            continue
        words = m[0].split()
        if len(words) <= unit:
            found.append((m.start(), m.end(), " ".join(words), len(words)))
            continue
        begin, held = m.start(), []
        for part in WORD.finditer(text, m.start(), m.end()):
            word = part[0].rstrip()
            held.append(word)
            if crc32(word.encode("utf-8", "surrogatepass")) % CUT == 0 or part.end() == m.end():
                found.append((begin, part.end(), " ".join(held), len(held)))
                begin, held = part.end(), []
    return found


def spans(text: str, run: int, words: int, unit: int) -> tuple[list[int], list[int], list[int]]:
    """Hash, first sentence and number of sentences of each span."""
    units = sentences(text, unit)
    hashes, starts, lengths = [], [], []
    end = total = 0
    for i in range(len(units)):
        while end < len(units) and (end - i < run or total < words):
            total += units[end][3]
            end += 1
        if end - i < run or total < words:
            break
        hashes.append(xxhash.xxh64_intdigest("\n".join(u[2] for u in units[i:end])) - 2**63)
        starts.append(i)
        lengths.append(end - i)
        total -= units[i][3]
    return hashes, starts, lengths


def deduplicate(docs: DataFrame, run: int = RUN, words: int = WORDS, unit: int = UNIT) -> DataFrame:
    """docs with text shortened, and n_sentences and n_removed; kept is false where a text lost all its words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hashes, starts, lengths = [], [], [], [], []
            for doc_id, cell, text_hash in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                h, s, n = spans(cell.as_py() or "", run, words, unit)
                ids += [doc_id] * len(h)
                texts += [text_hash] * len(h)
                hashes += h
                starts += s
                lengths += n
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], ["h", "doc_id", "t", "at", "n"])

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for cell, gone in zip(batch.column(batch.schema.names.index("text")), batch.column(batch.schema.names.index("_gone")), strict=True):
                text, drop = cell.as_py(), set()
                units = sentences(text or "", unit)
                for x in gone.as_py() or ():
                    drop.update(range(x["at"], x["at"] + x["n"]))
                texts.append("".join(text[a:b] for i, (a, b, _, _) in enumerate(units) if i not in drop) if drop else text)
                counts.append(len(units))
                removed.append(len(drop))
            columns = [pa.array(texts, pa.string()) if name == "text" else batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_gone"]
            names = [x for x in batch.schema.names if x != "_gone"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_sentences", "n_removed"])

    docs = docs.drop("_gone", "_t", "n_sentences", "n_removed", "kept")
    texts = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("t"))
    found = written(texts.mapInArrow(hashed, "h long, doc_id long, t long, at int, n int"))
    first = F.min(F.struct("doc_id", "t", "at"))
    repeated = found.groupBy("h").agg(first.alias("first"), F.count("*").alias("k")).where("k > 1")
    repeated = written(repeated.select("h", F.col("first.doc_id").alias("d"), F.col("first.t").alias("u"), F.col("first.at").alias("p")))
    later = found.join(repeated.hint("merge"), "h").where("doc_id <> d or t <> u or at <> p").select("doc_id", "t", "at", "n")
    gone = written(later.distinct().groupBy("doc_id", F.col("t").alias("_t")).agg(F.collect_list(F.struct("at", "n")).alias("_gone")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    cut = docs.withColumn("_t", F.xxhash64("text")).join(gone.hint("merge"), ["doc_id", "_t"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_gone")
    out = cut.mapInArrow(shorten, f"{fields}, n_sentences long, n_removed long")
    return out.withColumn("kept", (F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
