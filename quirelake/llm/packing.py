"""Packing of tokenised documents into fixed-length sequences: shortest-pack-first over the length histogram.

1. Tokenise every document once; cut it into full pieces of `capacity` tokens and one rest (narrow, no shuffle).
2. Count rests by length: at most `capacity` numbers, whatever the corpus, so the histogram may go to the driver.
3. Place lengths, longest first, into the shortest open pack, the one with the most free room; a pack kind is a
   pattern of lengths with a count, so the plan's size depends on the capacity and not on the documents.
4. Rank the rests of each length and look the rank up in the plan. Ranks come from counts of hash buckets, so a
   length that a third of all documents share is still ranked by many tasks.

Nulls and edge cases: a null or empty text is the end token alone; a null doc_id stays null and packs as usual;
repeated rows are packed as often as they occur; other columns are ignored. The result of an empty table is empty.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import written

CAPACITY = 2048
END_ID = 1
#: Fixed value: the special token of the vocabulary, behind its ranks.
SPECIAL = "<|endoftext|>"

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


class Encoder:
    """Token ids of a text as little-endian uint32 bytes.

    path: a tokenizers JSON file, or the same vocabulary as a .tiktoken rank file: the same ids at several times the
    speed. As with the JSON file, the special token's own string in a text is that token.
    """

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
            self.ids_of = lambda text: encoding.encode(text, allowed_special={SPECIAL}) if SPECIAL in text else encoding.encode_ordinary(text)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.ids_of = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        return np.array(self.ids_of(text), "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens. tokenizer: path of the vocabulary on the workers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
        encoder = _encoders.setdefault(path, None) or Encoder(path)
        _encoders[path] = encoder
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns as (count, lengths), each with lengths that sum to the capacity at most.

    Lengths come longest first; each goes to the shortest packs, those with the most room. Where none holds it, a new
    pack is the shortest, so what is left of the length opens packs that take as many of it as fit. Packs of one
    pattern are handled as one number.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by free room
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = next((r for r in range(capacity - 1, length - 1, -1) if open_packs[r]), None)
            if room is None:
                # several of a length may share a new pack; the remainder comes back as a pack of fewer
                fit = min(capacity // length, left)
                count = left // fit
                open_packs[capacity - fit * length].append((count, (length,) * fit))
                left -= count * fit
                continue
            count, lengths = open_packs[room].pop()
            used = min(count, left)
            if count > used:
                open_packs[room].append((count - used, lengths))
            open_packs[room - length].append((used, (*lengths, length)))
            left -= used
    return [pack for room in sorted(open_packs) for pack in open_packs[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]], first_sequence: int) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset), ordered by length and first rank."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], first_sequence
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(df: DataFrame, key: str, order: list[str], rank: str) -> DataFrame:
    """df (a written table) with the row's rank among those with its key, from 0, in an order fixed by a hash of `order`.

    Counts by (key, hash bucket) give each bucket's first rank, so only rows of one bucket are sorted together. There
    are about as many buckets as rows in one.
    """
    buckets = max(1, int(df.count() ** 0.5))
    mixed = F.xxhash64(*order)
    df = df.withColumn("_bucket", F.pmod(mixed, F.lit(buckets)).cast("int"))
    counts = written(df.groupBy(key, "_bucket").agg(F.count("*").alias("_n")))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = written(counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    within = Window.partitionBy(key, "_bucket").orderBy(*order)
    numbered = df.withColumn("_in", F.row_number().over(within) - 1)
    return numbered.join(first.hint("merge"), [key, "_bucket"]).withColumn(rank, F.col("_first") + F.col("_in")).drop("_bucket", "_first", "_in")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    cut = written(pieces(docs, tokenizer, capacity))
    # bounded by the capacity: one number per length
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    table = slots(plan(histogram, capacity), 0)
    starts = table[:, 0] * 2**44 + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.schema.names.index("rank")).to_numpy(zero_copy_only=False)
            length = batch.column(batch.schema.names.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            slot = table[np.searchsorted(starts, length * 2**44 + rank, "right") - 1]
            columns = [batch.column(batch.schema.names.index(c)) for c in ("doc_id", "start")]
            columns += [pa.array(length), batch.column(batch.schema.names.index("ids_crc32")), batch.column(batch.schema.names.index("doc_tokens"))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked(cut, "length", ["doc_id", "start", "ids_crc32"], "rank").mapInArrow(place, schema)
