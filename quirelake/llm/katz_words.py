"""Scoring by a Katz back-off trigram model over words, trained on the corpus itself.

Words (lower-cased A-Z) are told apart by their 64-bit hashes; the end of a text is a word of its own and its beginning
a context of its own. Orders are evaluated recursively, trigram -> bigram -> unigram:
* p1(w) = (c + 1) / (n + v + 1) for n training tokens and v training words, all unknown words being one;
* p(w | context) is the Good-Turing discounted c(context w) / c(context) where the n-gram was seen (counts up to K are
  discounted), else alpha(context) * p(w | shorter context), with the exactly normalised weight
  alpha(context) = (1 - sum of discounted seen) / (1 - sum of their lower-order probabilities).

Texts are cut into chunks, written once with an identity of their own. For each order a chunk sends its distinct n-grams
and their training counts to buckets dealt by context; the buckets add up and send back the count of each n-gram and the
sums of each context. Contexts with more tokens than a quarter of a bucket are dealt by the whole n-gram, and their sums
are put together (at most four contexts a bucket). Trained words and n-grams get running numbers, so that the context of
the next order is one number and keys are exact. No occurrences travel: a key reaches a bucket once per chunk however
frequent it is, and sums over documents are made where the text is.

Nulls and edge cases: a null or blank text is the end alone; a null doc_id is trained on like the others; rows that
repeat doc_id and text are counted as often as they occur and each is returned; without training tokens every word is
unknown. Texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quirelake.llm.common import discard, written
from quirelake.llm.katz_lm import K, chunks, discounts, held_out, packed, unpacked

#: Word numbers of the beginning of a text and of all unknown words; others follow.
START, UNKNOWN = 0, 1
#: Ranks inside a bucket are below 2^RANK_BITS.
RANK_BITS = 40
#: Tokens of a chunk, about; documents of a bucket, about.
CHUNK_TOKENS = 1_000_000
BUCKET_DOCS = 4_000

CHUNK = "chunk long, doc_ids binary, nulls binary, held binary, lengths binary, words binary, counts binary, tokens binary"
REQUEST = "bucket int, chunk long, keys binary, counts binary, low binary"
#: context: tokens of each context and which low counts its successors have. open: what back-off needs, for contexts with
#: an n-gram that training has not seen: numbers of successors by count, and sums of weights.
REPLY = "chunk long, level int, bucket int, counts binary, ids binary, context binary, open binary, r array<long>, top long"
TOKENS = "chunk long, doc_ids binary, nulls binary, held binary, lengths binary, tokens binary"


_squeeze, _expand = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


def narrow(a: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes, as many as the largest needs."""
    a = np.ascontiguousarray(a).astype(np.uint64)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if a.size else 1
    return bytes([width]) + _squeeze.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def wide(b: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view(np.uint64).ravel()


def ascending(keys: np.ndarray) -> bytes:
    return narrow(np.diff(keys, prepend=np.uint64(0)))


def from_ascending(b: bytes) -> np.ndarray:
    return np.cumsum(wide(b), dtype=np.uint64)


def record(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks of documents: distinct word hashes, their training counts, and the tokens as numbers of these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (ids, _, words, doc) in enumerate(chunks(batches, CHUNK_TOKENS)):
            held = np.array([held_out(x) for x in ids])
            distinct, code = np.unique(words, return_inverse=True)
            counts = np.bincount(code[~held[doc]], minlength=len(distinct))
            who = packed(np.array([x or 0 for x in ids], np.int64)), packed(np.array([x is None for x in ids])), packed(held)
            row = (part * 2**32 + number, *who, narrow(np.bincount(doc, minlength=len(ids))), ascending(distinct), narrow(counts), narrow(code))
            yield from record([row], CHUNK).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, CHUNK)


def spread(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def requests(chunk: int, to: np.ndarray, keys: np.ndarray, counts: np.ndarray, low: np.ndarray | None) -> list[tuple]:
    """Rows of REQUEST. keys are distinct and ascending; low: lower-order counts where the buckets do not know them."""
    rows = []
    for b in np.unique(to):
        mine = to == b
        rows.append((int(b), chunk, ascending(keys[mine]), narrow(counts[mine]), narrow(np.zeros(0) if low is None else low[mine])))
    return rows


def merged(keys: list[np.ndarray], counts: list[np.ndarray], low: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trained keys, their counts and their lower-order counts."""
    k, c, x = (np.concatenate([np.empty(0, np.uint64), *a]) for a in (keys, counts, low))
    seen = c > 0
    distinct, first, inverse = np.unique(k[seen], return_index=True, return_inverse=True)
    return distinct, np.bincount(inverse, c[seen].astype(float), len(distinct)).astype(np.int64), x[seen][first].astype(np.int64)


def numbered(counts: np.ndarray, buckets: int, bucket: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Running numbers, unlike those of other buckets and smaller for larger counts, and the keys in that order."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return first + rank * buckets + bucket, order


def found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked key among the keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def context_sums(keys: np.ndarray, counts: np.ndarray, weights: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, for each its tokens and numbers of successors with count 1 to K (rows), and its sum of weights."""
    context, inverse = np.unique(keys >> np.uint64(bits), return_inverse=True)
    stats = [np.bincount(inverse, counts, len(context)), *(np.bincount(inverse[counts == r], minlength=len(context)) for r in range(1, K + 1))]
    return context, np.array(stats, np.int64).reshape(K + 1, -1), np.bincount(inverse, weights, len(context))


def low_counts(stats: np.ndarray) -> np.ndarray:
    """Which of the counts 1 to K the successors of each context have, as bits."""
    return sum((stats[r] > 0).astype(np.int64) << (r - 1) for r in range(1, K + 1))


class Level:
    """What every task of one order knows: key layout, hot contexts with their sums, discounts, lower-order weight."""

    def __init__(self, order: int, bits: int, buckets: int, hot: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        """weight: numbers in proportion to lower-order probabilities, of keys with their lower-order counts."""
        self.order, self.bits, self.buckets, self.hot, self.weight = order, bits, buckets, hot, weight
        self.hot_stats, self.hot_weight, self.factor = np.zeros((K + 1, len(hot)), np.int64), np.zeros(len(hot)), np.ones(K + 1)

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        context = keys >> np.uint64(self.bits)
        return spread(np.where(np.isin(context, self.hot), keys, context), self.buckets)

    def replied(self, limit: int) -> Callable[[pa.Table], pa.Table]:
        """The function of one bucket. limit: n-grams with more tokens are hot contexts of the next order."""

        def run(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            parts = [(table.column("chunk")[i].as_py(), from_ascending(table.column("keys")[i].as_py()), wide(table.column("counts")[i].as_py()), wide(table.column("low")[i].as_py())) for i in range(table.num_rows)]
            keys, counts, low = merged([p[1] for p in parts], [p[2] for p in parts], [p[3] if len(p[3]) else np.zeros(len(p[1]), np.uint64) for p in parts])
            ids, _ = numbered(counts, self.buckets, bucket, 1)
            context, stats, weights = context_sums(keys, counts, self.weight(keys, low), self.bits)
            of_hot = np.isin(context, self.hot)
            r = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2]
            partial = ascending(context[of_hot]), narrow(stats[:, of_hot].ravel()), packed(weights[of_hot])
            rows = [(-1, self.order, bucket, partial[0], narrow(ids[counts > limit]), partial[1], partial[2], r.tolist(), int(ids.max(initial=0)))]
            for chunk, k, _, _ in parts:
                at, hit = found(keys, k)
                c = np.where(hit, counts[at], 0) if len(keys) else np.zeros(len(k), np.int64)
                number = np.zeros(0, np.int64) if self.order == 3 else np.where(hit, ids[at], 0) if len(keys) else np.zeros(len(k), np.int64)
                mine, of = np.unique(k >> np.uint64(self.bits), return_inverse=True)
                place, there = found(context, mine)
                there &= ~np.isin(mine, self.hot)
                sums = np.where(there, stats[:, place], 0) if len(context) else np.zeros((K + 1, len(mine)), np.int64)
                unseen = there & (np.bincount(of[c == 0], minlength=len(mine)) > 0)
                open_ = narrow(sums[1:, unseen].ravel()), packed(weights[place[unseen]] if len(context) else np.zeros(0))
                rows.append((chunk, self.order, bucket, narrow(c), narrow(number), narrow(np.concatenate((sums[0], low_counts(sums)))), len(open_[0]).to_bytes(8, "little") + b"".join(open_), None, 0))
            return record(rows, REPLY)

        return run

    def fit(self, replies: DataFrame) -> tuple[np.ndarray, int]:
        """Take discounts and hot sums from the buckets' own rows; the next order's hot contexts and the largest number."""
        seen, top, following = np.zeros(K + 1, np.int64), 0, [np.empty(0, np.uint64)]
        for row in replies.where("chunk = -1").toLocalIterator():
            seen += np.array(row.r, np.int64)
            top = max(top, row.top)
            following.append(wide(row.ids))
            at = np.searchsorted(self.hot, from_ascending(row.counts))
            self.hot_stats[:, at] += wide(row.context).astype(np.int64).reshape(K + 1, -1)
            self.hot_weight[at] += unpacked(row.open, np.float64)
        self.factor = np.concatenate((discounts({i + 1: int(n) for i, n in enumerate(seen)}), [1.0]))
        return np.sort(np.concatenate(following)), top

    def answers(self, keys: np.ndarray, rows: list[dict], numbers: bool = False) -> tuple[np.ndarray, ...]:
        """For the distinct ascending keys of a chunk: counts and numbers if these are asked for, else counts, and of each
        context its denominator (0 if it was not trained), what discounting frees in it, and its weight.

        For contexts whose n-grams were all seen, replies tell only which low counts there are: that decides the
        denominator, and the others are not needed.
        """
        to, context = self.bucket_of(keys), keys >> np.uint64(self.bits)
        counts = np.zeros(len(keys), np.int64)
        if numbers:
            ids = np.zeros(len(keys), np.uint64)
        else:
            totals, spares, weights = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys))
        for row in rows:
            mine = np.flatnonzero(to == row["bucket"])
            c = wide(row["counts"]).astype(np.int64)
            counts[mine] = c
            if numbers:
                ids[mine] = wide(row["ids"])
                continue
            _, of = np.unique(context[mine], return_inverse=True)
            tokens, bits = wide(row["context"]).astype(np.int64).reshape(2, -1)
            sums, w = np.stack((tokens, *((bits >> (r - 1)) & 1 for r in range(1, K + 1)))), np.zeros(len(tokens))
            unseen = (tokens > 0) & (np.bincount(of[c == 0], minlength=len(tokens)) > 0)
            size = int.from_bytes(row["open"][:8], "little")
            sums[1:, unseen] = wide(row["open"][8 : 8 + size]).astype(np.int64).reshape(K, -1)
            w[unseen] = unpacked(row["open"][8 + size :], np.float64)
            total, spare = self.total(sums)
            totals[mine], spares[mine], weights[mine] = total[of], spare[of], w[of]
        if numbers:
            return counts, ids
        hot, is_hot = found(self.hot, context)
        if is_hot.any():
            total, spare = self.total(self.hot_stats)
            totals[is_hot], spares[is_hot], weights[is_hot] = total[hot[is_hot]], spare[hot[is_hot]], self.hot_weight[hot[is_hot]]
        return counts, totals, spares, weights

    def total(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Denominator of each context and what discounting frees in it; a context that frees nothing frees one count."""
        free = sum(r * stats[r] * (1 - self.factor[r - 1]) for r in range(1, K + 1))
        return np.where(stats[0] == 0, 0.0, np.where(free > 1e-9, stats[0], stats[0] + 1)), np.where(free > 1e-9, free, 1.0)

    def probability(self, counts: np.ndarray, total: np.ndarray, spare: np.ndarray, follow: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """follow: lower-order probability of all that was seen after the context; lower: that of the word."""
        trained, total = total > 0, np.maximum(total, 1)
        seen = counts * self.factor[np.clip(counts, 1, K + 1) - 1] / total
        back = spare / total / np.maximum(1 - follow, 1e-12) * lower
        return np.where(trained, np.where(counts > 0, seen, back), lower)


def score(docs: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row."""
    spark = docs.sparkSession
    pieces = written(chunked(docs))
    buckets = max(4, docs.count() // bucket_docs)

    # 1. words: numbers and counts
    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = from_ascending(row["words"]), wide(row["counts"])
                yield from record(requests(row["chunk"], spread(keys, buckets), keys, counts, np.zeros(len(keys), np.int64)), REQUEST).to_batches()

    def vocabulary(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [(table.column("chunk")[i].as_py(), from_ascending(table.column("keys")[i].as_py()), wide(table.column("counts")[i].as_py())) for i in range(table.num_rows)]
        keys, counts, _ = merged([p[1] for p in parts], [p[2] for p in parts], [p[2] for p in parts])
        ids, order = numbered(counts, buckets, bucket, UNKNOWN + 1)
        falling = counts[order]
        starts = np.flatnonzero(np.diff(falling, prepend=0))
        rows = [(-1, 1, bucket, narrow(falling[starts]), narrow(starts), b"", b"", [int(counts.sum()), len(keys)], int(ids.max(initial=UNKNOWN)))]
        for chunk, k, _ in parts:
            at, hit = found(keys, k)
            rows.append((chunk, 1, bucket, b"", narrow(np.where(hit, ids[at], UNKNOWN) if len(keys) else np.full(len(k), UNKNOWN)), b"", b"", None, 0))
        return record(rows, REPLY)

    # numbers fall with the count inside a bucket, so its counts are runs: about the square root of its tokens
    ones = written(pieces.select("chunk", "words", "counts").mapInArrow(ask_words, REQUEST).groupBy("bucket").applyInArrow(vocabulary, REPLY))
    n, v, top_word, begins, values = 0, 0, UNKNOWN, [], []
    for row in ones.where("chunk = -1").toLocalIterator():
        n, v, top_word = n + row.r[0], v + row.r[1], max(top_word, row.top)
        begins.append(wide(row.ids).astype(np.int64) + row.bucket * 2**RANK_BITS)
        values.append(wide(row.counts).astype(np.int64))
    begins, values = (np.concatenate([np.empty(0, np.int64), *a]) for a in (begins, values))
    order = np.argsort(begins)
    shared = spark.sparkContext.broadcast((begins[order], values[order]))

    def count_of(ids: np.ndarray) -> np.ndarray:
        """Training count of each word number."""
        starts, counts = shared.value
        if not len(starts):
            return np.zeros(len(ids), np.int64)
        x = np.maximum(ids.astype(np.int64) - UNKNOWN - 1, 0)
        at = np.searchsorted(starts, x % buckets * 2**RANK_BITS + x // buckets, "right") - 1
        return np.where(ids > UNKNOWN, counts[at], 0)

    limit = max(1, n // (4 * buckets))
    hot_words = [np.empty(0, np.int64)]
    for i in np.flatnonzero(values[order] > limit):
        begin = int(begins[order][i])
        end = int(begins[order][i + 1]) if i + 1 < len(begins) and begins[order][i + 1] >> RANK_BITS == begin >> RANK_BITS else begin + 1
        hot_words.append(UNKNOWN + 1 + (np.arange(begin, end) % 2**RANK_BITS) * buckets + (begin >> RANK_BITS))
    starts_at = int(ones.where("chunk = -1").count() and n > 0)
    hot = np.unique(np.concatenate([*hot_words, np.full(starts_at, START)])).astype(np.uint64)

    # 2. tokens by number; base sums
    def as_numbers(mine: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        for row in mine.to_pylist():
            keys = from_ascending(row["words"])
            to, ids = spread(keys, buckets), np.full(len(keys), UNKNOWN, np.uint64)
            for reply in replies.select(["bucket", "ids"]).to_pylist():
                ids[to == reply["bucket"]] = wide(reply["ids"])
            rows.append((row["chunk"], row["doc_ids"], row["nulls"], row["held"], row["lengths"], narrow(ids[wide(row["tokens"]).astype(np.int64)])))
        return record(rows, TOKENS)

    asked = ones.where("chunk >= 0").select("chunk", "bucket", "ids")
    tokens = written(pieces.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(as_numbers, TOKENS))
    discard(pieces)
    discard(ones)
    bits = top_word.bit_length()

    def grams(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, document of each, held out or not, whether it begins a document, and bigram keys."""
        t, lengths = wide(row["tokens"]), wide(row["lengths"]).astype(np.int64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        begin = np.diff(doc, prepend=-1) > 0
        before = np.where(begin, np.uint64(START), np.roll(t, 1))
        return t, doc, unpacked(row["held"], np.bool_)[doc], begin, before << np.uint64(bits) | t

    # 3. bigrams
    low_bits = np.uint64(2**bits - 1)
    two = Level(2, bits, buckets, hot, lambda keys, _: count_of(keys & low_bits) + 1.0)

    def ask_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, held, _, pairs = grams(row)
                keys, inverse = np.unique(pairs, return_inverse=True)
                counts = np.bincount(inverse[~held], minlength=len(keys))
                yield from record(requests(row["chunk"], two.bucket_of(keys), keys, counts, None), REQUEST).to_batches()

    twos = written(tokens.mapInArrow(ask_bigrams, REQUEST).groupBy("bucket").applyInArrow(two.replied(limit), REPLY))
    hot_pairs, top_pair = two.fit(twos)
    if top_pair.bit_length() + bits > 64 or 2 * bits > 64:
        raise OverflowError("more words and word pairs than a 64-bit trigram key can tell apart")

    # 4. trigrams: a context is the number of a bigram
    three = Level(3, bits, buckets, hot_pairs, lambda _, low: low * two.factor[np.clip(low, 1, K + 1) - 1])

    def trigram_keys(t: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Trigram key of each token, 0 where the context was not trained or the text begins."""
        context = np.where(begin, np.uint64(0), np.roll(ids, 1))
        return np.where(context > 0, context << np.uint64(bits) | t, np.uint64(0))

    def ask_trigrams(mine: pa.Table, replies: pa.Table) -> pa.Table:
        rows, answers = [], replies.to_pylist()
        for row in mine.to_pylist():
            t, _, held, begin, pairs = grams(row)
            pairs, inverse = np.unique(pairs, return_inverse=True)
            c2, ids = two.answers(pairs, answers, numbers=True)
            triples = trigram_keys(t, begin, ids[inverse])
            some = triples > 0
            keys, first, of = np.unique(triples[some], return_index=True, return_inverse=True)
            counts = np.bincount(of[~held[some]], minlength=len(keys))
            rows += requests(row["chunk"], three.bucket_of(keys), keys, counts, c2[inverse[some][first]])
        return record(rows, REQUEST)

    fields = ["chunk", "level", "bucket", "counts", "ids", "context", "open"]
    of_two = twos.where("chunk >= 0").select(fields)
    by_chunk = tokens.groupBy("chunk")
    threes = written(by_chunk.cogroup(of_two.groupBy("chunk")).applyInArrow(ask_trigrams, REQUEST).groupBy("bucket").applyInArrow(three.replied(n + 1), REPLY))
    three.fit(threes)

    # 5. probabilities, and sums over documents
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def evaluate(mine: pa.Table, replies: pa.Table) -> pa.Table:
        answers, out = replies.to_pylist(), []
        of_two, of_three = ([x for x in answers if x["level"] == level] for level in (2, 3))
        for row in mine.to_pylist():
            t, doc, _, begin, pairs = grams(row)
            c1 = count_of(t)
            p1 = (c1 + 1) / (n + v + 1)
            pairs, inverse = np.unique(pairs, return_inverse=True)
            c2, total2, spare2, follow2 = two.answers(pairs, of_two)
            p = two.probability(c2[inverse], total2[inverse], spare2[inverse], follow2[inverse] / (n + v + 1), p1)
            triples = trigram_keys(t, begin, two.answers(pairs, of_two, numbers=True)[1][inverse])
            some = triples > 0
            keys, first, of = np.unique(triples[some], return_index=True, return_inverse=True)
            del triples, pairs, c2, spare2, follow2
            c3, total3, spare3, weight3 = three.answers(keys, of_three)
            # the shorter context of a trigram is that of its last two words
            shorter = np.maximum(total2[inverse[some][first]], 1)
            p[some] = three.probability(c3, total3, spare3, weight3 / shorter, p[some][first])[of]
            del keys, first, of, c3, total3, spare3, weight3
            lengths, nulls = wide(row["lengths"]).astype(np.int64), unpacked(row["nulls"], np.bool_)
            sums = [np.bincount(doc, x, len(lengths)) for x in (np.log10(p1), np.log10(p), (c1 > 0).astype(float))]
            out.append(pa.Table.from_arrays([
                pa.array(unpacked(row["doc_ids"], np.int64), mask=nulls), pa.array(unpacked(row["held"], np.bool_)), pa.array(lengths), pa.array(np.rint(sums[2]).astype(np.int64)),
                pa.array(np.full(len(lengths), n, np.int64)), pa.array(sums[0]), pa.array(sums[1]),
            ], [x.split()[0] for x in result.split(", ")]))
        return pa.concat_tables(out)

    both = of_two.union(threes.where("chunk >= 0").select(fields))
    done = written(by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(evaluate, result))
    for table in (tokens, twos, threes):
        discard(table)
    return done
