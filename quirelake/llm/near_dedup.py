"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact confirmation.

1. Each document becomes its set of distinct shingles (64-bit hashes; of 2 words unless told otherwise). Equal sets are one representative from
   here on, however many copies there are.
2. A SetSketch of the set: register i is the truncated minimum of exponential variables, floor(1 - log_b(min)), so
   equal positions of two sketches agree with about the sets' Jaccard similarity, and maxima merge sketches.
3. Bands of registers are bucketed. Each bucket links its members to its smallest one only (a star, not all pairs).
4. Candidates are screened by the joint maximum-likelihood estimate of the similarity from their registers and set
   sizes, six standard errors below the threshold, and confirmed on the full sets.
5. Connected components of the confirmed links. In buckets that still hold several components, a second star runs from
   the member that shares most such buckets, as the text that the others were made from does. Links between members of
   components that are still apart remain to be found: members outside a bucket's largest component are joined with the
   others by prefix filtering, which is exact: two sets this similar share an element among the first 20 % or so of each in any
   one order, and the first shared one stands early enough in both for the rest to suffice; here rare elements come
   first, so texts that differ from a large group meet none of it. What it finds is screened, confirmed and joined
   once more. Pairs inside a component are never made.

Joins on keys that a large group shares are sort-merge joins of written tables, which AQE splits where they are skewed.

Nulls and edge cases: a null, empty or blank text has the empty set and is linked with nothing; a text of one word has
one shingle, the word. A null doc_id is never a component's name unless alone: such a row is its own, not kept
(doc_id = component_id is not true). Every row is judged by its own text: rows that repeat a doc_id with different texts
may lie in different components. Ties do not arise, as the smallest doc_id names a component. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import byte_words, sized, written

SHINGLE = 2
THRESHOLD = (80, 100)
#: 48 bands of 5 registers: a pair of similarity 0.8 shares no bucket with probability 5e-9.
BANDS, ROWS = 48, 5
BASE = 1.005
#: The largest register value: minima of 32-bit uniforms span log_b(2^32) steps.
TOP = int(32 * np.log(2) / np.log(BASE)) + 2
SEED = 7

_random = np.random.default_rng(SEED)
_MULTIPLY = (_random.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_FLIP = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_WORD = xxhash.xxh64_intdigest


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text's whole sequence is its one shingle."""
    words = byte_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORD, words), np.uint64, len(words))
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = mixed(total + h[i : len(h) - n + 1 + i])
    return np.unique(total)


def set_key(elements: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(elements.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def registers(elements: np.ndarray) -> np.ndarray:
    """The SetSketch of a non-empty set, as uint16."""
    low = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FLIP), 2**32 - 1, np.uint32)
    for at in range(0, len(low), 512):  # blocks that stay in the cache
        block = (low[at : at + 512, None] ^ _FLIP) * _MULTIPLY
        np.minimum(least, block.min(axis=0), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + 1, 0, TOP).astype(np.uint16)


def estimate(u: np.ndarray, v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of sketch pairs (rows of u and v) with set sizes n_u and n_v.

    P(K_u > K_v) = p(a - c J), P(K_u < K_v) = p(c - a J) with a = n_u / (n_u + n_v), c = 1 - a and
    p(x) = -log_b(1 - x (b - 1) / b); the log-likelihood of the three counts is maximal on a grid of J.
    """
    more, less = (u > v).sum(1)[:, None], (u < v).sum(1)[:, None]
    same = u.shape[1] - more - less
    a = (n_u / (n_u + n_v))[:, None]
    c = 1 - a
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(a / c, c / a)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(a - c * grid), p(c - a * grid)
    likelihood = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(grid, likelihood.argmax(1)[:, None], 1)[:, 0]


def sketched(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, the set's 128-bit key (null if empty) and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, sketch = [], [], [], []
            for cell in batch.column(1):
                s = shingles(cell.as_py(), size)
                n.append(len(s))
                if len(s):
                    key = set_key(s)
                    k1.append(key[0]), k2.append(key[1])
                    sketch.append(registers(s).tobytes())
                else:
                    k1.append(None), k2.append(None), sketch.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sketch, pa.binary())], ["doc_id", "text_hash", "n_shingles", "k1", "k2", "sketch"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return texts.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, sketch binary")


def banded(reps: DataFrame) -> DataFrame:
    """(key, id) for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(ids), BANDS)).copy()
            for i in range(ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, i] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["key", "id"])

    return reps.select("id", "sketch").mapInArrow(run, "key long, id long")


def screened(pairs: DataFrame, reps: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is not six standard errors below the threshold."""
    level = threshold[0] / threshold[1]
    floor = level - 6 * float(np.sqrt(level * (1 - level) / (BANDS * ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = []
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                u, v = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(part.num_rows, -1) for i in (3, 5))
                n_u, n_v = (part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 4))
                kept.append(estimate(u, v, n_u, n_v) >= floor)
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(kept)))

    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = written(pairs.join(side("a").hint("merge"), "a")).join(side("b").hint("merge"), "b")
    return both.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long")


#: Elements before each of a prefix that its row holds, so that pairs are not made again at each element they share.
BEFORE = 8
#: Slots of the element counts that order the prefixes: a fixed number, whatever the corpus.
SLOTS = 2**20


def full_sets(docs: DataFrame, reps: DataFrame, ids: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, elements) of these representatives (a written table of ids), from the documents that have their sets."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, sets = [], []
            for i, cell, k1, k2 in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = shingles(cell.as_py(), size)
                if set_key(found) == (k1, k2):  # the doc_id may be repeated with other texts
                    own.append(i), sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(sets, pa.binary())], ["id", "elements"])

    wanted = written(ids.join(reps.select("id", "doc_id", "k1", "k2").hint("merge"), "id"))
    rows = docs.join(sized(wanted), "doc_id").select("id", "text", "k1", "k2")
    sets = written(rows.mapInArrow(full, "id long, elements binary"))
    # rows that repeat doc_id and text give a set more than once
    return sets if sets.count() == wanted.count() else written(sets.dropDuplicates(["id"]))


def across_components(members: DataFrame, reps: DataFrame, docs: DataFrame, threshold: tuple[int, int], size: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) of different components that may be similar enough, one of them an outsider.

    members: a written table of id, component, outsider. Elements are ordered by the count of their slot among the
    members, then by hash; any order gives all pairs, this one gives few.
    """
    least, whole = threshold
    sets = full_sets(docs, reps, written(members.select("id")), size)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for cell in batch.column(1):
                np.add.at(total, (np.frombuffer(cell.as_py(), np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        for at in range(0, len(used), 100_000):
            part = used[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["slot", "n"])

    counts = np.zeros(SLOTS, np.int64)
    for row in sets.mapInArrow(slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[row.column(0).to_numpy()] = row.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, places, sizes, before = [], [np.empty(0, np.uint64)], [], [], [np.empty(0, np.int64)]
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(cell.as_py(), np.uint64)
                n = x.size - -(-least * x.size // whole) + 1
                first = x[np.lexsort((x, shared.value[(x % np.uint64(SLOTS)).astype(np.int64)]))[:n]]
                ids.append(np.full(first.size, doc_id))
                parts.append(first)
                back = np.arange(first.size)[:, None] - np.arange(1, BEFORE + 1)[None, :]
                before.append(first.view(np.int64)[back[back >= 0]])
                places.append(np.arange(first.size))
                sizes.append(np.full(first.size, x.size))
            columns = [np.concatenate([np.empty(0, np.int64), *c]) for c in (ids, places, sizes)]
            ends = np.concatenate([[0], np.cumsum(np.minimum(columns[1], BEFORE))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(before)))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(np.concatenate(parts).view(np.int64)), pa.array(columns[1]), pa.array(columns[2]), lists], ["id", "element", "place", "size", "before"])

    first = written(sets.mapInArrow(prefixes, "id long, element long, place long, size long, before array<long>").join(members.hint("merge"), "id"))
    outside = written(first.where("outsider").select("element", F.col("id").alias("o"), F.col("component").alias("o_component"), F.col("place").alias("o_place"), F.col("size").alias("o_size"), F.col("before").alias("o_before")))
    # behind the first element that both share, no more than the shorter remainder can be shared; a pair is needed once, at
    # that element, so it is left out where both share one of the few elements just before
    enough = f"{whole + least} * least(size - place, o_size - o_place) >= {least} * (size + o_size)"
    pairs = first.join(outside.hint("merge"), "element").where(f"component <> o_component and (not outsider or id < o) and {enough} and not arrays_overlap(before, o_before)")
    return written(pairs.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct())


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: tuple[int, int], size: int = SHINGLE) -> DataFrame:
    """The pairs whose full sets are similar enough. pairs: a written table of representatives."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, whole = threshold
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                same = np.intersect1d(x, y, assume_unique=True).size
                kept.append(whole * same >= least * (x.size + y.size - same))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    sets = full_sets(docs, reps, written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), size)
    side = lambda x: sets.select(F.col("id").alias(x), F.col("elements").alias(f"e_{x}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return written(both.select("a", "b", "e_a", "e_b").mapInArrow(compare, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in edges (a, b), a written table.

    Every round points each vertex at its smallest neighbour or itself and contracts the edges; the number of
    vertices left at least halves with every two rounds. The pointers are composed at the end.
    """
    levels: list[DataFrame] = []
    edges = edges.select("a", "b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("parent")))
        levels.append(parent)
        point = lambda x: parent.select(F.col("id").alias(x), F.col("parent").alias(f"p_{x}"))
        one = written(edges.join(point("a").hint("merge"), "a").select("p_a", "b"))
        moved = one.join(point("b").hint("merge"), "b").where("p_a <> p_b")
        edges = written(moved.select(F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b")).distinct())
    if not levels:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = levels.pop()
    found = found.withColumnRenamed("parent", "component")
    while levels:
        below = levels.pop()
        onward = found.select(F.col("id").alias("parent"), "component")
        found = written(below.join(onward.hint("merge"), "parent", "left").select("id", F.coalesce("component", "parent").alias("component")))
    return found


def mixed_buckets(shared: DataFrame, named: DataFrame) -> DataFrame:
    """(key, id, component, main) of the buckets (key, id) that hold several components; main: the bucket's largest."""
    placed = written(shared.join(named.hint("merge"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    sizes = written(placed.groupBy("key", "component").agg(F.count("*").alias("n")))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    return written(placed.join(written(largest.select("key", F.col("top.component").alias("main"))).hint("merge"), "key"))


def through_hubs(mixed_rows: DataFrame, judged: DataFrame) -> DataFrame:
    """New pairs (a, b): each bucket's members of other components with its hub, the member that is in most mixed buckets."""
    degrees = written(mixed_rows.groupBy("id").agg(F.count("*").alias("degree")))
    ranked = mixed_rows.join(degrees.hint("merge"), "id").select("key", F.struct("degree", (-F.col("id")).alias("minus"), "component").alias("x"))
    hubs = written(ranked.groupBy("key").agg(F.max("x").alias("x")).select("key", (-F.col("x.minus")).alias("hub"), F.col("x.component").alias("of")))
    pairs = mixed_rows.join(hubs.hint("merge"), "key").where("component <> of").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    return written(written(pairs.distinct()).join(judged.hint("merge"), ["a", "b"], "left_anti"))


def grouped(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """For every row doc_id, text_hash, n_shingles, component_id, and component: unlike component_id it tells apart
    groups whose smallest doc_id is the same, and is null where the set is empty or the doc_id null."""
    # a written table, so its row numbers are fixed; they name the sets, as a doc_id may have several
    sketches = written(sketched(docs, size).withColumn("row", F.monotonically_increasing_id()))
    sets = sketches.where("k1 is not null and doc_id is not null").groupBy("k1", "k2")
    one = sets.agg(F.min(F.struct("doc_id", "row")).alias("x"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    reps = written(one.select(F.col("x.row").alias("id"), "x.doc_id", "k1", "k2", "n", "sketch"))
    bands = written(banded(reps))
    stars = written(bands.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("members")).where("members > 1"))
    shared = written(bands.join(stars.hint("merge"), "key").select("key", "id", "center"))
    first = written(shared.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct())
    texts = docs.select("doc_id", "text")
    links = confirmed(written(screened(first, reps, threshold)), reps, texts, threshold, size)
    mixed_rows = mixed_buckets(shared, written(components(links)))
    # buckets that still hold several components: once more a star, from the member that shares most of them
    hubs = through_hubs(mixed_rows, first)
    links = written(links.union(confirmed(written(screened(hubs, reps, threshold)), reps, texts, threshold, size)))
    mixed_rows = mixed_buckets(mixed_rows.select("key", "id"), written(components(links)))
    # what is left: outsiders against the rest
    members = written(mixed_rows.groupBy("id").agg(F.first("component").alias("component"), F.bool_or(F.col("component") != F.col("main")).alias("outsider")))
    second = across_components(members, reps, texts, threshold, size)
    # pairs of the first rounds were judged already
    judged = written(first.union(hubs))
    second = second.join(judged.hint("merge"), ["a", "b"], "left_anti")
    more = confirmed(written(screened(written(second), reps, threshold)), reps, texts, threshold, size)
    named = written(components(written(links.union(more))))
    by_set = written(reps.join(named.hint("merge"), "id", "left").select("k1", "k2", "doc_id", F.coalesce("component", "id").alias("component")))
    names = written(by_set.groupBy("component").agg(F.min("doc_id").alias("name")))
    by_set = by_set.drop("doc_id").join(names.hint("merge"), "component")
    joined = sketches.select("doc_id", "text_hash", "n_shingles", "k1", "k2").join(written(by_set).hint("merge"), ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id")).alias("component_id")
    return joined.select("doc_id", "text_hash", "n_shingles", own, F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))


def cluster(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row. size: words of a shingle."""
    rows = grouped(docs, threshold, size).select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_copies(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest doc_id (then text hash).

    Rows without words or doc_id are in no group and all stay. Of rows that repeat doc_id and text one stays.
    """
    places = written(grouped(docs, threshold, size).where("component is not null").select("component", "doc_id", "text_hash"))
    key = F.struct("doc_id", "text_hash")
    counted = places.groupBy("component").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    several = written(counted.where("n > 1").select("component", F.col("first.doc_id").alias("_d"), F.col("first.text_hash").alias("_h")))
    of_several = places.join(several.hint("merge"), "component")
    # as often as they occur: the winner's own repetitions are seen here
    judged = written(of_several.groupBy("doc_id", F.col("text_hash").alias("_text_hash")).agg(F.bool_or((F.col("doc_id") == F.col("_d")) & (F.col("text_hash") == F.col("_h"))).alias("_first"), F.count("*").alias("_n")))
    keys = ["doc_id", "_text_hash"]
    marked = docs.withColumn("_text_hash", F.xxhash64("text"))
    stay = marked.join(sized(written(judged.where("not _first or _n > 1").select(*keys))), keys, "left_anti").select(docs.columns)
    repeated = written(judged.where("_first and _n > 1").select(*keys))
    once = marked.join(sized(repeated), keys, "left_semi")
    columns = [c for c in docs.columns if c != "doc_id"]
    # one row of each: repeats of one text are alike in all that counts, so any order of the rest will do
    once = once.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.xxhash64(*[F.col(f"`{c}`") for c in columns])).alias("_x"))
    return stay.union(once.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_x.`{c}`") for c in docs.columns]))
