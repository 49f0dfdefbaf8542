"""The word trigram model of op7_lm_scoring against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quirelake.llm import katz_lm, katz_words, queries
from tests.llm.test_llm import SF, WORDS, lower

END, START = "</s>", "<s>"


def brute(texts):
    """Scores of (doc_id, text) rows, and p(word | two words)."""
    tokens = [[*WORDS.findall(lower(t or "")), END] for _, t in texts]
    train = [d is None or zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in texts]
    grams = [Counter(), Counter(), Counter()]
    for t, use in zip(tokens, train, strict=True):
        if use:
            row = [START, *t]
            grams[0].update((w,) for w in t)
            for k in (2, 3):
                grams[k - 1].update(zip(*(row[i:] for i in range(k)), strict=False))
    n, v = sum(grams[0].values()), len(grams[0])
    factor = [None, *([*katz_lm.discounts(Counter(g.values())), 1.0] for g in grams[1:])]
    after = [Counter(), Counter()]
    free, follow = [Counter(), Counter()], [Counter(), Counter()]

    def p(word, context):
        if not context:
            return (grams[0][(word,)] + 1) / (n + v + 1)
        k = len(context)
        if not after[k - 1][context]:
            return p(word, context[1:])
        c, spare = grams[k][(*context, word)], free[k - 1][context]
        total, spare = (after[k - 1][context], spare) if spare > 1e-9 else (after[k - 1][context] + 1, 1)
        return c * factor[k][min(c, 6) - 1] / total if c else spare / total / (1 - follow[k - 1][context]) * p(word, context[1:])

    for k in (1, 2):
        for g, c in grams[k].items():
            after[k - 1][g[:-1]] += c
            free[k - 1][g[:-1]] += c * (1 - factor[k][min(c, 6) - 1])
        for g in grams[k]:
            follow[k - 1][g[:-1]] += p(g[-1], g[1:-1])
    out = []
    for (d, _), t, use in zip(texts, tokens, train, strict=True):
        row = [START, *t]
        total = sum(math.log10(p(row[i], tuple(row[max(0, i - 2) : i]))) for i in range(1, len(row)))
        base = sum(math.log10(p(w, ())) for w in t)
        out.append((d, not use, len(t), sum(grams[0][(w,)] > 0 for w in t), n, base, total))
    return out, p, [w for (w,) in grams[0]]


def same(rows, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    rows, expected = sorted(map(tuple, rows), key=key), sorted(expected, key=key)
    assert [r[:5] for r in rows] == [r[:5] for r in expected]
    assert [r[5] for r in rows] == pytest.approx([r[5] for r in expected], rel=1e-9) and [r[6] for r in rows] == pytest.approx([r[6] for r in expected], rel=1e-9)


def test_trigrams_of_words(spark, corpus):
    expected, p, words = brute([(r.doc_id, r.text) for r in corpus.collect()])
    same(queries.op7_lm_scoring(spark, SF).collect(), expected)
    assert sum(p(w, tuple(words[:2])) for w in [*words, None]) == pytest.approx(1) and sum(p(w, (START, words[0])) for w in [*words, None]) == pytest.approx(1)


def test_edges(spark, docs, empty):
    out = katz_words.score(docs)
    same(out.collect(), brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])[0])
    assert katz_words.score(empty).count() == 0
    unseen = [(d, "a b") for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2]
    assert all(r.score == r.base_score == 0 and r.held_out for r in katz_words.score(spark.createDataFrame(unseen, "doc_id long, text string")).collect())


def test_repeated_rows(spark):
    rows = [(1, "a b a c"), (2, "a b"), (3, None), (10, "b c c a")]
    table = lambda x, partitions: spark.createDataFrame(spark.sparkContext.parallelize(x, partitions), "doc_id long, text string")
    for twice in (table(rows, 1).union(table(rows, 1)), table(rows + rows, 8)):
        same(katz_words.score(twice).collect(), brute(rows + rows)[0])


def test_hot_word_is_one_key_a_chunk():
    """A word with nearly all tokens reaches its bucket as one key and one count."""
    words = np.array([5] * 1000 + [9], np.uint64)
    keys, counts = np.unique(words, return_counts=True)
    (row,) = katz_words.requests(0, np.zeros(len(keys), np.int64), keys, counts, counts)
    assert katz_words.from_ascending(row[2]).tolist() == [5, 9] and katz_words.wide(row[3]).tolist() == [1000, 1]
