"""Rows of the language-model query: none vanish or merge, however they are partitioned."""

import pytest

from quirelake.llm import katz_words

ROWS = [(1, "a b a c"), (2, "a b"), (3, None), (10, "b c c a")]


@pytest.mark.parametrize("layout", ["union", "row by row"])
def test_repeated_rows_in_chunks_of_their_own(spark, layout):
    rows = lambda x, partitions: spark.createDataFrame(spark.sparkContext.parallelize(x, partitions), "doc_id long, text string")
    twice = rows(ROWS, 1).union(rows(ROWS, 1)) if layout == "union" else rows(ROWS + ROWS, 8)
    together = {r.doc_id: r for r in katz_words.score(rows(ROWS + ROWS, 1)).collect()}
    out = katz_words.score(twice).collect()
    assert sorted(r.doc_id for r in out) == sorted(2 * [r[0] for r in ROWS])
    for r in out:
        assert (r.n_tokens, r.n_known) == (len((dict(ROWS)[r.doc_id] or "").split()) + 1, together[r.doc_id].n_known)
        assert r.score == pytest.approx(together[r.doc_id].score) and r.base_score == pytest.approx(together[r.doc_id].base_score)
