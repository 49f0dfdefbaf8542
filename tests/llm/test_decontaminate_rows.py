"""Each row is judged by its own text; equal items are one; degenerate texts stay cheap."""

from quirelake.llm.decontaminate import decontaminate

ITEM = "the quick brown fox jumps over the lazy dog near the old river bank"


def test_rows_of_one_id_and_of_none(spark):
    rows = [(1, f"so {ITEM} indeed"), (1, "a clean text of its own"), (None, f"then {ITEM}"), (None, "clean too"), (2, f"so {ITEM} indeed"), (3, None), (3, "")]
    docs = spark.createDataFrame([(*r, 5, True, "x") for r in rows], "doc_id long, text string, n_items int, kept boolean, __text_1 string")
    bench = spark.createDataFrame([(9, ITEM), (4, ITEM.upper()), (9, "another item that nothing holds at all here"), (None, "a clean text of its own")], "item_id long, text string")
    out = decontaminate(docs, bench)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", r.kept, r.item_id, r.overlap, r.n_items) for r in out.collect())
    leak = lambda text, doc: (doc is not None, doc or 0, text, False, 4, 14, 2)
    clean = lambda text, doc: (doc is not None, doc or 0, text, True, None, None, None)
    assert got == sorted([leak(rows[0][1], 1), clean(rows[1][1], 1), leak(rows[2][1], None), clean(rows[3][1], None), leak(rows[4][1], 2), clean("", 3), clean("", 3)], key=lambda x: (x[0], x[1], x[2], x[3]))
    assert "__text_1" not in out.columns


def test_one_word_over_and_over(spark):
    docs = spark.createDataFrame([(i, "no " * 20_000) for i in range(20)] + [(99, "no " * 8)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "no " * 60), (2, "yes " * 12), (3, "no no no")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.overlap, r.n_items) for r in decontaminate(docs, bench).collect()}
    assert all(got[i] == (1, 60, 2) for i in range(20)) and got[99] == (3, 3, 1)
