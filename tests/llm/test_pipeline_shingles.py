"""The near-duplicate stage of the pipeline against brute force on five-word shingles."""

import corpus_pipeline


def test_five_word_shingles(spark, tmp_path):
    words = [f"w{i}" for i in range(100)]
    put = lambda places: " ".join(f"e{i}" if i in places else w for i, w in enumerate(words))
    texts = {1: put(()), 2: put((10, 30, 50, 70, 90)), 3: put((50, 51)), 4: put(()), 5: "x y z"}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, t.split()) for d, t in texts.items())}
    component = {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = sorted((component[a], component[b]))[::-1]
                component = {d: new if c == old else c for d, c in component.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d in texts if component[d] == d) == [1, 2, 5]
