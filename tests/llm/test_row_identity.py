"""Rows that repeat ids or texts: nothing is lost, merged or deleted that occurs once."""

import pytest

import corpus_pipeline
from quirelake.llm import decontaminate, html_extract, near_dedup, packing, quality_classifier, substring_dedup

P = "The first one is here now. It has some more words in it than most. Then another one follows with yet more words. This is the very end of it."
Q = "Nothing of this stands anywhere else at all. Each of its sentences is new to the whole table here. So all of them have to stay just where they are."
T1, T2, T3 = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
SCHEMA = "doc_id long, text string"


def test_substring_dedup_repeated_id(spark):
    out = substring_dedup.deduplicate(spark.createDataFrame([(1, P), (5, P), (5, Q), (5, Q)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.text, r.kept) for r in out) == sorted([(1, P, True), (5, "", False), (5, Q, True), (5, Q, True)])


def test_near_dedup_repeated_id(spark):
    rows = [(3, T1), (8, T1), (8, T2), (9, T3), (9, T3), (10, T1 + " x"), (11, None), (11, None)]
    out = near_dedup.cluster(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(3, 3, True), (8, 3, False), (8, 8, True), (9, 9, True), (9, 9, True), (10, 3, False), (11, 11, True), (11, 11, True)]
    alone = near_dedup.cluster(spark.createDataFrame([(8, T1), (8, T2), (8, T2 + " x")], SCHEMA)).collect()
    assert [(r.doc_id, r.component_id, r.kept) for r in alone] == 3 * [(8, 8, True)]


def test_near_duplicate_stage_drops_rows_not_ids(spark):
    rows = [(3, T1), (8, T1), (8, T2), (9, T3), (9, T3), (10, T1 + " x"), (11, None), (None, T1)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(((r.doc_id or 0), r.text or "") for r in out.collect()) == [(0, T1), (3, T1), (8, T2), (9, T3), (11, "")]
    same_id = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(8, T1), (8, T2), (8, T2 + " x")], SCHEMA), "").collect()
    assert len(same_id) == 2 and T1 in [r.text for r in same_id]


def test_pipeline_edges(spark, docs, empty, tmp_path):
    """Every stage on nulls, empty and long texts, ties, repeats, clashing columns, and on an empty table."""
    clashing = docs
    for name in ("evidence", "site_posterior", "posterior", "n_removed", "item_id", "overlap", "component", "_rest", "_h", "text_hash"):
        clashing = clashing.withColumn(name, near_dedup.F.lit("mine"))
    spark.createDataFrame([(1, 1), (4, 0), (None, 1), (6, None), (99, 0), (6, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, P), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == clashing.columns and out.dtypes == clashing.dtypes, name
        rows = out.collect()
        assert rows and all(r.evidence == r.item_id == r.text_hash == "mine" and r.kept == 1 for r in rows), name
        assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0
    assert len(corpus_pipeline.benchmark_leaks(spark, clashing, str(tmp_path)).collect()) == docs.count()
    left = corpus_pipeline.near_duplicates(spark, clashing, str(tmp_path)).select("doc_id").collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 1, 4, 5, 6, 7, 9, 10]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_classifier_columns_of_its_own_names(spark, docs):
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    out = quality_classifier.classify(docs.withColumn("site_posterior", quality_classifier.F.lit("x")), labels)
    assert out.count() == docs.count() and dict(out.dtypes)["site_posterior"] == "double"


def test_classifier_arithmetic(spark, corpus):
    """Site sums, shrinkage and posteriors against plain Python, from the documents' evidence."""
    import math
    from collections import defaultdict

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_classifier.fit(corpus, labels)
    rows = {r.doc_id: r for r in quality_classifier.classify(corpus, labels).collect()}
    logistic = lambda x: 1 / (1 + math.exp(-x))
    sites = defaultdict(list)
    texts = {r.doc_id: r for r in corpus.collect()}
    for d, r in texts.items():
        assert rows[d].evidence == pytest.approx(model.evidence(r.text))
        sites[r.source, r.lang].append(logistic(model.evidence(r.text) + model.prior))
    mean = sum(map(sum, sites.values())) / len(texts)
    hosts = defaultdict(list)
    for (h, _), x in sites.items():
        hosts[h] += x

    def strength(groups):  # (parent mean, values)
        spread = sum((sum(x) / len(x) - m) ** 2 for m, x in groups) / len(groups)
        most, noise = sum(m * (1 - m) for m, _ in groups) / len(groups), sum(m * (1 - m) / len(x) for m, x in groups) / len(groups)
        return min(max(most / max(spread - noise, 1e-6) - 1, 1.0), 1e6)

    s = strength([(mean, x) for x in hosts.values()])
    host = {h: (mean * s + sum(x)) / (len(x) + s) for h, x in hosts.items()}
    s = strength([(host[h], x) for (h, _), x in sites.items()])
    for d, r in texts.items():
        x = sites[r.source, r.lang]
        site = (host[r.source] * s + sum(x)) / (len(x) + s)
        assert rows[d].site_posterior == pytest.approx(site) and rows[d].posterior == pytest.approx(logistic(rows[d].evidence + math.log(site / (1 - site))))
        assert rows[d].kept == (rows[d].posterior >= 0.5)


def test_decontamination_brute_force(spark, corpus):
    """Every document and item of sf0.001 against each other on every diagonal."""
    import re

    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    items = {r.item_id: words(r.text) for r in bench.collect()}
    flagged = set()
    for r in corpus.collect():
        doc = words(r.text)
        places = {}
        for i, w in enumerate(doc):
            places.setdefault(w, []).append(i)
        for item in items.values():
            shifts = {i - k for k, w in enumerate(item) for i in places.get(w, ())}
            for shift in shifts:
                here = best = 0
                for k, w in enumerate(item):
                    if 0 <= k + shift < len(doc):
                        here = max(0, here + (1 if doc[k + shift] == w else -decontaminate.PENALTY))
                        best = max(best, here)
                if item and best >= min(decontaminate.LEAST, len(item)):
                    flagged.add(r.doc_id)
    out = decontaminate.decontaminate(corpus, bench).where("not kept").select("doc_id").collect()
    assert {r.doc_id for r in out} == flagged


def test_short_benchmark_items(spark):
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "one two three")], SCHEMA)
    out = {r.doc_id: r.kept for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: False, 2: True}


def test_near_dedup_links_of_every_twentieth_row(spark):
    """All documents of sf0.01 against those whose id is divisible by 20: every link by brute force is inside a component."""
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    component = {r.doc_id: r.component_id for r in near_dedup.cluster(corpus).collect()}
    sets = {r.doc_id: frozenset(near_dedup.shingles(r.text).tolist()) for r in corpus.collect()}
    links = 0
    for a in sets:
        if a % 20 == 0 and sets[a]:
            for b in sets:
                same = len(sets[a] & sets[b]) if a != b else 0
                if same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                    links += 1
                    assert component[a] == component[b], (a, b)
    assert links > 0


def test_html_tails_and_open_tags(spark):
    text = html_extract.main_text
    prose = "The end of the day is that x < y and the rest of it is here for you to read"
    assert text(f"<p>{prose}")[0] == prose and text(f"<p>{prose} <b")[0] == f"{prose} <b"
    assert text(f"<p>{prose}<!-- open")[0] == prose and text(f'<p title="a > b">{prose}</p>')[0] == prose
    assert text('<a x="' * 50_000)[1] == 1  # linear: no quote is ever closed
    rows = [(None, None, f"<p>{prose}"), (1, "u", f"<p>{prose}"), (1, "u", f"<p>{prose}"), (2, "v", "")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", near_dedup.F.lit(1))).collect()
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in out) == [(0, prose, len(prose)), (1, prose, len(prose)), (1, prose, len(prose)), (2, "", 0)]


def test_html_without_telling_elements():
    prose = "It was the best of times and it was the worst of times, and that is all that there is to say about it for now."
    page = f"<div><ul><li><a href=x>Home page</a></li><li><a href=y>All news</a></li></ul></div><div><h1>A head</h1><p>{prose}</p><p>In short.</p><p>{prose}</p></div><div><a href=z>Terms</a> <a href=w>Imprint</a></div>"
    out = html_extract.main_text(page)
    assert out[0] == f"A head\n\n{prose}\n\nIn short.\n\n{prose}" and out[3:] == (2, 3, 0, 2)


def test_special_token_is_one_id():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", " x" * 5000 + "<|endoftext|>", "y" * 20_000):
        assert packing.np.frombuffer(fast.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
