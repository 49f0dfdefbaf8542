"""Corpus operators against brute force, exact round trips and edge cases."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quirelake.llm import decontaminate, html_extract, license_scan, near_dedup, packing, quality_classifier, quality_rules, sharding, substring_dedup

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def labels(spark, sf=SF):
    return spark.read.parquet(f"{sf}/labels.parquet")


# --- HTML

def test_html_boilerplate():
    page = """<html><head><title>T</title><script>if (a<b) x="</p>"</script></head><body><nav><a href=/>Home</a></nav><header><h1>Site</h1></header>
    <div class="cookie-notice">We use cookies and so do all of the others on this site for you.</div>
    <article><h1>Head &amp; tail</h1><p>First   line<br>next <b>bold</b> &#8217;x<p>Ti.</article>
    <aside>See also</aside><form><input value=x><label>Name</label></form><div id="comments"><article><p>I think that it is the best of all that I have seen in my life.</p></article></div><footer>&copy; us</footer></body></html>"""
    assert html_extract.main_text(page)[0] == "Head & tail\n\nFirst line next bold ’x\n\nTi."
    assert html_extract.main_text(None)[:3] == ("", 0, 0)
    assert html_extract.main_text("<p>" + "the end of it all is near " * 20_000)[0].count("end") == 20_000


def test_html_second_pass_inherits_from_nearest():
    page = "<div><p>It was the best of times, it was the worst of times, and that is all there is to say about it for now.</p><p>Short.</p><ul><li><a href=x>Link one</a></li><li><a href=y>Link two</a></li></ul></div>"
    assert html_extract.main_text(page)[0].endswith("\n\nShort.")


def test_html_corpus(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert len(out) == pages.count()
    for r in pages.collect():
        title = " ".join(html_extract.unescape(re.search("<h1>(.*?)</h1>", r.html, re.DOTALL)[1]).split())
        assert out[r.page_id].text.startswith(title) and out[r.page_id].n_chars == len(out[r.page_id].text)
    assert html_extract.extract(pages.limit(0)).count() == 0


# --- licences

def test_license_expressions():
    parse = lambda s: license_scan.evaluate(license_scan.postfix(license_scan.tokens(s)))
    assert parse("MIT OR Apache-2.0 AND GPL-2.0-only")[0] == "(mit or (apache-2.0 and gpl-2.0-only))"
    assert parse("(MIT OR GPL-2.0-only) AND BSD-3-Clause")[1:] == ({"mit", "gpl-2.0-only", "bsd-3-clause"}, True)
    assert parse("GPL-2.0-only WITH Classpath-exception-2.0 */ trailing")[0] == "(gpl-2.0-only with classpath-exception-2.0)"
    assert license_scan.postfix(license_scan.tokens("AND MIT")) is None
    assert parse("MIT OR")[0] == "mit"


def test_license_scan(docs, empty, corpus):
    out = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert out[1].labels == "mit" and out[1].n_base == 1 and out[1].first_word == out[1].last_word == out[1].n_words - 2
    assert out[4].n_words == 0 and out[4].first_word is None and out[4].labels == "" and out[4].score == 0
    assert out[10].base_labels == "gpl" and "apache-2.0" in out[10].labels and out[10].permissive is True and out[10].score == 1
    assert license_scan.scan(empty).count() == 0
    found = {r.doc_id: r for r in license_scan.scan(corpus).collect()}
    for r in corpus.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        places = sorted(i for phrase in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        x = found[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))


# --- sharding

def test_sharding(corpus, docs, empty):
    rows = sharding.shard(corpus).toPandas()
    counts = rows.groupby("shard").size()
    assert len(rows) == corpus.count() and counts.max() - counts.min() <= 1 and len(counts) == 40
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    spread = rows.groupby(["shard", "source"]).size().unstack(fill_value=0)
    assert (spread.max() - spread.min() <= 2).all()
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert all(zlib.crc32(texts[d].encode()) == c and len(texts[d].encode()) + 16 == s for d, c, s in zip(rows.doc_id, rows.text_crc32, rows["size"], strict=True))
    edge = sharding.shard(docs, shards=5).toPandas()
    assert len(edge) == docs.count() and edge[edge.doc_id == 4]["size"].item() == 16 and sorted(edge.groupby("shard").size()) == [2, 2, 2, 3, 3]
    assert sharding.shard(empty).count() == 0


# --- substring dedup

def test_substring_dedup(spark, docs, empty):
    passage = "The first one is here now. It has some more words in it than most. Then another one follows with yet more words. This is the very end of it."
    rows = [(1, f"Alpha beta. {passage} Gamma."), (2, f"Delta epsilon zeta.\n{passage}"), (3, "Nothing shared here. At all."), (4, passage)]
    out = {r.doc_id: r for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == rows[0][1] and out[2].text.strip() == "Delta epsilon zeta." and out[3].n_removed == 0 and not out[4].kept
    edge = substring_dedup.deduplicate(docs)
    assert edge.count() == docs.count() and edge.where("doc_id is null and n_removed > 0").count() == 0 and edge.where("doc_id = 4 and text is null").count() == 1
    assert substring_dedup.deduplicate(empty).count() == 0


def test_substring_dedup_brute_force(corpus):
    texts = {r.doc_id: r.text for r in corpus.collect()}
    seen, gone = {}, defaultdict(set)
    for doc in sorted(texts):
        units = substring_dedup.sentences(texts[doc])
        assert "".join(texts[doc][a:b] for a, b, _, _ in units) == texts[doc]
        for i in range(len(units)):
            j = next((j for j in range(i + substring_dedup.RUN, len(units) + 1) if sum(u[3] for u in units[i:j]) >= substring_dedup.WORDS), None)
            if j and seen.setdefault("\n".join(u[2] for u in units[i:j]), (doc, i)) != (doc, i):
                gone[doc].update(range(i, j))
    out = {r.doc_id: r.n_removed for r in substring_dedup.deduplicate(corpus).collect()}
    assert out == {d: len(gone[d]) for d in texts}


# --- decontamination

def test_decontamination(spark, docs, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    words = item.split()
    changed = [w if i not in (4, 12) else "other" for i, w in enumerate(words)]
    rows = [(1, f"See {item} here"), (2, "x " + " ".join(changed) + " y"), (3, " ".join(words[:8])), (4, None), (5, " ".join(reversed(words))), (None, item), (6, f"{item.upper()}!")]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (None, item)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {d: r.kept for d, r in out.items()} == {1: False, 2: False, 3: True, 4: True, 5: True, None: False, 6: False}
    assert out[1].overlap == 17 and out[1].item_id == 7 and out[2].overlap == 17 - 2 - 4
    assert decontaminate.decontaminate(docs, bench).count() == docs.count() and decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("not kept").count() == 0


# --- near duplicates

def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = WORDS.findall(lower(t or ""))
        sets[d] = set(zip(w, w[1:], strict=False)) or {tuple(w)} - {()}
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def test_near_dedup_family(spark):
    """A family whose members are linked through the base only in part, and strangers."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(150):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 14), replace=False):
            words[at] = f"e{d}_{at}"
        texts[d] = " ".join(words)
    texts |= {1000 + d: " ".join(f"s{d}_{i}" for i in range(30)) for d in range(20)} | {2000: None, 2001: "", 2002: "one", 2003: "ONE"}
    out = near_dedup.cluster(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).toPandas()
    component, size = brute_components(texts)
    assert dict(zip(out.doc_id, out.component_id, strict=True)) == component and dict(zip(out.doc_id, out.n_shingles, strict=True)) == size
    assert (out.kept == (out.doc_id == out.component_id)).all()


def test_near_dedup_edges(docs, empty):
    out = near_dedup.cluster(docs).toPandas()
    by = dict(zip(out.doc_id.fillna(-1), out.component_id, strict=True))
    assert len(out) == docs.count() and by[2] == 1 and by[3] == 1 and by[8] == 7 and by[5] == 5 and by[9] == 9
    assert near_dedup.cluster(empty).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    for shared in (900, 500, 100):
        a, b = x[: 500 + shared // 2], x[500 - shared // 2 :]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        u, v = (near_dedup.registers(near_dedup.mixed(s))[None, :] for s in (a, b))
        assert abs(near_dedup.estimate(u, v, np.array([float(len(a))]), np.array([float(len(b))]))[0] - true) < 0.13
    half = [near_dedup.registers(near_dedup.mixed(s)) for s in (x[:400], x[400:], x)]
    assert (np.maximum(half[0], half[1]) == half[2]).all()


# --- quality

def test_quality_rules(spark, corpus, docs, empty):
    out = {r.doc_id: r for r in quality_rules.rate(corpus, labels(spark)).collect()}
    for r in corpus.collect():
        words = WORDS.findall(r.text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in r.text.split("\n") if WORDS.search(x)]
        x = out[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in r.text), len(lines) - len(set(lines)), len(repeated))
        assert x.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words)) and not (x.base_failed and x.kept)
    edge = quality_rules.rate(docs, labels(spark)).toPandas()
    assert len(edge) == docs.count() and not edge[edge.doc_id == 4].kept.item()
    assert quality_rules.rate(empty, labels(spark)).count() == 0 and quality_rules.rate(docs, labels(spark).limit(0)).count() == docs.count()


@pytest.mark.parametrize("operator", ["rules", "classifier"])
def test_quality_held_out(spark, operator):
    """Fitted on half of the labels, the verdict agrees with the other half."""
    sf = "/root/testdata/sf0.01" if operator == "rules" else "/root/testdata/sf0.1"
    corpus, known = spark.read.parquet(f"{sf}/documents.parquet"), labels(spark, sf)
    fit, rest = known.where("doc_id % 2 = 0"), known.where("doc_id % 2 = 1")
    judged = (quality_rules.rate(corpus, fit) if operator == "rules" else quality_classifier.classify(corpus, fit)).select("doc_id", "kept")
    table = judged.join(rest, "doc_id").toPandas()
    assert table[table.quality == 1].kept.mean() > 0.9 and table[table.quality == 0].kept.mean() < (0.15 if operator == "rules" else 0.05)


def test_classifier_edges(spark, docs, empty):
    judged = quality_classifier.classify(docs, labels(spark))
    assert judged.count() == docs.count()
    assert quality_classifier.classify(docs, labels(spark).limit(0)).where("kept").count() == docs.count()
    assert quality_classifier.classify(empty, labels(spark)).count() == 0


def test_shrinkage(spark):
    level = spark.createDataFrame([("a", 90.0, 100), ("b", 10.0, 100), ("c", 0.0, 1)], "s string, total double, n long")
    s = quality_classifier.strength(level, 0.5)
    own = level.select("s", quality_classifier.shrunk(quality_classifier.F.lit(0.5), quality_classifier.F.col("total"), quality_classifier.F.col("n"), s).alias("m")).toPandas().set_index("s").m
    assert 0.1 < own["b"] < own["c"] < 0.5 < own["a"] < 0.9


# --- packing

def test_encoder_equals_tokenizers():
    import public_tokenizers

    fast, plain = (packing.Encoder(public_tokenizers.path(f"byte_bpe_50k.{x}")) for x in ("tiktoken", "json"))
    for text in ["", " a  b\n\n c", "it's 12345 x.y", "<|endoftext|> z", "日本語 😀 é\x1c\x85", "   ", "\r\n\t x"]:
        assert fast.encode(text) == plain.encode(text)


def test_plan_is_exact():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 65, 3000)
    packs = packing.plan(dict(Counter(lengths.tolist())), 64)
    placed = Counter()
    for count, pack in packs:
        assert sum(pack) <= 64
        for length in pack:
            placed[length] += count
    assert placed == Counter(lengths.tolist()) and sum(c for c, _ in packs) <= 1.02 * lengths.sum() / 64 + 1


def test_packing(corpus, docs, empty):
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for table in (corpus, docs):
        rows = packing.pack(table).toPandas()
        for _, g in rows.sort_values("offset").groupby("sequence_id"):
            assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
        assert rows.sequence_id.nunique() == rows.sequence_id.max() + 1
        expect = Counter()
        for r in table.collect():
            ids = encoder.encode(r.text or "") + (1).to_bytes(4, "little")
            for at in range(0, len(ids), 8192):
                expect[(-1 if r.doc_id is None else r.doc_id, at // 4, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192]), len(ids) // 4)] += 1
        rows["doc_id"] = rows.doc_id.fillna(-1).astype(int)
        assert Counter(rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)) == expect
    assert packing.pack(empty).count() == 0


# --- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == docs.count()
