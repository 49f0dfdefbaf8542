"""Source divergence against plain counting over all pairs and terms, and against its SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from quirelake.llm import source_divergence
from quirelake.llm.source_divergence import SQL, audit


def expected(rows):
    """rows: (text, lang, source)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, holders = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        holders[lang or ""].update(set(terms))
    kept = {lang: {t for t, n in found.items() if n >= 30} for lang, found in holders.items()}
    result = []
    for lang, terms in kept.items():
        groups = [k for k in counts if k[0] == lang]
        total = sum((Counter({t: counts[g][t] for t in terms}) for g in groups), Counter())
        n = {g: sum(counts[g][t] for t in terms) for g in groups}
        p = {g: {t: 1 + 10**9 * (counts[g][t] + 5) // (n[g] + 5 * len(terms)) for t in terms} for g in groups}
        q = {t: 1 + 10**9 * (total[t] + 5) // (sum(n.values()) + 5 * len(terms)) for t in terms}
        for g in groups:
            pairs = sorted((-sum(abs(p[g][t] - p[o][t]) for t in terms), o[1].encode(), o[1]) for o in groups if o != g)
            result += [(lang, g[1], "pair", item, -v, i) for i, (v, _, item) in enumerate(pairs, 1)]
            more = sorted((q[t] - p[g][t], t.encode(), t) for t in terms if counts[g][t] and p[g][t] > q[t])
            result += [(lang, g[1], "term", item, -v, i) for i, (v, _, item) in enumerate(more[:50], 1)]
    return sorted(result)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, a language without kept terms, one with one source, odd letters."""
    rows = [(f"Ärger {'tie' * (i % 2)} same{'x' if i % 3 else 'Y'} don't É é KK {'rare' + chr(97 + i % 26)}", "xx", f"s{i % 7}") for i in range(90)]
    rows += [("equal both", "xx", "s1")] * 40 + [("only here " * 500, "yy", "one")] * 31 + [("few", "zz", s) for s in ("a", "b", None)] + [(None, None, None), ("", None, "a"), (None, "xx", "silent"), ("word " * 50_000, "xx", "s2")]
    return rows, spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term int, n int")


def test_equals_plain_counting(odd):
    rows, df = odd
    assert got(audit(df)) == expected(rows)


def test_small_chunks_and_blocks(odd, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(source_divergence, "CHUNK", 2)
    monkeypatch.setattr(source_divergence, "BLOCK", 2)
    monkeypatch.setattr(source_divergence, "COUNTED", 10)
    assert got(audit(df)) == expected(rows)


def test_equals_sql_and_counting_on_the_corpus(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    df = spark.read.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    mine = got(audit(df))
    assert mine == sorted(con.execute(SQL).fetchall())
    assert mine == expected([tuple(r) for r in df.select("text", "lang", "source").collect()])


def test_empty_table(empty):
    assert audit(empty).count() == 0
