"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

1. Document evidence: a naive Bayes classifier over binned features of the text, fitted on a bounded sample of labelled
   documents (`fitted` at most, the smallest by a hash of doc_id). Features are character ratios and the mean log
   likelihood ratio of the text's byte bigrams; that ratio is learnt on one half of the sample and binned on the other,
   both ways round, so that its bins are not those of texts it was learnt from. The model is a fixed number of figures.
2. Every document's classifier posterior is summed by host and by path. Host means are shrunk toward the global mean
   and path means toward their host's, with Beta strengths that the spread between sites gives (method of moments), so
   that sparse sites stay near their parents.
3. A document's posterior adds its evidence to the logit of its path's posterior mean; it is kept from `keep` on.

Evidence is one pass over the bytes of each text in Arrow batches; the text is never shuffled or written. Sites are
counted by grouped aggregation with partial sums, so a host with a third of all rows is no burden. The site table is
broadcast if its measured size allows, else joined by sort-merge.

Nulls and edge cases: a null text is an empty one; a null host or path is a site of its own; labels may hold nulls,
repeated ids and unknown ids (a repeated id counts as good if its mean label is at least 1/2); without labels of both
kinds the evidence is 0 and everything is kept; repeated rows are judged alike and all returned; other columns pass
through, but for `evidence`, `site_posterior`, `posterior` and `kept`, which the result defines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import sized, written

FITTED = 20_000
BINS = 16
KEEP = 0.5
#: Rows that every bin is taken to have had before the first.
PRIOR = 0.25
#: Documents that every bigram is taken to have made up, spread evenly, before the first.
BIGRAM_PRIOR = 1.0
BIGRAMS = 2**16

#: The characters whose shares are features.
SHARES = ("#*$%&^~@=_+", "|<>{}[]\\/", "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
STOPS = ".,;:"
N_FEATURES = len(SHARES) + 4
_OF = np.array([[chr(b) in marks for b in range(256)] for marks in (*SHARES, STOPS)], np.int64)


@dataclass
class Model:
    """Prior logit, bigram ratios with their centre and spread, and the log likelihood ratio of each feature and bin."""

    prior: float
    ratios: np.ndarray
    centre: float
    spread: float
    table: np.ndarray

    def evidence(self, text: str | None) -> float:
        data = (text or "").encode("utf-8", "surrogatepass")
        return float(self.table[np.arange(N_FEATURES + 1), [*bins(data), ratio_bin(mean_ratio(data, self.ratios), self.centre, self.spread)]].sum())


def bins(data: bytes) -> list[int]:
    """Bins (0 to BINS - 1) of ratios of a UTF-8 text; shares are binned on a square-root scale, so small ones differ."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = max(1, len(data) - int(counts[0x80:0xC0].sum()))
    words = data.split()
    n = max(1, len(words))
    share = lambda x: int(math.sqrt(min(x, 0.999)) * BINS)
    *marks, stops = _OF @ counts
    return [*(share(x / chars) for x in marks), share(stops / n), share(len(set(words)) / n), min(int(math.log2(n)), BINS - 1), min(chars // n, BINS - 1)]


def bigrams(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint16)
    return (a[:-1] << np.uint16(8)) | a[1:]


def mean_ratio(data: bytes, ratios: np.ndarray) -> float:
    return float(ratios[bigrams(data)].mean()) if len(data) > 1 else 0.0


def ratio_bin(x: float, centre: float, spread: float) -> int:
    """A quarter of the spread is one bin."""
    return min(max(int(math.floor(4 * (x - centre) / spread)) + BINS // 2, 0), BINS - 1)


def log_ratios(sums: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """log P(bigram | good) - log P(bigram | bad) from summed relative frequencies (2, BIGRAMS) and numbers of documents."""
    p = (sums + BIGRAM_PRIOR / BIGRAMS) / (docs + BIGRAM_PRIOR)[:, None]
    return np.log(p[1]) - np.log(p[0])


def fit(docs: DataFrame, labels: DataFrame, fitted: int = FITTED) -> Model:
    """The model of the labelled sample."""
    none = Model(0.0, np.zeros(BIGRAMS), 0.0, 1.0, np.zeros((N_FEATURES + 1, BINS)))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    known = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitted))
    # at most `fitted` ids are broadcast
    sample = written(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "good", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, BIGRAMS))
        for batch in batches:
            for cell, good, half in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = (cell.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) > 1:
                    sums[2 * half.as_py() + good.as_py()] += np.bincount(bigrams(data), minlength=BIGRAMS) / (len(data) - 1)
        kind, gram = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(gram, pa.int32()), pa.array(sums[kind, gram])], ["kind", "gram", "f"])

    # fixed numbers of rows come back: 4 x BIGRAMS, 4, and features x bins
    halves, documents = np.zeros((2, 2, BIGRAMS)), np.zeros((2, 2))
    for r in sample.groupBy("half", "good").count().collect():
        documents[r.half, r.good] = r["count"]
    if not documents.sum(0).all():
        return none
    for r in sample.mapInArrow(frequencies, "kind int, gram int, f double").groupBy("kind", "gram").agg(F.sum("f").alias("f")).toLocalIterator():
        halves[divmod(r.kind, 2)][r.gram] = r.f
    shared = docs.sparkSession.sparkContext.broadcast([log_ratios(halves[1 - h], documents[1 - h]) for h in (0, 1)])

    @F.arrow_udf("double")
    def crossed(text: pa.Array, half: pa.Array) -> pa.Array:
        return pa.array([mean_ratio((t.as_py() or "").encode("utf-8", "surrogatepass"), shared.value[h.as_py()]) for t, h in zip(text, half, strict=True)], pa.float64())

    @F.arrow_udf("array<int>")
    def all_bins(text: pa.Array) -> pa.Array:
        return pa.array([bins((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in text], pa.list_(pa.int32()))

    rated = written(sample.select("good", crossed("text", "half").alias("x"), all_bins("text").alias("bins")))
    centre, spread = rated.agg(F.avg("x"), F.stddev_pop("x")).first()
    spread = max(spread or 0.0, 1e-9)
    last = F.least(F.greatest(F.floor(4 * (F.col("x") - centre) / spread) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).cast("int")
    seen = np.zeros((2, N_FEATURES + 1, BINS))
    for r in rated.select("good", F.posexplode_outer(F.concat("bins", F.array(last))).alias("f", "b")).groupBy("good", "f", "b").count().collect():
        seen[r.good, r.f, r.b] = r["count"]
    bad, good = documents.sum(0)
    table = np.log((seen[1] + PRIOR) / (good + PRIOR * BINS)) - np.log((seen[0] + PRIOR) / (bad + PRIOR * BINS))
    return Model(math.log(good / bad), log_ratios(halves.sum(0), documents.sum(0)), centre, spread, table)


def shrunk(parent: Column, total: Column, n: Column, strength: float) -> Column:
    return (parent * strength + total) / (n + strength)


def strength(level: DataFrame, mean: Column | float) -> float:
    """Beta prior strength from the spread of site means around their parents', beyond what site sizes explain."""
    own = F.col("total") / F.col("n")
    mean = F.lit(mean) if isinstance(mean, float) else mean
    row = level.agg(F.avg((own - mean) ** 2).alias("spread"), F.avg(mean * (1 - mean)).alias("most"), F.avg(mean * (1 - mean) / F.col("n")).alias("noise")).first()
    between = max((row.spread or 0.0) - (row.noise or 0.0), 1e-6)
    return min(max((row.most or 0.0) / between - 1, 1.0), 1e6)


RESULTS = ("evidence", "site_posterior", "posterior", "kept")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", fitted: int = FITTED, keep: float = KEEP) -> DataFrame:
    """docs with evidence, site_posterior, posterior and kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fitted))
    prior = model.value.prior

    @F.arrow_udf("double")
    def weighed(text: pa.Array) -> pa.Array:
        return pa.array([model.value.evidence(t.as_py()) for t in text], pa.float64())

    logistic = lambda x: 1 / (1 + F.exp(-x))
    bounded = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    site = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (host, path)]
    judged = docs.withColumns({"_host": site[0], "_path": site[1]}).drop(*RESULTS).withColumn("evidence", weighed("text"))
    sites = written(judged.groupBy("_host", "_path").agg(F.sum(logistic(F.col("evidence") + prior)).alias("total"), F.count("*").alias("n")))
    hosts = sites.groupBy("_host").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    every = sites.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
    mean = min(max(every.total / every.n if every.n else 0.5, 1e-6), 1 - 1e-6)
    of_hosts = written(hosts.select("_host", bounded(shrunk(F.lit(mean), F.col("total"), F.col("n"), strength(hosts, mean))).alias("host_posterior")))
    of_sites = sites.join(of_hosts.hint("merge"), "_host")
    of_sites = written(of_sites.select("_host", "_path", bounded(shrunk(F.col("host_posterior"), F.col("total"), F.col("n"), strength(of_sites, F.col("host_posterior")))).alias("site_posterior")))
    joined = judged.join(sized(of_sites), ["_host", "_path"])
    posterior = logistic(F.col("evidence") + F.log(F.col("site_posterior") / (1 - F.col("site_posterior"))))
    return joined.drop("_host", "_path").withColumn("posterior", posterior).withColumn("kept", F.col("posterior") >= keep)
