"""Motif discovery: over-represented canonical k-mers, refined to count matrices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.sequences import DNA
from strandframe.operators.motifs import Motif, background
from strandframe.operators.sketch import kmer_counts

#: Fixed value: a k-mer is refined if it has more hits than this.
REFINE_OVER = 5


def log10_upper_tail(x: int, n: int, p: float) -> float:
    """log10 of P(X >= x) of a binomial, summed from the larger terms in log space."""
    if x <= 0 or p >= 1:
        return 0.0
    if x > n or p <= 0:
        return -math.inf
    odds = p / (1 - p)

    def log_term(i: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)

    def run(i: int, step: int) -> float:
        total, term = 0.0, 1.0
        while 0 <= i <= n and term > 1e-18 * (total + 1e-300):
            total += term
            term *= (n - i) / (i + 1) * odds if step > 0 else i / (n - i + 1) / odds
            i += step
        return total

    if x > n * p:
        return min(0.0, (log_term(x) + math.log(run(x, 1))) / math.log(10))
    lower = math.exp(log_term(x - 1)) * run(x - 1, -1)
    return math.log10(max(1 - lower, 1e-300))


def enriched(seqs: DataFrame, k: int, control: DataFrame | None = None) -> DataFrame:
    """``hash, n, expected, log10_p`` of each canonical k-mer against a control set, or else against the symbol frequencies.

    Control frequencies have one pseudocount for each possible k-mer. Only the total and four symbol
    counts reach the driver; the table of k-mers stays distributed.
    """
    counts = kmer_counts(seqs, k)
    if control is not None:
        other = kmer_counts(control, k).withColumnRenamed("n", "c")
        possible = (4**k + (4 ** (k // 2) if k % 2 == 0 else 0)) // 2
        whole = other.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t"))
        d = counts.join(other, "hash", "left").crossJoin(F.broadcast(whole)).withColumn("p", (F.coalesce("c", F.lit(0)) + 1) / (F.col("t") + possible))
    else:
        got = {r.symbol: r.n for r in background(seqs).collect()}
        total = max(1, sum(got.values()))
        freq = F.array(*(F.lit(got[s] / total) for s in DNA))
        code = F.transform(F.split("hash", ""), lambda c: c.cast("int"))
        product = lambda a: F.aggregate(a, F.lit(1.0), lambda s, x: s * F.get(freq, x))
        back = F.reverse(F.translate("hash", "0123", "2301"))
        other_strand = product(F.transform(F.split(back, ""), lambda c: c.cast("int")))
        d = counts.withColumn("p", product(code) + F.when(back == F.col("hash"), 0.0).otherwise(other_strand))

    @F.pandas_udf("double")
    def tail(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([log10_upper_tail(int(a), int(b), float(c)) for a, b, c in zip(x, n, p, strict=True)])

    everything = counts.agg(F.sum("n").alias("all"))
    d = d.select("hash", "n", "p").crossJoin(F.broadcast(everything))
    return d.select("hash", "n", (F.col("all") * F.col("p")).alias("expected"), tail("n", "all", "p").alias("log10_p"))


def _canonical(h: str) -> tuple[str, bool]:
    back = h.translate(str.maketrans("0123", "2301"))[::-1]
    return (h, False) if h <= back else (back, True)


def discover(seqs: DataFrame, k: int = 8, top: int = 10, control: DataFrame | None = None) -> list[tuple[str, int, float, Motif]]:
    """The ``top`` most enriched k-mers (a top-k report) as ``(k-mer, n, log10_p, motif)``.

    A k-mer of more than five hits is refined once: k-mers one substitution away join its count matrix.
    The neighbours of the reported k-mers are ``top * (3 k + 1)`` keys, joined to the counts.
    """
    best = enriched(seqs, k, control).orderBy("log10_p", "hash").limit(top).collect()
    near = []
    for r in best:
        own = {r.hash} | ({r.hash[:i] + c + r.hash[i + 1 :] for i in range(k) for c in "0123"} if r.n > REFINE_OVER else set())
        near += [(r.hash, h, _canonical(h)[0]) for h in sorted(own)]
    spark, found = seqs.sparkSession, {}
    if near:
        keys = spark.createDataFrame(near, "seed string, form string, hash string")
        found = {(r.seed, r.form): r.n for r in kmer_counts(seqs, k).join(F.broadcast(keys), "hash").collect()}
    out = []
    for r in best:
        m = np.zeros((4, k))
        for (seed, form), n in found.items():
            if seed == r.hash:
                m[[int(c) for c in form], np.arange(k)] += n
        word = "".join(DNA[int(c)] for c in r.hash)
        out.append((word, r.n, r.log10_p, Motif.from_counts(word, m)))
    return out
