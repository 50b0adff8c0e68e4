"""Motif models (small, on the driver) and distributed scanning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.sequences import DNA, count_of

#: Pseudocount, floor of a weight in bits, and bins per bit of the score distribution.
PSEUDO, FLOOR, BINS = 0.1, -100.0, 1000


@dataclass(frozen=True)
class Motif:
    """Log2 odds, one row per symbol of DNA and one column per position."""

    name: str
    weights: np.ndarray
    background: np.ndarray

    @classmethod
    def from_counts(cls, name: str, counts, background=None) -> Motif:
        c = np.asarray(counts, float) + PSEUDO
        bg = np.full(4, 0.25) if background is None else np.asarray(background, float)
        return cls(name, np.maximum(np.log2(c / c.sum(0) / bg[:, None]), FLOOR), bg)

    @property
    def width(self) -> int:
        return self.weights.shape[1]

    def reverse_complement(self) -> Motif:
        at = [DNA.index(c) for c in "AGTC"]
        return Motif(self.name, self.weights[at][:, ::-1], self.background[at])

    def distribution(self) -> tuple[int, np.ndarray]:
        """Exact distribution of discretised scores under the background: lowest score and probabilities."""
        w = np.rint(self.weights * BINS).astype(int)
        low, p = 0, np.ones(1)
        for col in w.T:
            shift = col - col.min()
            q = np.zeros(len(p) + shift.max())
            for s, b in zip(shift, self.background, strict=True):
                q[s : s + len(p)] += b * p
            low, p = low + col.min(), q
        return low, p

    def threshold(self, pvalue: float) -> float:
        """The least score whose tail probability is at most ``pvalue``."""
        low, p = self.distribution()
        tail = np.cumsum(p[::-1])[::-1]
        ok = np.flatnonzero(tail <= pvalue * (1 + 1e-12))
        return (low + (ok[0] if len(ok) else len(p))) / BINS

    def pvalue(self, score: float) -> float:
        low, p = self.distribution()
        at = int(np.ceil(score * BINS - 1e-9)) - low
        return float(p[max(0, at) :].sum()) if at < len(p) else 0.0


#: Counts of the two boxes of sigma-70 promoters, rows T, C, A, G.
SIGMA70_35 = [[820, 840, 90, 240, 180, 180], [50, 50, 60, 100, 540, 140], [69, 50, 60, 560, 140, 540], [61, 60, 790, 100, 140, 140]]
SIGMA70_10 = [[770, 30, 450, 140, 120, 960], [80, 10, 140, 140, 230, 20], [50, 950, 260, 590, 510, 10], [100, 10, 150, 130, 140, 10]]


def sigma70(background=None) -> list[Motif]:
    """The -35 and -10 boxes of sigma-70 promoters."""
    return [Motif.from_counts("Sigma70_-35", SIGMA70_35, background), Motif.from_counts("Sigma70_-10", SIGMA70_10, background)]


def hits_to_features(hits: DataFrame, motifs: list[Motif]) -> DataFrame:
    """Hits as features on the forward strand's coordinates: ``seq_id, start, end, strand, key, score``; the key is the motif's name."""
    width = F.create_map(*[F.lit(x) for m in motifs for x in (m.name, m.width)])
    return hits.select("seq_id", F.col("pos").alias("start"), (F.col("pos") + F.element_at(width, F.col("motif"))).alias("end"), "strand", F.col("motif").alias("key"), "score")


def background(seqs: DataFrame) -> DataFrame:
    """``symbol, n`` over all sequences, every symbol present."""
    one = seqs.agg(*(F.coalesce(F.sum(count_of(F.col("seq"), s)), F.lit(0)).alias(s) for s in DNA))
    return one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("symbol"), F.col(s).alias("n")) for s in DNA))).alias("x")).select("x.symbol", "x.n")


def scan(seqs: DataFrame, motifs: list[Motif], min_score: float) -> DataFrame:
    """Hits of every motif at every position on both strands: ``seq_id, motif, pos, strand, score``.

    Expressions only, in one pass over the table: the symbols of a sequence become an array of places in TCAG once, a window's
    score is the sum of position weights read from literal arrays, and the hits of all motifs and strands leave the row
    together; sequences are never split between rows.
    """
    code = F.transform(F.split(F.col("seq"), ""), lambda c: F.instr(F.lit(DNA), c) - 1)

    def found(m: Motif, strand: int) -> Column:
        x = m if strand > 0 else m.reverse_complement()
        cols = [F.array(*map(F.lit, map(float, c))) for c in x.weights.T]
        at = F.when(F.size("code") >= m.width, F.sequence(F.lit(0), F.size("code") - m.width)).otherwise(F.array().cast("array<int>"))
        score = lambda i: sum((F.get(c, F.get(F.col("code"), i + k)) for k, c in enumerate(cols)), F.lit(0.0))
        hits = F.transform(at, lambda i: F.struct(F.lit(m.name).alias("motif"), i.alias("pos"), F.lit(strand).alias("strand"), score(i).alias("score")))
        return F.filter(hits, lambda h: h.score >= min_score)

    d = seqs.where(F.length("seq") > 0).select("seq_id", code.alias("code"))
    return d.select("seq_id", F.explode(F.concat(*(found(m, t) for m in motifs for t in (1, -1)))).alias("h")).select("seq_id", "h.motif", "h.pos", "h.strand", "h.score")
