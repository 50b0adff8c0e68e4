"""Variants from alignments with CIGARs, by alignment and by pileup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.sequences import COMPLEMENT
from strandframe.operators.alignments import cigar_ops

#: Bases of a piece of a target in the join with its alleles.
PIECE = 4096


def is_snp(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def is_indel(ref: Column, alt: Column) -> Column:
    return F.length(ref) != F.length(alt)


def length_change(ref: Column, alt: Column) -> Column:
    return F.length(alt) - F.length(ref)


def variants(d: DataFrame, compare_m: bool = False) -> DataFrame:
    """Variants of ``row_id, contig, t_start, q_start, strand, cigar, q_seq, t_seq``: ``row_id, contig, start, end, strand, ref, alt``.

    An X run is one substitution, an I run an insertion at a point, a D run a deletion, in target
    coordinates; = and M only advance. With ``compare_m`` M runs are compared base by base as well.
    Rows without a CIGAR give nothing.
    """
    o = cigar_ops(d)
    at, n = F.col("t_start") + F.col("t_off"), F.col("n")
    q = lambda start, n: F.substring("q_seq", F.col("q_start") + F.col("q_off") + start + 1, n)
    t = lambda start, n: F.substring("t_seq", at + start + 1, n)
    keys = ("row_id", "contig")
    ref = F.when(F.col("op") == "I", "").otherwise(t(0, n))
    alt = F.when(F.col("op") == "D", "").otherwise(q(0, n))
    whole = o.where(F.col("op").isin("X", "I", "D")).select(*keys, at.alias("start"), F.when(F.col("op") == "I", at).otherwise(at + n).alias("end"), "strand", ref.alias("ref"), alt.alias("alt"))
    if not compare_m:
        return whole
    m = o.where("op = 'M'").withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    i, one = F.col("i"), F.lit(1)
    return whole.unionByName(m.where(t(i, one) != q(i, one)).select(*keys, (at + i).alias("start"), (at + i + 1).alias("end"), "strand", t(i, one).alias("ref"), q(i, one).alias("alt")))


def aligned_alleles(d: DataFrame) -> DataFrame:
    """``contig, pos, allele`` of every target position that an alignment covers: ``row_id, contig, t_start, q_start, strand, cigar, q_seq``.

    M, = and X give the query's base, complemented on the reverse strand; D and N give the empty allele; insertions and clips give nothing.
    """
    o = cigar_ops(d).where(F.col("op").isin(*"M=XDN")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    base = F.substring("q_seq", F.col("q_start") + F.col("q_off") + F.col("i") + 1, F.lit(1))
    base = F.when(F.col("strand") == -1, F.translate(base, *COMPLEMENT["DNA"])).otherwise(base)
    return o.select("contig", (F.col("t_start") + F.col("t_off") + F.col("i")).cast("long").alias("pos"), F.when(F.col("op").isin("D", "N"), "").otherwise(base).alias("allele"))


def call_pileup(d: DataFrame, targets: DataFrame, min_depth: int = 10, min_freq: float = 0.2) -> DataFrame:
    """Alleles that differ from the target: ``contig, start, end, ref, alt, n, depth``.

    Depth counts every allele at a position, deletions included; an allele is called where depth and its
    share reach their least values. Counts are partial sums before the shuffle; positions meet the
    targets ``contig, seq`` by contig and piece of ``PIECE`` bases, so no contig travels with its alleles.
    """
    n = aligned_alleles(d).groupBy("contig", "pos", "allele").agg(F.count("*").alias("n"))
    at = n.groupBy("contig", "pos").agg(F.sum("n").alias("depth"), F.collect_list(F.struct("allele", "n")).alias("alleles")).where(F.col("depth") >= min_depth)
    at = at.withColumn("piece", F.expr(f"pos div {PIECE}"))
    starts = F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.expr(f"(length(seq) - 1) div {PIECE}").cast("int"))).otherwise(F.array().cast("array<int>"))
    pieces = targets.select("contig", "seq", F.explode(starts).alias("piece")).select("contig", F.col("piece").cast("long").alias("piece"), F.substring("seq", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("bases"))
    got = at.join(pieces, ["contig", "piece"]).withColumn("ref", F.substring("bases", (F.col("pos") % PIECE).cast("int") + 1, F.lit(1))).where("ref <> ''")
    x = got.select("contig", "pos", "ref", "depth", F.explode("alleles").alias("x")).where((F.col("x.allele") != F.col("ref")) & (F.col("x.n") / F.col("depth") >= min_freq))
    return x.select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "ref", F.col("x.allele").alias("alt"), F.col("x.n").alias("n"), "depth")
