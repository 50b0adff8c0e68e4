"""Synthetic tables: every row follows from its number and the seed alone, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.sequences import DNA


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) by hash of the seed and the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def sequences(spark: SparkSession, n: int, length: int | tuple[int, int], seed: int = 0, symbols: str = DNA, weights: list[float] | None = None) -> DataFrame:
    """``seq_id, seq``: n random sequences of one length, or of lengths from a range (both ends in), with symbols of given weights."""
    lo, hi = (length, length) if isinstance(length, int) else length
    w = weights or [1.0] * len(symbols)
    if len(w) != len(symbols) or min(w) < 0 or sum(w) <= 0:
        raise ValueError("weights must be one for each symbol, not negative and not all zero")
    size = (F.floor(uniform(seed, F.col("seq_id"), F.lit("n")) * (hi - lo + 1)) + lo).cast("int")

    some = [(c, x) for c, x in zip(symbols, w, strict=True) if x > 0]

    def symbol(u: Column) -> Column:
        reach, out = 0.0, F.when(F.lit(False), F.lit(""))
        for c, x in some[:-1]:
            reach += x / sum(w)
            out = out.when(u < reach, F.lit(c))
        return out.otherwise(F.lit(some[-1][0]))

    place = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    letters = F.transform(place, lambda i: symbol(uniform(seed, F.col("seq_id"), i)))
    return spark.range(n).select(F.col("id").alias("seq_id")).select("seq_id", F.array_join(letters, "").alias("seq"))


def intervals(spark: SparkSession, n: int, contigs: int = 1, length: int = 1_000_000, width: tuple[int, int] = (1, 1000), seed: int = 0) -> DataFrame:
    """``contig, row_id, start, end, strand``: n random intervals within contigs of one length."""
    k = F.col("row_id")
    d = spark.range(n).select(F.col("id").alias("row_id"))
    size = (F.floor(uniform(seed, k, F.lit("w")) * (width[1] - width[0] + 1)) + width[0]).cast("long")
    start = F.floor(uniform(seed, k, F.lit("s")) * F.greatest(length - size + 1, F.lit(1))).cast("long")
    strand = F.when(uniform(seed, k, F.lit("t")) < 0.5, 1).otherwise(-1)
    return d.select(F.floor(uniform(seed, k, F.lit("c")) * contigs).cast("long").alias("contig"), "row_id", start.alias("start"), F.least(start + size, F.lit(length)).alias("end"), strand.alias("strand"))


def features(spark: SparkSession, n: int, records: int, length: int, keys: tuple[str, ...] = ("CDS", "gene"), seed: int = 0) -> DataFrame:
    """``seq_id, feature_id, start, end, strand, key``: n random features over records of one length."""
    d = intervals(spark, n, records, length, (1, max(1, length // 10)), seed)
    key = F.element_at(F.array(*map(F.lit, keys)), (F.floor(uniform(seed, F.col("row_id"), F.lit("k")) * len(keys)) + 1).cast("int"))
    return d.select(F.col("contig").alias("seq_id"), F.col("row_id").alias("feature_id"), "start", "end", "strand", key.alias("key"))
