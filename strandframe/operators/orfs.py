"""Open reading frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.functions.sequences import STARTS, STOPS, kmers, reverse_complement


def find_orfs(seqs: DataFrame, min_length: int = 0, max_length: int | None = None) -> DataFrame:
    """Every in-frame start with the next stop, on both strands: ``seq_id, strand, start, end`` in strand coordinates, the stop included.

    Only start and stop codons leave the row that holds the sequence.
    """
    both = seqs.select("seq_id", F.lit(1).alias("strand"), "seq").unionByName(seqs.select("seq_id", F.lit(-1).alias("strand"), reverse_complement(F.col("seq")).alias("seq")))
    c = both.select("seq_id", "strand", F.posexplode(kmers(F.col("seq"), 3)).alias("pos", "c")).where(F.col("c").isin(*STARTS, *STOPS))
    w = Window.partitionBy("seq_id", "strand", F.col("pos") % 3).orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    d = c.withColumn("stop", F.min(F.when(F.col("c").isin(*STOPS), F.col("pos"))).over(w))
    d = d.where(F.col("c").isin(*STARTS) & F.col("stop").isNotNull()).select("seq_id", "strand", F.col("pos").alias("start"), (F.col("stop") + 3).alias("end"))
    d = d.where(F.col("end") - F.col("start") >= min_length)
    return d if max_length is None else d.where(F.col("end") - F.col("start") <= max_length)
