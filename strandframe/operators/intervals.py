"""Interval algebra over ``contig, row_id, start, end, strand``: 0-based, half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bases of the narrowest bins of overlap joins, how much wider each level is, and bases of the bins in which intervals are merged.
WIDTH, FACTOR, SPAN = 64, 16, 1 << 18


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared bases of two intervals; 0 where they are apart."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def contains(s1: Column, e1: Column, s2: Column, e2: Column | None = None) -> Column:
    """Whether the first interval holds the second one, or the point ``s2``."""
    return (s1 <= s2) & ((s2 < e1) if e2 is None else (e2 <= e1))


def hull(s1: Column, e1: Column, t1: Column, s2: Column, e2: Column, t2: Column) -> Column:
    """The smallest interval around both: a struct of start, end and strand, 0 where strands differ."""
    return F.struct(F.least(s1, s2).alias("start"), F.greatest(e1, e2).alias("end"), F.when(t1 == t2, t1).otherwise(0).alias("strand"))


def intersection(s1: Column, e1: Column, t1: Column, s2: Column, e2: Column) -> Column:
    """What both share, with the first one's strand; an empty interval at the larger start where they are apart."""
    start = F.greatest(s1, s2)
    return F.struct(start.alias("start"), F.greatest(start, F.least(e1, e2)).alias("end"), t1.alias("strand"))


def overlap_join(a: DataFrame, b: DataFrame, stranded: bool = False, width: int = WIDTH) -> DataFrame:
    """One row per overlapping pair: ``contig, a_id, b_id, start, end, strand`` (of a).

    Bins have levels, each ``FACTOR`` times as wide as the one before; an interval's own level is the first whose bins are as
    long as it is. A pair meets at the higher of both own levels, so an interval goes, at each level from its own on that
    occurs in the tables, to the bins it touches there: two at most, however long it is. Both sides meet by an equi-join on contig, level and
    bin; a pair counts in its first common bin alone, so no distinct is needed, and a hot contig spreads over its bins.
    """
    size = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    level = F.greatest(F.ceil(F.log(size / width) / F.log(F.lit(float(FACTOR))) - 1e-9), F.lit(0)).cast("int").alias("level")
    used = sorted({r.level for r in a.select(level).distinct().union(b.select(level).distinct()).distinct().collect()})

    def binned(x: DataFrame, p: str) -> DataFrame:
        d = x.select("contig", F.col("row_id").alias(f"{p}_id"), F.col("start").alias(f"{p}s"), F.col("end").alias(f"{p}e"), F.col("strand").alias(f"{p}t"), level.alias(f"{p}own"))
        reach = F.greatest(F.col(f"{p}s"), F.col(f"{p}e") - 1)
        at = F.array(*(F.struct(F.lit(n).alias("level"), F.floor(F.col(f"{p}s") / (width * FACTOR**n)).alias("low"), F.floor(reach / (width * FACTOR**n)).alias("high")) for n in used)) if used else F.array().cast("array<struct<level:int,low:bigint,high:bigint>>")
        d = d.select("*", F.explode(F.filter(at, lambda v: v.level >= F.col(f"{p}own"))).alias("_x"))
        return d.select("*", "_x.level", F.col("_x.low").alias(f"{p}low"), F.explode(F.sequence("_x.low", "_x.high")).alias("bin")).drop("_x")

    j = binned(a, "a").join(binned(b, "b"), ["contig", "level", "bin"])
    j = j.where((F.col("as") < F.col("be")) & (F.col("bs") < F.col("ae")) & (F.col("level") == F.greatest("aown", "bown")) & (F.col("bin") == F.greatest("alow", "blow")))
    if stranded:
        j = j.where("at = bt")
    return j.select("contig", "a_id", "b_id", F.greatest("as", "bs").alias("start"), F.least("ae", "be").alias("end"), F.col("at").alias("strand"))


def merge(x: DataFrame, tolerance: int = 0, by: tuple[str, ...] = ("contig",), span: int = SPAN) -> DataFrame:
    """Unions of intervals that overlap, touch or lie within ``tolerance``; strand 0 where strands differ.

    A contig is cut into bins of ``span`` by start, so no task sorts a whole contig. What a bin needs of those before it is two numbers,
    the farthest end and the start of the block that is open; these come from running values over a row per bin.
    """
    keys = (*by, "_bin")
    d = x.withColumn("_bin", F.floor(F.col("start") / span))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)

    def joined(d: DataFrame, one: DataFrame) -> DataFrame:
        names = {k: f"_{k}_" for k in keys}
        right = one.select(*(F.col(k).alias(n) for k, n in names.items()), *(c for c in one.columns if c not in keys))
        same = [d[k].eqNullSafe(right[n]) for k, n in names.items()]
        return d.join(right, same).drop(*names.values())

    ends = d.groupBy(*keys).agg(F.max("end").alias("_end"))
    d = joined(d, ends.select(*keys, F.max("_end").over(before).alias("_reach")))
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    d = d.withColumn("_far", reach).withColumn("_cut", F.when(F.col("_far").isNull() | (F.col("start") > F.col("_far") + tolerance), F.col("start")))
    # a block is named by its start; the range frame takes equal intervals together, in whatever order they come
    d = d.withColumn("_block", F.max("_cut").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    out = d.groupBy(*keys, "_block").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("_a"), F.max("strand").alias("_b"), F.count("*").alias("n"))
    # the rest of a block that an earlier bin began has no name yet: it is the last one begun before the bin
    begun = out.groupBy(*keys).agg(F.max("_block").alias("_last"))
    out = joined(out, begun.select(*keys, F.max("_last").over(before).alias("_open"))).withColumn("_block", F.coalesce("_block", "_open"))
    out = out.groupBy(*by, "_block").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.sum("n").alias("n"))
    strand = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(0).alias("strand")
    return out.select(*by, "start", "end", *([] if "strand" in by else [strand]), "n")


def coverage(x: DataFrame) -> DataFrame:
    return merge(x).groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def complement(x: DataFrame, lengths: DataFrame) -> DataFrame:
    """Gaps up to each contig's ``length`` (columns ``contig, length``), strand 0."""
    blocks = merge(x).select("contig", "start", "end").unionByName(lengths.select("contig", F.col("length").alias("start"), F.col("length").alias("end")))
    w = Window.partitionBy("contig").orderBy("start", "end")
    d = blocks.join(lengths, "contig").select("contig", F.lag("end", 1, 0).over(w).alias("start"), F.least("start", "length").alias("end"))
    return d.where("start < end").withColumn("strand", F.lit(0))


def subtract(a: DataFrame, b: DataFrame, stranded: bool = False) -> DataFrame:
    """Pieces of each a outside of every b: ``contig, row_id, start, end, strand``."""
    by = ("contig", "strand") if stranded else ("contig",)
    cuts = merge(b, by=by)
    cuts = (cuts if stranded else cuts.drop("strand").withColumn("strand", F.lit(0))).withColumn("row_id", F.monotonically_increasing_id())
    hit = overlap_join(a, cuts, stranded).select("contig", F.col("a_id").alias("row_id"), F.col("start").alias("cs"), F.col("end").alias("ce"))
    ends = a.select("contig", "row_id", F.col("end").alias("cs"), F.col("end").alias("ce"))
    w = Window.partitionBy("contig", "row_id").orderBy("cs", "ce")
    d = hit.unionByName(ends).join(a, ["contig", "row_id"])
    d = d.select("contig", "row_id", F.coalesce(F.lag("ce").over(w), F.col("start")).alias("s"), F.col("cs").alias("e"), "strand")
    return d.where("s < e").select("contig", "row_id", F.col("s").alias("start"), F.col("e").alias("end"), "strand")


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per contig: bases in both over bases in either; 0 where neither has any."""
    ma, mb = (merge(x).withColumn("row_id", F.monotonically_increasing_id()) for x in (a, b))
    both = overlap_join(ma, mb).groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("i"))
    sums = [merge(x).groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias(n)) for x, n in ((a, "na"), (b, "nb"))]
    d = sums[0].join(sums[1], "contig", "full").join(both, "contig", "left").fillna(0, ["na", "nb", "i"])
    union = F.col("na") + F.col("nb") - F.col("i")
    return d.select("contig", F.when(union > 0, F.col("i") / union).otherwise(0.0).alias("jaccard"))


def query(x: DataFrame, start: int, end: int) -> DataFrame:
    return x.where((F.col("start") < end) & (F.col("end") > start))


def tile(x: DataFrame, width: int, step: int) -> DataFrame:
    """Full windows only."""
    d = x.where(F.col("end") - F.col("start") >= width)
    return d.select("contig", "row_id", F.explode(F.sequence(F.col("start"), F.col("end") - width, F.lit(step).cast("long"))).alias("start"), "strand").withColumn("end", F.col("start") + width)


def _sided(x: DataFrame, sides: list) -> DataFrame:
    d = x.select("contig", "row_id", "strand", F.explode(F.array(*[F.struct(F.lit(n).alias("side"), s.cast("long").alias("s"), e.cast("long").alias("e")) for n, s, e in sides])).alias("p"))
    return d.select("contig", "row_id", "p.side", F.greatest("p.s", F.lit(0)).alias("start"), F.col("p.e").alias("end"), "strand").where("start < end")


def flank(x: DataFrame, left: int, right: int, sides: str = "both") -> DataFrame:
    """Regions beside each interval, upstream and downstream by strand (or one of them); clipped at 0, empty ones dropped."""
    rev, s, e = F.col("strand") == -1, F.col("start"), F.col("end")
    regions = [("upstream", F.when(rev, e).otherwise(s - left), F.when(rev, e + left).otherwise(s)), ("downstream", F.when(rev, s - right).otherwise(e), F.when(rev, s).otherwise(e + right))]
    return _sided(x, [r for r in regions if sides in ("both", r[0])])


def promoters(x: DataFrame, up: int, down: int) -> DataFrame:
    rev, s, e = F.col("strand") == -1, F.col("start"), F.col("end")
    return x.select("contig", "row_id", F.greatest(F.when(rev, e - down).otherwise(s - up), F.lit(0)).alias("start"), F.when(rev, e + up).otherwise(s + down).alias("end"), "strand")


def pad(x: DataFrame, up: int, down: int) -> DataFrame:
    rev, s, e = F.col("strand") == -1, F.col("start"), F.col("end")
    return x.select("contig", "row_id", F.greatest(F.when(rev, s - down).otherwise(s - up), F.lit(0)).alias("start"), F.when(rev, e + up).otherwise(e + down).alias("end"), "strand")


def relate(s1, e1, t1, s2, e2):
    """Where the second interval lies seen from the first: upstream, downstream, inside, overlapping, overlapping_start or overlapping_end."""
    rev = t1 == -1
    return (
        F.when(e2 <= s1, F.when(rev, "downstream").otherwise("upstream")).when(s2 >= e1, F.when(rev, "upstream").otherwise("downstream"))
        .when((s2 >= s1) & (e2 <= e1), "inside").when((s2 < s1) & (e2 > e1), "overlapping")
        .when(s2 < s1, F.when(rev, "overlapping_end").otherwise("overlapping_start")).otherwise(F.when(rev, "overlapping_start").otherwise("overlapping_end"))
    )


def reverse_complement(x: DataFrame, length) -> DataFrame:
    return x.select("contig", "row_id", (length - F.col("end")).alias("start"), (length - F.col("start")).alias("end"), (-F.col("strand")).alias("strand"))


def cover_linear(x: DataFrame, max_overlap: float = 0.1, lengths: DataFrame | None = None, min_coverage: float = 0.0) -> DataFrame:
    """Greedy chain in start order: skips an interval whose overlap with the last kept one exceeds the share of its own length.

    The state is one interval, so a sorted stream of each contig needs no buffering. With ``lengths`` (``contig, length``) a
    contig keeps its chain only if the chain's bases, overlaps counted once, are at least ``min_coverage`` of its length; else it has none.
    """

    def run(batches):
        contig = last = None
        for f in batches:
            keep, own = [], []
            for c, s, e in zip(f.contig, f.start, f.end):
                if c != contig:
                    contig, last = c, None
                over = 0 if last is None else max(0, last - s)
                ok = over <= max_overlap * (e - s)
                keep.append(ok)
                if ok:
                    last = e
                    own.append(e - s - over)
            yield f[keep].assign(own=own)

    d = x.select("contig", "row_id", "start", "end", "strand")
    kept = d.repartition("contig").sortWithinPartitions("contig", "start", "end", "row_id").mapInPandas(run, d.schema.simpleString()[7:-1].replace(":", " ") + ", own long")
    if lengths is not None:
        enough = kept.groupBy("contig").agg(F.sum("own").alias("bases")).join(lengths, "contig").where((F.col("length") <= 0) | (F.col("bases") >= min_coverage * F.col("length")))
        kept = kept.join(enough.select("contig"), "contig", "left_semi")
    return kept.select(*d.columns)
