"""Operators on alignment tables: ``row_id, query, target, score, q_start, q_end, q_len, t_start, t_end, t_len, strand, matches, aln_len``."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.operators.intervals import merge

#: SAM operations that consume query, target and alignment columns.
CONSUMES = {"query": "MIS=X", "target": "MDN=X", "alignment": "MIDN=X"}


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def rates(a: DataFrame) -> DataFrame:
    """Adds query and target coverage and identity; 0 where the length is 0."""
    return a.withColumns({"q_cov": share(F.col("q_end") - F.col("q_start"), F.col("q_len")), "t_cov": share(F.col("t_end") - F.col("t_start"), F.col("t_len")), "identity": share(F.col("matches"), F.col("aln_len"))})


def swap_sides(a: DataFrame) -> DataFrame:
    names = {"query": "target", "q_start": "t_start", "q_end": "t_end", "q_len": "t_len"}
    both = names | {v: k for k, v in names.items()}
    return a.select(*(F.col(c).alias(both.get(c, c)) for c in a.columns)).select(*a.columns)


def best(a: DataFrame, by: str = "query", per: int = 1) -> DataFrame:
    """The best rows of each query (or target) by score; the first row wins ties."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "row_id")
    return a.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per).drop("_r")


def filter_sides(a: DataFrame, queries: DataFrame | None = None, targets: DataFrame | None = None, anti: bool = False) -> DataFrame:
    for d, c in ((queries, "query"), (targets, "target")):
        if d is not None:
            a = a.join(d.select(c).distinct(), c, "left_anti" if anti else "left_semi")
    return a


def merge_overlaps(a: DataFrame, tolerance: int = 0) -> DataFrame:
    """Merged target intervals of every target at once."""
    return merge(a.select(F.col("target").alias("contig"), F.col("t_start").alias("start"), F.col("t_end").alias("end"), "strand"), tolerance)


def shift(a: DataFrame, x: int, y: int | None = None) -> DataFrame:
    """Moves the target interval; start by x, end by y (by x too if none is given)."""
    return a.withColumns({"t_start": F.col("t_start") + x, "t_end": F.col("t_end") + (x if y is None else y)})


def reverse_complement(a: DataFrame, length: Column) -> DataFrame:
    """Target intervals and strands as seen from the other strand of a target of that length."""
    return a.withColumns({"t_start": length - F.col("t_end"), "t_end": length - F.col("t_start"), "strand": -F.col("strand")})


def cull_overlaps(a: DataFrame, max_overlap: float = 0.1, key: str = "score") -> DataFrame:
    """Per target, in falling order of ``key``, drops a row whose overlap with any kept one exceeds the share of its own ``aln_len``.

    Kept intervals stay in a sorted list, searched by bisection over starts.
    """
    def run(batches):
        target, kept, longest = None, [], 0
        for f in batches:
            ok = []
            for t, s, e, n in zip(f.target, f.t_start, f.t_end, f.aln_len):
                if t != target:
                    target, kept, longest = t, [], 0
                at = bisect.bisect_left(kept, (s - longest, s - longest))
                good = True
                while at < len(kept) and kept[at][0] < e:
                    if min(e, kept[at][1]) - max(s, kept[at][0]) > max_overlap * n:
                        good = False
                        break
                    at += 1
                ok.append(good)
                if good:
                    bisect.insort(kept, (s, e))
                    longest = max(longest, e - s)
            yield f[ok]

    return a.repartition("target").sortWithinPartitions("target", F.desc(key), "row_id").mapInPandas(run, a.schema)


def chain(a: DataFrame, max_gap: int = 1000) -> DataFrame:
    """Collinear chains per query, target and strand: ``row_id, chain, chain_score``.

    Rows in query order join the best earlier row whose gaps on both axes are between 0 and
    ``max_gap``; target coordinates are negated on the reverse strand. Earlier rows wait in a list sorted by their query ends,
    so only those whose ends lie within ``max_gap`` before a row are compared. A row belongs to the chain of its best end, taken in falling order of score.
    """

    def solve(rows):
        n = len(rows)
        score, prev = [r[3] for r in rows], [-1] * n
        ends: list[tuple[int, int]] = []
        for j in range(n):
            lo, hi = bisect.bisect_left(ends, (rows[j][1] - max_gap, -1)), bisect.bisect_right(ends, (rows[j][1], n))
            for i in sorted((i for _, i in ends[lo:hi]), reverse=True):
                if 0 <= rows[j][4] - rows[i][5] <= max_gap and score[i] + rows[j][3] > score[j]:
                    score[j], prev[j] = score[i] + rows[j][3], i
            bisect.insort(ends, (rows[j][2], j))
        used, out = [False] * n, []
        for end in sorted(range(n), key=lambda k: (-score[k], rows[k][0])):
            own, k = [], end
            while k >= 0 and not used[k]:
                used[k] = True
                own.append(rows[k][0])
                k = prev[k]
            out += [(x, rows[end][0], score[end]) for x in own]
        return out

    def run(batches):
        import pandas as pd

        key, rows, out = None, [], []
        for f in batches:
            for q, t, st, i, qs, qe, sc, ts, te in zip(f["query"], f.target, f.strand, f.row_id, f.q_start, f.q_end, f.score, f.t_start, f.t_end):
                if (q, t, st) != key:
                    out += solve(rows)
                    key, rows = (q, t, st), []
                a_, b_ = (-te, -ts) if st < 0 else (ts, te)
                rows.append((i, qs, qe, float(sc), a_, b_))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["row_id", "chain", "chain_score"])
                out = []
        out += solve(rows)
        yield pd.DataFrame(out, columns=["row_id", "chain", "chain_score"])

    d = a.select("query", "target", "strand", "row_id", "q_start", "q_end", "score", "t_start", "t_end")
    return d.repartition("query", "target", "strand").sortWithinPartitions("query", "target", "strand", "q_start", "q_end", "row_id").mapInPandas(run, "row_id long, chain long, chain_score double")


def dovetails(a: DataFrame, tolerance: int = 10) -> DataFrame:
    """Per target: ``starts`` and ``ends``, sorted arrays of (query, strand) that touch its start or end."""
    at = F.struct(F.col("query").alias("node"), F.col("strand"))
    s, e = F.col("t_start") <= tolerance, F.col("t_end") >= F.col("t_len") - tolerance
    return a.where(s | e).groupBy("target").agg(F.sort_array(F.collect_set(F.when(s, at))).alias("starts"), F.sort_array(F.collect_set(F.when(e, at))).alias("ends"))


def cigar_ops(d: DataFrame, cigar: str = "cigar") -> DataFrame:
    """One row per CIGAR operation with running starts: ``idx, op, n, q_off, t_off, a_off``."""
    ops = F.transform(F.regexp_extract_all(F.col(cigar), F.lit(r"(\d+[MIDNSHP=XB])"), F.lit(1)), lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, r"^\d+", 0).cast("int").alias("n")))

    def before(which: str) -> Column:
        part = F.slice(F.col("_ops"), 1, F.col("idx"))
        return F.aggregate(part, F.lit(0), lambda s, x: s + F.when(x.op.isin(*CONSUMES[which]), x.n).otherwise(0))

    rest = [c for c in d.columns if c != "_ops"]
    e = d.withColumn("_ops", ops).select(*rest, "_ops", F.posexplode("_ops").alias("idx", "_x"))
    return e.select(*rest, "idx", "_x.op", "_x.n", before("query").alias("q_off"), before("target").alias("t_off"), before("alignment").alias("a_off"))
