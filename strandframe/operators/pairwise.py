"""Pairwise alignment: affine gaps over candidate windows, and the mapping pipeline of seeds, chains and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.sequences import reverse_complement
from strandframe.operators.sketch import chain_seeds, minimizers, seed_hits

RESULT = "score double, q_start long, q_end long, t_start long, t_end long, matches long, aln_len long, cigar string"
_LOW = -(1 << 40)


def align_pair(q: str, t: str, mode: str = "local", match: int = 1, mismatch: int = -1, open_: int = 5, extend: int = 2, extended_ops: bool = False) -> tuple:
    """Best alignment of two texts as ``(score, q_start, q_end, t_start, t_end, matches, aln_len, cigar)``.

    A gap of length n costs ``open_ + (n - 1) * extend``. Modes: ``local``; ``global`` (both whole);
    ``glocal`` (whole query, free ends of the target). A row of the matrix is computed at once: gaps
    along the row are a running maximum, which holds as long as opening costs no less than extending.
    One byte a cell remembers the way back. Empty texts align to nothing, or to one gap.
    """
    if mode not in ("local", "global", "glocal"):
        raise ValueError(f"unknown mode {mode}")
    if open_ < extend:
        raise ValueError("opening a gap must cost at least as much as extending it")
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (q, t))
    n, m = len(a), len(b)
    along = np.arange(m + 1, dtype=np.int64)
    way = np.zeros((n + 1, m + 1), np.uint8)  # bits 0-1: 0 stop, 1 both, 2 target gap (D), 3 query gap (I); bit 2: D goes on; bit 3: I goes on
    h = np.zeros(m + 1, np.int64)
    if mode == "global" and m:
        h[1:] = -open_ - (along[1:] - 1) * extend
        way[0, 1:] = 2
        way[0, 2:] |= 4
    up = np.full(m + 1, _LOW, np.int64)
    best, at = 0, (0, 0)
    for i in range(1, n + 1):
        goes_on = up - extend > h - open_
        up = np.maximum(up - extend, h - open_)
        edge = 0 if mode == "local" else -open_ - (i - 1) * extend
        both = np.full(m + 1, _LOW, np.int64)
        both[1:] = h[:-1] + np.where(b == a[i - 1], match, mismatch)
        top = np.maximum(both, up)
        if mode == "local":
            top = np.maximum(top, 0)
        top[0] = edge
        run = np.maximum.accumulate(top + along * extend)
        side = np.full(m + 1, _LOW, np.int64)
        side[1:] = run[:-1] - open_ - (along[1:] - 1) * extend
        new = np.maximum(top, side)
        w = np.where(both == new, 1, np.where(up == new, 3, 2)).astype(np.uint8)
        if mode == "local":
            w[new == 0] = 0
        w[0] = 0 if mode == "local" else 3
        w[1:] |= ((side[:-1] - extend > new[:-1] - open_).astype(np.uint8) << 2)
        w |= goes_on.astype(np.uint8) << 3
        way[i], h = w, new
        if mode == "local" and new.max() > best:
            best, at = int(new.max()), (i, int(new.argmax()))
    if mode == "global":
        best, at = int(h[m]), (n, m)
    elif mode == "glocal":
        best, at = int(h.max()), (n, int(h.argmax()))
    i, j = at
    ops: list[str] = []
    state = 0
    while True:
        if state == 0:
            state = int(way[i, j] & 3)
            if state == 0 or (i == 0 and mode != "global"):
                break
        if state == 1:
            ops.append("=" if a[i - 1] == b[j - 1] else "X")
            i, j, state = i - 1, j - 1, 0
        elif state == 2:
            ops.append("D")
            state, j = (2 if way[i, j] & 4 else 0), j - 1
        else:
            ops.append("I")
            state, i = (3 if way[i, j] & 8 else 0), i - 1
    ops.reverse()
    return float(best), i, at[0], j, at[1], ops.count("="), len(ops), cigar_of(ops, extended_ops)


def cigar_of(ops: list[str], extended_ops: bool = False) -> str:
    """Run lengths of operations; = and X become M unless ``extended_ops``."""
    out: list[list] = []
    for o in ops:
        o = o if extended_ops or o not in "=X" else "M"
        if out and out[-1][1] == o:
            out[-1][0] += 1
        else:
            out.append([1, o])
    return "".join(f"{n}{o}" for n, o in out)


def align(pairs: DataFrame, mode: str = "local", **scores: int) -> DataFrame:
    """Adds the columns of :data:`RESULT` to rows with ``q_seq`` and ``t_seq``, which go; a null text aligns as an empty one.

    Rows are independent: no shuffle, and memory of one byte for each cell of the largest pair.
    """
    import pyarrow as pa

    rest = [f for f in pairs.schema.fields if f.name not in ("q_seq", "t_seq")]
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = pairs.sparkSession.createDataFrame([], RESULT).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [align_pair(q or "", t or "", mode, **scores) for q, t in zip(x.column("q_seq").to_pylist(), x.column("t_seq").to_pylist(), strict=True)]
            cols = [x.column(f.name) for f in rest] + [pa.array([g[k] for g in got], kinds.field(c).type) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in rest] + names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), RESULT])
    return pairs.mapInArrow(run, schema)


def map_sequences(queries: DataFrame, targets: DataFrame, k: int = 15, w: int = 10, min_score: float = 0.0, min_seeds: int = 2, padding: int = 50, gap: int = 500, bandwidth: int = 100, mode: str = "local", **scores: int) -> DataFrame:
    """Alignments of ``seq_id, seq`` to ``seq_id, seq`` on both strands: seeds, chains, padded windows, alignment.

    ``query, target, strand, q_len, t_len`` and :data:`RESULT`; coordinates of a reverse hit's query
    are those of its reverse complement. Whole sequences are the windows in global mode; glocal takes the whole query.
    """
    both = queries.select("seq_id", F.explode(F.array(F.lit(1), F.lit(-1))).alias("strand"), "seq")
    both = both.select(F.struct("seq_id", "strand").alias("seq_id"), F.when(F.col("strand") == -1, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    c = chain_seeds(seed_hits(minimizers(both, k, w), minimizers(targets, k, w)), gap, bandwidth, min_seeds)
    d = c.join(both.select(F.col("seq_id").alias("query"), F.col("seq").alias("qs")), "query").join(targets.select(F.col("seq_id").alias("target"), F.col("seq").alias("ts")), "target")
    zero = F.lit(0)
    if mode == "global":
        window = [zero, F.length("qs"), zero, F.length("ts")]
    else:
        window = [F.greatest(F.col("q_start") - padding, zero), F.least(F.col("q_end") + k + padding, F.length("qs")), F.greatest(F.col("t_start") - padding, zero), F.least(F.col("t_end") + k + padding, F.length("ts"))]
        if mode == "glocal":
            window = [zero, F.length("qs"), F.greatest(F.col("t_start") - F.col("q_start") - padding, zero), F.least(F.col("t_end") + F.length("qs") - F.col("q_end") + padding, F.length("ts"))]
    q0, q1, t0, t1 = (x.cast("int") for x in window)
    d = d.select(
        F.col("query.seq_id").alias("query"), "target", F.col("query.strand").alias("strand"), F.length("qs").alias("q_len"), F.length("ts").alias("t_len"), q0.alias("_q"), t0.alias("_t"),
        F.substring("qs", q0 + 1, q1 - q0).alias("q_seq"), F.substring("ts", t0 + 1, t1 - t0).alias("t_seq"),
    ).distinct()
    a = align(d, mode, **scores).where(F.col("score") >= min_score)
    shift = {c: F.col(c) + F.col("_q" if c[0] == "q" else "_t") for c in ("q_start", "q_end", "t_start", "t_end")}
    return a.withColumns(shift).drop("_q", "_t").distinct()
