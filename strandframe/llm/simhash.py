"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.components import connected_components
from strandframe.plans.session import materialize

SHINGLE = 4
MAX_BITS = 4
SEED = 42
_CHUNK = 1 << 16
#: Runs of a grid cell up to this length compare all their pairs at once; longer ones grow components.
_SHORT = 16

PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned: a bit is 1 if over half the shingle hashes set it; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(n, len(words))
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    for lo in range(0, len(a), _CHUNK):
        raw = b"".join([digest(flat[i:j], SEED) for i, j in zip(a[lo : lo + _CHUNK], b[lo : lo + _CHUNK])])
        total += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(a)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed long) for every row; null, empty and blank texts get 0."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], schema=PRINT)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def grid(fps: DataFrame) -> DataFrame:
    """``cell, fp``: the grid cells in which a fingerprint may meet those within ``MAX_BITS``.

    The embedding counts the bits of 32 segments of two bits (0 to 2 each), packed two bits a
    count into a long. Differing bits are at least the Manhattan distance of the counts, so
    fingerprints within 4 bits are within 2 in the counts of one half, and then some lattice
    point is within 1 of both. Each fingerprint goes to all points within 1 of its own in
    either half, 33 at most, which makes the range join an equi-join that loses nothing.
    """
    steps = "filter(transform(sequence(0, 31), i -> if(i % 2 = 0, if((shiftrightunsigned(h, i) & 3) < 2, h + shiftleft(1L, i), -1L), if((shiftrightunsigned(h, i - 1) & 3) > 0, h - shiftleft(1L, i - 1), -1L))), x -> x >= 0)"
    counts = "transform(array(fp & 4294967295L, shiftrightunsigned(fp, 32)), x -> x - (shiftrightunsigned(x, 1) & 1431655765L))"
    halves = fps.selectExpr("fp", f"posexplode({counts}) AS (half, h)").selectExpr("fp", "cast(half AS bigint) AS half", "h")
    return halves.selectExpr("fp", "half", f"explode(concat(array(h), {steps})) AS h").selectExpr("shiftleft(half, 32) | h AS cell", "fp")


def _forest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of x that links connect: grows one component after another, and each member meets only those not yet reached."""
    left, us, vs = x, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            near = np.bitwise_count(left ^ p) <= MAX_BITS
            if near.any():
                got = left[near]
                us.append(np.full(len(got), p))
                vs.append(got)
                queue.extend(got)
                left = left[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _links(cell: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Verified links within the runs of equal cells."""
    cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cell)]])
    long = ends - starts > _SHORT
    out = [_forest(fp[a:b]) for a, b in zip(starts[long], ends[long])]
    mark = np.ones(len(cell), bool)
    for a, b in zip(starts[long], ends[long]):
        mark[a:b] = False
    for d in range(1, min(_SHORT, len(cell))):
        hit = mark[d:] & (cell[d:] == cell[:-d])
        if not hit.any():
            break
        hit &= np.bitwise_count(fp[d:] ^ fp[:-d]) <= MAX_BITS
        out.append((fp[:-d][hit], fp[d:][hit]))
    return out


def links(fps: DataFrame) -> DataFrame:
    """``u, v``: links between distinct fingerprints, enough to connect all that are within ``MAX_BITS``."""

    def run(batches):
        def emit(cells, prints):
            for u, v in _links(cells, prints):
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u.view(np.int64), v.view(np.int64))), pa.array(np.maximum(u.view(np.int64), v.view(np.int64)))], schema=EDGE)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            c, f = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if c[0] == c[-1] and held and held[-1][0][-1] == c[0]:
                held.append((c, f))
                continue
            cut = int(np.searchsorted(c, c[-1]))  # the last run may go on
            held.append((c[:cut], f[:cut]))
            yield from emit(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            held = [(c[cut:], f[cut:])]
        if held:
            yield from emit(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    cells = grid(fps)
    return cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that chains of fingerprints within ``MAX_BITS`` connect.

    Returns one row per input row: ``doc_id, fp`` (signed long) and ``component_id``, the
    smallest doc_id of the group. Null, empty and blank texts share fingerprint 0 and link
    like any other; copies collapse to one fingerprint before any join, so a group of
    copies of any size costs one row; a null doc_id takes part but is never a smallest id
    unless its group has no other; repeated rows stay; an empty table gives no rows; other
    columns of ``docs`` are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = connected_components(links(distinct.select("fp")))
    label = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    label = materialize(label, "simhash-labels")
    least = label.groupBy("c").agg(F.min("first").alias("component_id"))
    return prints.join(label.join(least, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def fp_hex(fp):
    """A signed fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
