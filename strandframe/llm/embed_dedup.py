"""Embedding near-duplicates by NN-descent."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.components import connected_components
from strandframe.plans.session import discard, materialize, release

THRESHOLD = 0.93
#: Neighbours in lists are within twice the angle of a link: links of one vector are that near to each other.
NEAR = math.cos(2 * math.acos(THRESHOLD))
K = 12
TREES = 8
LEAF = 1024
ROUNDS = 2
ATTEMPTS = 3
#: Vectors of each label that are audited, besides four times the root of its size.
AUDIT = 256
RECALL = 0.999
#: Vectors of a part of a crowded leaf, of a group and of a whole label; parts are compared in pairs.
LEAF_PART, GROUP_PART, LABEL_PART = 2 * LEAF, 512, 2048
#: Trees that are dealt at once, and neighbours that a vector has from one part of a leaf.
BATCH, LEAF_K = 8, 4
#: Bits of a signature, and bits that signatures of a link differ in: 4.5 deviations over the mean at the threshold, and 2.
BITS = 128
_P = math.acos(THRESHOLD) / math.pi
NEAR_BITS, LINK_BITS = (round(BITS * _P + z * math.sqrt(BITS * _P * (1 - _P))) for z in (4.5, 2.0))

_EDGE = "a long, b long, sim double"
_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])
_COUNT = pa.schema([("id", pa.int64()), ("d", pa.int64())])
log = logging.getLogger(__name__)


@dataclass
class Audit:
    """Audited vectors with links, and the part of them that was found; a vector weighs as one share of its group."""

    found: float
    true: float

    @property
    def recall(self) -> float:
        return self.found / self.true if self.true else 1.0


def _rows(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, vec`` as given, and ``sane``: whether the row can link."""
    vec = F.col(vec_col) if dict(df.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec"))
    fit = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return d.withColumn("sane", F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(fit, F.lit(False)))


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, h, h2, vec`` of rows that can link: vectors of finite, not all zero components, with a label, and two hashes of 64 bits."""
    d = rows.where("sane").select("vec_id", F.struct(F.col("label"), F.size("vec").alias("dim")).alias("label"), "vec")
    return d.select("vec_id", "label", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("h2"), "vec")


def _matrix(column) -> np.ndarray:
    """Unit vectors in double precision."""
    if not len(column):
        return np.zeros((0, 1))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _emit(a, b, s):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(s, float))], schema=_SCHEMA)


def _trees(depth: int, least: int) -> int:
    """Trees in which a pair at the threshold shares a leaf of this depth at least once with probability ``RECALL``."""
    if not depth:
        return 1
    return max(least, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - math.acos(THRESHOLD) / math.pi) ** depth)))


def _units(own: DataFrame, fn, schema: pa.Schema = _SCHEMA, ddl: str = _EDGE) -> DataFrame:
    """What ``fn`` finds in each pair of parts of each group of ``g, n, id, aux, vec``, n parts a group."""
    own = own.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    units = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("g", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "id", "aux", "vec")
    return _compare(units, fn, schema, ddl)


def _compare(units: DataFrame, fn, schema: pa.Schema = _SCHEMA, ddl: str = _EDGE) -> DataFrame:
    """What ``fn(same, p, x, u, q, y, v)`` finds between part i and part j of each ``g, i, j``: ids, vectors and aux of both.

    A row ``g, i, j, blk, id, aux, vec`` is in part blk; vectors of a group have one length.
    """

    def run(batches):
        def groups():
            key, parts = None, []
            for b in batches:
                keys = list(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
                cuts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]] + [len(keys)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if keys[lo] != key:
                        if parts:
                            yield key, parts
                        key, parts = keys[lo], []
                    own = b.slice(lo, hi - lo)
                    parts.append((own.column(3).to_numpy(), own.column(4).to_numpy(), own.column(5).to_numpy(), _matrix(own.column(6))))
            if parts:
                yield key, parts

        for (_, i, j), parts in groups():
            blk, ids, aux, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            p, q = blk == i, blk == j
            if p.any() and q.any():
                found = fn(i == j, ids[p], x[p], aux[p], ids[q], x[q], aux[q])
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, f.type.to_pandas_dtype())) for c, f in zip(found, schema, strict=True)], schema=schema)

    return units.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "id").mapInArrow(run, ddl)


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of entries that connect all that the true entries connect."""
    fresh_row, fresh_col = near.any(axis=1), near.any(axis=0)
    out_r, out_c = [], []
    for start in np.flatnonzero(fresh_row):
        if not fresh_row[start]:
            continue
        fresh_row[start] = False
        rows = np.array([start])
        while len(rows):
            cols = np.flatnonzero(fresh_col & near[rows].any(axis=0))
            out_r.append(rows[near[np.ix_(rows, cols)].argmax(axis=0)] if len(cols) else cols)
            out_c.append(cols)
            fresh_col[cols] = False
            rows = np.flatnonzero(fresh_row & near[:, cols].any(axis=1))
            out_r.append(rows)
            out_c.append(cols[near[np.ix_(rows, cols)].argmax(axis=1)] if len(rows) else rows)
            fresh_row[rows] = False
    return np.concatenate([*out_r, []]).astype(int), np.concatenate([*out_c, []]).astype(int)


def _joined(same, p, x, u, q, y, v):
    """Links that connect all which links between the two parts connect."""
    s = x @ y.T
    m, n = _forest(s >= THRESHOLD)
    return p[m], q[n], s[m, n]


def _near_signatures(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids whose signatures are near: the ``LEAF_K`` nearest of each, and a forest that connects all that are likely links."""
    found = []
    for lo in range(0, len(p), 64):
        at = lo if same else 0
        h = np.bitwise_count(x[lo : lo + 64, None, 0] ^ y[None, at:, 0]) + np.bitwise_count(x[lo : lo + 64, None, 1] ^ y[None, at:, 1])
        i, j = np.nonzero(h <= NEAR_BITS)
        found.append((i + lo, j + at, h[i, j]))
    i, j, h = (np.concatenate(c) for c in zip(*found, strict=True))
    if same:
        i, j, h = (c[i < j] for c in (i, j, h))
    if not len(i):
        return p[i], q[j]
    near = h <= LINK_BITS
    r, c = (np.unique(np.concatenate([i[near], j[near]])),) * 2 if same else (np.unique(i[near]), np.unique(j[near]))  # only those with a likely link
    link = np.zeros((len(r), len(c)), bool)
    link[np.searchsorted(r, i[near]), np.searchsorted(c, j[near])] = True
    if same:
        link |= link.T
        np.fill_diagonal(link, True)
    m, n = _forest(link)
    m, n = r[m], c[n]
    ends = (np.concatenate([i, j + (0 if same else len(p))]), np.concatenate([h, h]), np.concatenate([np.arange(len(i))] * 2))
    by = np.lexsort((ends[2], ends[1], ends[0]))
    own = ends[0][by]
    first = np.concatenate([[True], own[1:] != own[:-1]])
    rank = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
    best = np.unique(ends[2][by[rank < LEAF_K]])
    return np.concatenate([p[i[best]], p[m]]), np.concatenate([q[j[best]], q[n]])


def _mixed(lab: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A 64-bit key of a label's hash and a leaf; leaves that share a key are compared for nothing, no more."""
    z = lab.view(np.uint64)[:, None] + (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def _depth(n):
    return F.least(F.lit(24), F.greatest(F.lit(0), F.ceil(F.log2(n / LEAF)))).cast("int")


def _leaves(points: DataFrame, trees: int, seed: int, lo: int = 0, hi: int = 1 << 30) -> DataFrame:
    """Pairs ``a, b`` of near signatures within leaves of the random-hyperplane trees lo to hi, whose depth follows each label's size and whose number the depth.

    Only ids and signatures are dealt, not vectors. A crowded leaf is dealt in parts; every pair of its parts is compared.
    """
    sizes = points.groupBy("label").count().select("label", _depth(F.col("count")).alias("depth"))
    d = points.join(F.broadcast(sizes), "label").select(F.xxhash64("label").alias("lab"), "id", "vec", "depth", F.col("label.dim").alias("dim"))

    def project(batches):
        planes: dict = {}
        for b in batches:
            sort = np.stack([b.column(3).to_numpy(), b.column(4).to_numpy()], axis=1)
            for depth, dim in np.unique(sort, axis=0).tolist():  # vectors of one depth and length at a time
                t = _trees(depth, trees)
                if t <= lo:
                    continue
                if (depth, dim) not in planes:
                    rng = np.random.default_rng([seed, dim, depth])
                    planes[depth, dim] = rng.normal(size=(BITS, dim)), rng.normal(size=(t * depth, dim))[lo * depth : hi * depth]
                own = b.filter(pa.array((sort == [depth, dim]).all(axis=1)))
                x, t = _matrix(own.column(2)), min(hi, t) - lo
                sign = np.packbits(x @ planes[depth, dim][0].T > 0, axis=1).view(np.int64)
                code = (x @ planes[depth, dim][1].T > 0).reshape(own.num_rows, t, depth) @ (1 << np.arange(depth))
                leaf = _mixed(own.column(0).to_numpy(), code + (np.arange(lo, lo + t) << 25)[None, :])
                ids = np.repeat(own.column(1).to_numpy(), t)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (leaf.ravel(), ids, np.repeat(sign[:, 0], t), np.repeat(sign[:, 1], t))], names=["g", "id", "s", "s2"])

    dealt = d.mapInArrow(project, "g long, id long, s long, s2 long")
    crowded = materialize(dealt.groupBy("g").count().where(F.col("count") > LEAF_PART).select("g", _parts(F.col("count"), LEAF_PART).alias("n")), "embed-crowded")
    own = dealt.join(F.broadcast(crowded), "g", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = own.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    side = F.when(F.col("blk") == F.col("o"), 2).when(F.col("blk") < F.col("o"), 0).otherwise(1)
    key = F.when(F.col("n") == 1, F.col("g")).otherwise(F.xxhash64("g", F.least("blk", "o"), F.greatest("blk", "o")))
    units = own.select(key.alias("g"), "id", "s", "s2", side.cast("tinyint").alias("side"))

    def run(batches):
        def groups():
            key, parts = None, []
            for b in batches:
                cols = [c.to_numpy() for c in b.columns]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(cols[0])) + 1, [b.num_rows]])
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if lo < hi:
                        if cols[0][lo] != key:
                            if parts:
                                yield parts
                            key, parts = cols[0][lo], []
                        parts.append([c[lo:hi] for c in cols[1:]])
            if parts:
                yield parts

        for parts in groups():
            ids, s, s2, side = (np.concatenate(c) for c in zip(*parts, strict=True))
            if len(ids) > 1:
                x, p, q = np.stack([s, s2], axis=1).view(np.uint64), side != 1, side != 0
                a, b = _near_signatures(ids[p], x[p], ids[q], x[q], bool((side == 2).all()))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return units.repartition("g").sortWithinPartitions("g", "id").mapInArrow(run, "a long, b long").where("a < b").distinct()


def _measured(vecs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, sim`` of pairs of one label, by exact cosine, if they are near enough for a list."""
    left = vecs.select(F.col("id").alias("a"), F.col("vec").alias("x"), "label")
    right = vecs.select(F.col("id").alias("b"), F.col("vec").alias("y"), F.col("label").alias("label2"))
    both = pairs.join(left, "a").join(right, "b").where("label = label2").select("a", "b", "x", "y", F.size("x").alias("n"))

    def dots(batches):
        for b in batches:
            if b.num_rows:
                dims = b.column(4).to_numpy()
                for n in np.unique(dims):  # vectors of one length at a time
                    own = b.filter(pa.array(dims == n)) if len(np.unique(dims)) > 1 else b
                    yield _emit(own.column(0).to_numpy(), own.column(1).to_numpy(), np.einsum("ij,ij->i", _matrix(own.column(2)), _matrix(own.column(3))))

    return both.mapInArrow(dots, _EDGE).where(F.col("sim") >= NEAR)


def _descend(vecs: DataFrame, lists: DataFrame, groups: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: neighbours of neighbours of each vector, where links do not connect them yet, are compared with it, exactly."""
    from pyspark.sql.window import Window

    both = lists.select("a", "b").union(lists.select("b", "a")).toDF("a", "b")
    for c in ("a", "b"):
        both = both.join(groups.select(F.col("id").alias(c), F.col("g").alias(f"g{c}")), c, "left").withColumn(f"g{c}", F.coalesce(f"g{c}", c))
    # hubs pass on a bounded list each round, another one in each; the audit decides about links that this misses
    near = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b", F.lit(turn))))).where(F.col("r") <= k)
    hop = near.select("a", "b", "ga").join(near.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("gb").alias("gc")), "b")
    hop = hop.where("ga <> gc AND a < c").select("a", F.col("c").alias("b")).distinct().join(lists.select("a", "b"), ["a", "b"], "left_anti")
    return _measured(vecs, hop)


def _degrees(same, p, x, u, q, y, v):
    """How many vectors of the other part, copies included, link with each."""
    near = x @ y.T >= THRESHOLD
    if same:
        np.fill_diagonal(near, False)
        return p, near @ v
    return np.concatenate([p, q]), np.concatenate([near @ v, u @ near])


def _parts(n, size: int):
    return F.ceil(n / size).cast("int")


def _counts(points: DataFrame, comp: DataFrame) -> DataFrame:
    """``id, d``: links of each vector within its connected group: saturated lists enlarged to the whole group, as counts.

    A group is dealt in blocks of its members; each pair of blocks is one task's unit of bounded size and gives
    one number a member, so no table of links is made.
    """
    size = comp.groupBy("g").count()
    own = points.join(comp, "id").join(size, "g").select("g", _parts(F.col("count"), GROUP_PART).alias("n"), "id", F.col("copies").alias("aux"), "vec")
    return _units(own, _degrees, _COUNT, "id long, d long").groupBy("id").agg(F.sum("d").alias("d"))


def _exact(points: DataFrame) -> DataFrame:
    """Links that connect all that links connect within labels, every pair compared in blocks."""
    own = points.join(F.broadcast(points.groupBy("label").count()), "label")
    return _units(own.select(F.col("label").alias("g"), _parts(F.col("count"), LABEL_PART).alias("n"), "id", F.lit(0).cast("long").alias("aux"), "vec"), _joined).where("a <> b").select("a", "b")


def _audit(points: DataFrame, comp: DataFrame, seed: int) -> DataFrame:
    """``label, found, true`` of every label: exact links of vectors chosen by hash against all rows of their label.

    Each label has its own sample, ``AUDIT`` vectors and four times the root of its size. A vector with
    t links weighs 1 / (1 + t), so that a group of any size counts about as much as an isolated pair. A link
    is found where its ends are in one group, since all pairs of a group are compared in the end. The samples are
    sent to where the vectors lie.
    """
    d = points.join(F.broadcast(points.groupBy("label").count()), "label")
    asked = d.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.col("count")) < AUDIT + 4 * F.sqrt("count"))
    sent: dict = {}
    for b in asked.select(F.xxhash64("label").alias("lab"), "id", "vec").toArrow().combine_chunks().to_batches():
        labs = b.column(0).to_numpy()
        for lab in np.unique(labs).tolist():
            own = b.filter(pa.array(labs == lab))
            sent.setdefault(lab, []).append((own.column(1).to_numpy(), _matrix(own.column(2))))
    sent = points.sparkSession.sparkContext.broadcast({k: tuple(np.concatenate(c) for c in zip(*v, strict=True)) for k, v in sent.items()})

    def links(batches):
        for b in batches:
            labs = b.column(0).to_numpy()
            for lab in np.unique(labs).tolist():
                own = b.filter(pa.array(labs == lab))
                ids, y = own.column(1).to_numpy(), _matrix(own.column(2))
                a, x = sent.value.get(lab, (ids[:0], y[:0]))
                for lo in range(0, len(a), 1024):
                    i, j = np.nonzero(x[lo : lo + 1024].astype(np.float32) @ y.astype(np.float32).T >= THRESHOLD - 1e-4)
                    same = (np.einsum("ij,ij->i", x[lo + i], y[j]) >= THRESHOLD) & (a[lo + i] != ids[j])
                    yield pa.RecordBatch.from_arrays([pa.array(a[lo + i[same]]), pa.array(ids[j[same]])], names=["a", "b"])

    each = points.select(F.xxhash64("label").alias("lab"), "id", "vec").mapInArrow(links, "a long, b long")
    for c in ("a", "b"):
        each = each.join(comp.select(F.col("id").alias(c), F.col("g").alias(f"g{c}")), c, "left").withColumn(f"g{c}", F.coalesce(f"g{c}", c))
    each = each.groupBy("a").agg(F.count("*").alias("t"), F.sum(F.expr("int(ga = gb)")).alias("f")).withColumnRenamed("a", "id")
    each = each.join(asked.select("id", "label"), "id")
    return each.groupBy("label").agg(F.sum(F.col("f") / F.col("t") / (1 + F.col("t"))).alias("found"), F.sum(1 / (1 + F.col("t"))).alias("true"))


def _groups(edges: DataFrame) -> DataFrame:
    return materialize(connected_components(edges, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("g")), "embed-groups")


def _links(lists: DataFrame, edges: DataFrame | None) -> DataFrame:
    found = lists.where(F.col("sim") >= THRESHOLD).select("a", "b")
    return found if edges is None else edges.union(found)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", trees: int = TREES, k: int = K) -> tuple[DataFrame, Audit]:
    """Links at cosine >= ``THRESHOLD`` between vectors of one label, and the components they form.

    Returns ``vec_id, n_links, component_id`` for every row, and the audit. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows with a null label or
    id, link with nothing and are components of their own; vectors of different lengths never link; identical
    vectors (of one label and 128 bits of hash) are one point until the end, so a group of copies of any size costs one row; a repeated vec_id
    gives a row for each of its rows, judged by its own vector. An empty table gives no rows; other columns are ignored.

    First lists come from random-hyperplane trees, ``trees`` at least, whose leaves compare signatures of ``BITS`` bits, and are then
    measured exactly; each round compares neighbours of neighbours, ``k`` of each, that no links connect yet; saturated lists then grow to the
    whole connected group. A brute-force audit of each label decides whether it needs more trees and
    rounds; after ``ATTEMPTS`` all pairs of the labels that still fall short are compared.
    """
    spark = df.sparkSession
    given = _rows(df, id_col, vec_col, label_col)
    rows = usable(given)
    reps = rows.groupBy("label", "h", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    reps = materialize(reps.withColumn("id", F.monotonically_increasing_id()), "embed-points")
    release(spark)
    points = reps.select("id", "label", "vec")
    active, lists, edges, audit = points, None, None, Audit(0.0, 0.0)
    for attempt in range(ATTEMPTS):
        depth = active.groupBy("label").count().agg(F.max(_depth(F.col("count"))).alias("d")).first().d
        pairs = []
        for lo in range(0, _trees(depth or 0, trees), BATCH):
            pairs.append(materialize(_leaves(active, trees, 11 + attempt, lo, lo + BATCH), "embed-pairs"))
            release(spark)
        pairs = materialize(reduce(DataFrame.union, pairs).distinct(), "embed-pairs")
        near = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        vecs = materialize(active.join(near, "id"), "embed-near")
        release(spark)
        lists = materialize(_measured(vecs, pairs), "embed-lists")
        groups = _groups(_links(lists, edges))
        for turn in range(ROUNDS):
            if lists.where(F.col("sim") < THRESHOLD).isEmpty():
                break  # neighbours of neighbours are all in one group
            found = materialize(_descend(vecs, lists, groups, k, attempt * ROUNDS + turn), "embed-lists")
            lists = lists.union(found)
            if not found.where(F.col("sim") >= THRESHOLD).isEmpty():
                groups = _groups(_links(lists, edges))
        discard(vecs)
        release(spark)
        edges = groups.select("id", "g").toDF("a", "b")
        seen = materialize(_audit(active, groups, attempt), "embed-audit")
        short = seen.where(F.col("found") < RECALL * F.col("true"))
        done = seen.join(short.select("label"), "label", "left_anti").agg(F.sum("found").alias("f"), F.sum("true").alias("t")).first()
        audit = Audit(audit.found + (done.f or 0), audit.true + (done.t or 0))
        if short.isEmpty():
            break
        active = points.join(F.broadcast(short.select("label")), "label", "left_semi").select("id", "label", "vec")
        trees *= 2
    else:
        groups = _groups(edges.union(_exact(active)))
        rest = short.agg(F.sum("true").alias("t")).first().t
        audit = Audit(audit.found + rest, audit.true + rest)
    log.info("audited recall %.6f over a weight of %.1f", audit.recall, audit.true)
    degree = materialize(_counts(reps.select("id", "copies", "vec"), groups), "embed-degrees")
    release(spark)
    grouped = groups.join(reps.select("id", "first"), "id")
    least = grouped.groupBy("g").agg(F.min("first").alias("component_id"))
    info = groups.join(least, "g").join(degree, "id", "left").select("id", "d", "component_id")
    found = reps.select("id", "label", "h", "h2", "first", "copies").join(info, "id", "left")
    found = found.select("label", "h", "h2", (F.coalesce("d", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    own = rows.select("vec_id", "label", "h", "h2").join(found, ["label", "h", "h2"]).select("vec_id", "n_links", "component_id")
    return own.unionByName(given.where("NOT sane").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))), audit
