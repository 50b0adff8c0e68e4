"""Graph operators over ``edges(u, v, ...)`` and ``nodes(id, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.operators.components import connected_components
from strandframe.plans.session import discard, materialize


def build(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct edges, and nodes with the ends of edges added."""
    e = edges.dropDuplicates()
    ids = e.select(F.col("u").alias("id")).union(e.select("v"))
    if nodes is not None:
        ids = ids.union(nodes.select("id"))
    return e, ids.distinct()


def subgraph(edges: DataFrame, nodes: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = keep.select("id").distinct()
    e = edges.join(k.toDF("u"), "u", "left_semi").join(k.toDF("v"), "v", "left_semi")
    return e, nodes.join(k, "id", "left_semi")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Every edge the other way, its attributes kept."""
    return edges.select(*(F.col({"u": "v", "v": "u"}.get(c, c)).alias(c) for c in edges.columns))


def join_paths(a: Column, b: Column) -> Column:
    """Two paths (arrays of nodes) as one; the second must start where the first ends, else an error is raised."""
    joined = F.concat(a, F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))))
    return F.when(F.element_at(a, -1) == F.element_at(b, 1), joined).otherwise(F.raise_error(F.lit("the paths do not meet")).cast("array<bigint>"))


def _weight(v: Column, invert: bool) -> Column:
    """1e12 for values up to 1e-9; else the value or its inverse."""
    return F.when(v <= 1e-9, F.lit(1e12)).otherwise(1 / v if invert else v)


def weighted(edges: DataFrame, weight: str, directed: bool = True, invert: bool = False, reduce: str = "min", default: float = 1.0) -> DataFrame:
    """One ``w`` per (u, v): default for null, 1e12 at v <= 1e-9, else v or 1/v if inverted; parallel edges reduced by min, max, sum or mean."""
    e = edges.select("u", "v", _weight(F.coalesce(F.col(weight).cast("double"), F.lit(default)), invert).alias("w"))
    if not directed:
        e = e.union(e.where("u <> v").select("v", "u", "w"))
    return e.groupBy("u", "v").agg({"min": F.min, "max": F.max, "sum": F.sum, "mean": F.avg}[reduce]("w").alias("w"))


def node_weighted(edges: DataFrame, nodes: DataFrame, attr: str, aggregator: str = "to", directed: bool = True, invert: bool = False, default: float = 1.0) -> DataFrame:
    """One ``w`` per (u, v) from an attribute of the nodes: that of v (to), of u (from), or their sum, mean, min or max.

    Nodes without the attribute have ``default``. Undirected edges count both ways, each with its own to and from. Parallel edges
    add up for sum, keep the largest for max and else the smallest.
    """
    value = nodes.select("id", F.col(attr).cast("double").alias("x"))
    e = edges.select("u", "v")
    if not directed:
        e = e.union(e.where("u <> v").select("v", "u"))
    e = e.join(value.toDF("u", "xu"), "u", "left").join(value.toDF("v", "xv"), "v", "left")
    a, b = F.coalesce("xu", F.lit(default)), F.coalesce("xv", F.lit(default))
    w = {"to": b, "from": a, "sum": a + b, "mean": (a + b) * 0.5, "min": F.least(a, b), "max": F.greatest(a, b)}[aggregator]
    return e.select("u", "v", _weight(w, invert).alias("w")).groupBy("u", "v").agg({"sum": F.sum, "max": F.max}.get(aggregator, F.min)("w").alias("w"))


def shortest_paths(edges: DataFrame, source, max_cost: float = 1e11, max_rounds: int = 1000) -> DataFrame:
    """Cost and predecessor of every node that the source reaches: ``id, cost, prev``.

    Each round relaxes the edges of the nodes that got cheaper in the last one; negative cycles raise.
    """
    spark = edges.sparkSession
    kind = edges.schema["u"].dataType.simpleString()
    best = materialize(spark.range(1).select(F.lit(source).cast(kind).alias("id"), F.lit(0.0).alias("cost"), F.lit(None).cast(kind).alias("prev"), F.lit(True).alias("fresh")), "paths")
    for _ in range(max_rounds):
        step = best.where("fresh").join(edges, F.col("id") == F.col("u")).select(F.col("v").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.col("u").alias("prev")).where(F.col("cost") < max_cost)
        all_ = best.select("id", "cost", "prev", F.lit(0).alias("age")).unionByName(step.withColumn("age", F.lit(1)))
        nxt = materialize(all_.groupBy("id").agg(F.min(F.struct("cost", "age", "prev")).alias("m")).select("id", "m.cost", "m.prev", (F.col("m.age") == 1).alias("fresh")), "paths")
        discard(best)
        best = nxt
        if best.where("fresh").isEmpty():
            return best.select("id", "cost", "prev")
    raise RuntimeError("no fixed point: a negative cycle, or more rounds are needed")


def bfs_levels(edges: DataFrame, source) -> DataFrame:
    """``id, level`` by hops."""
    return bfs(edges, source).select("id", "level")


def bfs(edges: DataFrame, source) -> DataFrame:
    """``id, level, prev``: hops from the source, and the smallest node of the level before that leads there."""
    d = shortest_paths(edges.select("u", "v", F.lit(1.0).alias("w")).distinct(), source)
    return d.select("id", F.col("cost").cast("int").alias("level"), "prev")


def dfs_order(edges: DataFrame, source, max_edges: int = 1_000_000) -> DataFrame:
    """``id, step, prev`` in depth-first order, smaller neighbours first.

    The order is sequential by nature: the edges reach the driver, and more than ``max_edges`` raise an error.
    """
    e = edges.select("u", "v").distinct()
    rows = e.limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"depth-first order is for graphs of up to {max_edges} edges")
    out: dict = {}
    for u, v in rows:
        out.setdefault(u, []).append(v)
    seen, stack = {}, [(source, None)]
    while stack:
        at, prev = stack.pop()
        if at not in seen:
            seen[at] = (len(seen), prev)
            stack += [(v, at) for v in sorted(out.get(at, ()), reverse=True) if v not in seen]
    kind = edges.schema["u"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(k, step, prev) for k, (step, prev) in seen.items()], f"id {kind}, step int, prev {kind}")


def simple_paths(edges: DataFrame, start, end, max_hops: int = 10) -> DataFrame:
    """All simple paths: ``path, cost``."""
    kind = edges.schema["u"].dataType.simpleString()
    out, front = None, edges.sparkSession.range(1).select(F.array(F.lit(start).cast(kind)).alias("path"), F.lit(0.0).alias("cost"))
    for _ in range(max_hops):
        front = front.join(edges, F.element_at("path", -1) == F.col("u")).where(~F.array_contains("path", F.col("v"))).select(F.array_append("path", F.col("v")).alias("path"), (F.col("cost") + F.col("w")).alias("cost"))
        front = materialize(front, "simple-paths")
        done = front.where(F.element_at("path", -1) == F.lit(end))
        out = done if out is None else out.unionByName(done)
        front = front.where(F.element_at("path", -1) != F.lit(end))
        if front.isEmpty():
            break
    return out


def clusters(edges: DataFrame) -> DataFrame:
    """Weakly connected components: ``node, component`` (smallest member)."""
    return connected_components(edges)


def otsu(values: DataFrame, col: str = "value", bins: int = 256) -> DataFrame:
    """Otsu's threshold of values in [0, 1], one row ``threshold``; only the histogram is windowed."""
    h = values.select(F.least(F.floor(F.col(col) * bins), F.lit(bins - 1)).cast("int").alias("b")).where("b between 0 and 255").groupBy("b").agg(F.count("*").cast("double").alias("n"))
    one = h.agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("h")).select(F.posexplode("h").alias("i", "x")).select(F.col("x.b").alias("b"), F.col("x.n").alias("n"))
    up, whole = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    d = one.select("b", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("b")).over(up).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("b")).over(whole).alias("s"))
    w1 = F.col("n") - F.col("w0")
    var = F.when(w1 > 0, F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1, 2)).otherwise(F.lit(-1.0))
    return d.select("b", F.round(var, 3).alias("var")).agg(F.max_by("b", F.struct("var", -F.col("b"))).alias("b")).select(((F.col("b") + 1) / bins).alias("threshold"))


def set_cover(sets: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Greedy set cover over ``set_id, element``: chosen ``set_id, gain`` in order; ties go to the smaller id."""
    left, picked = materialize(sets.select("set_id", "element").distinct(), "cover"), []
    for _ in range(max_rounds):
        top = left.groupBy("set_id").count().orderBy(F.desc("count"), "set_id").first()
        if top is None:
            break
        picked.append((top[0], top[1], len(picked)))
        nxt = materialize(left.join(left.where(F.col("set_id") == F.lit(top[0])).select("element"), "element", "left_anti").select("set_id", "element"), "cover")
        discard(left)
        left = nxt
    return sets.sparkSession.createDataFrame(picked, f"set_id {sets.schema['set_id'].dataType.simpleString()}, gain long, step long")
