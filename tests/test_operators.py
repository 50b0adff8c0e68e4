import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandframe.operators import alignments as A
from strandframe.operators import graph as G
from strandframe.operators import motifs as M
from strandframe.operators import sketch as K
from strandframe.operators import variation as V
from strandframe.operators.components import connected_components


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    parent = list(range(141))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_cigar_and_variants(spark):
    d = spark.createDataFrame([(1, "c", 0, 0, 1, "3=1X2I4D2M", "ACGTTTAC", "ACGAGGGGAA"), (2, "c", 0, 0, 1, None, "A", "C")], "row_id long, contig string, t_start int, q_start int, strand int, cigar string, q_seq string, t_seq string")
    v = lambda **k: sorted(map(tuple, V.variants(d, **k).select("start", "end", "ref", "alt").collect()))
    assert v() == [(3, 4, "A", "T"), (4, 4, "", "TT"), (4, 8, "GGGG", "")]
    assert v(compare_m=True) == [(3, 4, "A", "T"), (4, 4, "", "TT"), (4, 8, "GGGG", ""), (9, 10, "A", "C")]


def test_pileup_against_counts(spark):
    """Depth and alleles, deletions and the reverse strand included, over a target of several pieces."""
    rng = random.Random(8)
    target = "".join(rng.choice("TCAG") for _ in range(V.PIECE + 50))
    rows, count = [], {}
    for k in range(60):
        at, strand, seq = V.PIECE - 10 + rng.randint(0, 8), rng.choice((1, -1)), "".join(rng.choice("TCAG") for _ in range(20))
        rows.append((k, "c", at, 1, strand, "4M2D3=1I2X2N2S", seq))
        q, t = 1, at
        for n, op in ((4, "M"), (2, "D"), (3, "="), (1, "I"), (2, "X"), (2, "N")):
            for i in range(n):
                if op in "M=X":
                    b = seq[q + i] if strand > 0 else seq[q + i].translate(str.maketrans("TCAG", "AGTC"))
                elif op in "DN":
                    b = ""
                else:
                    continue
                count.setdefault(t + i, {}).setdefault(b, 0)
                count[t + i][b] += 1
            q += n if op in "M=XI" else 0
            t += n if op in "M=XDN" else 0
    d = spark.createDataFrame(rows, "row_id long, contig string, t_start int, q_start int, strand int, cigar string, q_seq string")
    got = V.call_pileup(d, spark.createDataFrame([("c", target)], "contig string, seq string"), 10, 0.2).collect()
    want = {(t, target[t], b, n, sum(c.values())) for t, c in count.items() if sum(c.values()) >= 10 for b, n in c.items() if b != target[t] and n / sum(c.values()) >= 0.2}
    assert {(r.start, r.ref, r.alt, r.n, r.depth) for r in got} == want and want


def test_cull_rule_holds(spark):
    rng = random.Random(3)
    rows = [(k, "q", "t", float(rng.randint(0, 9)), s, s + rng.randint(1, 30), rng.randint(5, 40)) for k, s in enumerate(rng.randint(0, 200) for _ in range(50))]
    kept = A.cull_overlaps(spark.createDataFrame(rows, "row_id long, query string, target string, score double, t_start int, t_end int, aln_len int"), 0.2).collect()
    want = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(min(r[5], k[5]) - max(r[4], k[4]) <= 0.2 * r[6] for k in want):
            want.append(r)
    assert sorted(map(tuple, kept)) == sorted(want)


def test_chain_on_the_reverse_strand(spark):
    rows = [(1, "q", "t", -1, 0, 10, 10.0, 80, 90), (2, "q", "t", -1, 12, 20, 8.0, 65, 75), (3, "q", "t", -1, 25, 30, 5.0, 50, 60)]
    got = A.chain(spark.createDataFrame(rows, "row_id long, query string, target string, strand int, q_start int, q_end int, score double, t_start int, t_end int"), 100).collect()
    assert {(r.chain, r.chain_score) for r in got} == {(3, 23.0)} and len(got) == 3


def test_chains_against_all_pairs(spark):
    rng = random.Random(12)
    rows = []
    for k in range(80):
        q, t = rng.randint(0, 400), rng.randint(0, 400)
        rows.append((k, "q", "t", 1, q, q + rng.randint(1, 90), float(rng.randint(1, 9)), t, t + rng.randint(1, 90)))
    got = {r.row_id: r.chain_score for r in A.chain(spark.createDataFrame(rows, "row_id long, query string, target string, strand int, q_start int, q_end int, score double, t_start int, t_end int"), 60).collect()}
    order = sorted(rows, key=lambda r: (r[4], r[5], r[0]))
    best = {}
    for j, r in enumerate(order):
        best[r[0]] = r[6] + max([best[p[0]] for p in order[:j] if 0 <= r[4] - p[5] <= 60 and 0 <= r[7] - p[8] <= 60], default=0.0)
    assert len(got) == 80 and max(got.values()) == max(best.values())


def test_node_weights_and_order(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (1, 3), (3, 1)], "u long, v long")
    n = spark.createDataFrame([(1, 4.0), (2, 0.0)], "id long, x double")
    w = lambda **k: {(r.u, r.v): r.w for r in G.node_weighted(e, n, "x", **k).collect()}
    assert w() == {(1, 2): 1e12, (2, 3): 1.0, (1, 3): 1.0, (3, 1): 4.0}
    assert w(aggregator="sum", invert=True) == {(1, 2): 0.25, (2, 3): 1.0, (1, 3): 0.4, (3, 1): 0.2}
    assert w(aggregator="from", directed=False)[(2, 1)] == 1e12
    assert [(r.id, r.prev) for r in G.dfs_order(e, 1).orderBy("step").collect()] == [(1, None), (2, 1), (3, 2)]
    assert [(r.id, r.level, r.prev) for r in G.bfs(e, 1).orderBy("id").collect()] == [(1, 0, None), (2, 1, 1), (3, 1, 1)]
    one = spark.range(1)
    join = lambda a, b: one.select(G.join_paths(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias("p")).first().p
    assert join([1, 2], [2, 3, 4]) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="do not meet"):
        join([1, 2], [3, 4])


def test_minimizers_across_chunks(spark):
    rng = random.Random(6)
    seqs = [(k, "".join(rng.choice("TCAG") for _ in range(n))) for k, n in enumerate((0, 13, 14, 15, 40, 400))]
    d = spark.createDataFrame(seqs, "seq_id long, seq string")
    whole = sorted(map(tuple, K.minimizers(d, 6, 9).collect()))
    assert whole == sorted(map(tuple, K.minimizers(d, 6, 9, chunk=7).collect())) and len(set(whole)) == len(whole)


def test_stored_seeds(spark, tmp_path):
    d = spark.createDataFrame([(1, "GATTACAGATTACA"), (2, "TTTTTTTTTT")], "seq_id long, seq string")
    s = K.dense(d, 4)
    path = K.store_index(s, f"{tmp_path}/seeds", 4)
    got = sorted(map(tuple, K.look_up(spark, path, s, 4).collect()))
    assert got == sorted(map(tuple, K.seed_hits(s, s).collect())) == sorted(map(tuple, K.seed_hits(s, s, 1).collect()))


def test_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 3, 1.0), (3, 4, 1.0)], "u long, v long, w double")
    assert {r.id: r.cost for r in G.shortest_paths(e, 1).collect()} == {1: 0.0, 2: 1.0, 3: 2.0, 4: 3.0}
    assert sorted((tuple(r.path), r.cost) for r in G.simple_paths(e, 1, 4).collect()) == [((1, 2, 3, 4), 3.0), ((1, 3, 4), 6.0)]


def test_set_cover(spark):
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 3)], "set_id string, element int")
    assert [(r.set_id, r.gain) for r in G.set_cover(s).orderBy("step").collect()] == [("a", 2), ("b", 1)]


def test_motif_tail_against_enumeration():
    m = M.Motif.from_counts("m", [[8, 1, 1], [1, 5, 1], [1, 8, 1], [1, 1, 8]])
    scores = sorted(sum(np.rint(m.weights[s, k] * 1000) for k, s in enumerate(x)) / 1000 for x in itertools.product(range(4), repeat=3))
    for t in (scores[-1], scores[-5], scores[10]):
        assert m.pvalue(t) == pytest.approx(sum(s >= t - 1e-9 for s in scores) / 64)
    assert m.pvalue(m.threshold(0.05)) <= 0.05


def test_minimizers_by_hand(spark):
    seqs = spark.createDataFrame([(1, "TTTCAGGATTC")], "seq_id long, seq string")
    seq, k, w = "TTTCAGGATTC", 3, 4
    code = lambda x: min(x.translate(str.maketrans("TCAG", "0123")), x.translate(str.maketrans("TCAG", "2301"))[::-1])
    h = [code(seq[i : i + k]) for i in range(len(seq) - k + 1)]
    want = {min((h[j], j) for j in range(i, i + w)) for i in range(len(h) - w + 1)}
    assert {(r.hash, r.pos) for r in K.minimizers(seqs, k, w).collect()} == want


def test_sketches_in_chunks_and_pairs_in_blocks(spark, monkeypatch):
    """Neither k-mers nor the hashes that pairs share are shuffled; blocks of any size give the pairs of plain sets."""
    rng = random.Random(5)
    texts = {f"s{k}": "".join(rng.choice("TCAG") for _ in range(rng.choice((0, 3, 4, 40, 90)))) for k in range(40)}
    d = spark.createDataFrame(list(texts.items()), "seq_id string, seq string")
    code = lambda w: min(w.translate(str.maketrans("TCAG", "0123")), w[::-1].translate(str.maketrans("TCAG", "2301")))
    want = {k: sorted({code(t[i : i + 4]) for i in range(len(t) - 3)})[:8] for k, t in texts.items()}
    sketch = K.minhash(d, 4, 8, chunk=7)
    assert sorted(map(tuple, sketch.collect())) == sorted((k, h) for k, v in want.items() for h in v)
    sets = {k: set(v) for k, v in want.items() if v}
    pairs = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if x & y}
    for indexed, streamed in ((1 << 16, 1 << 18), (7, 11)):
        monkeypatch.setattr(K, "INDEXED", indexed)
        monkeypatch.setattr(K, "STREAMED", streamed)
        got = K.sketch_jaccard(sketch, sketch)
        assert "Join" not in got._jdf.queryExecution().toString()
        rows = got.collect()
        assert {(r.a_id, r.b_id): r.jaccard for r in rows} == pairs and len(rows) == len(pairs)
    other = sketch.where("seq_id < 's2'")
    assert {(r.a_id, r.b_id) for r in K.sketch_jaccard(other, sketch).collect()} == {p for p in pairs if p[0] < "s2"}
    assert K.sketch_jaccard(sketch.limit(0), sketch).count() == 0


def test_sketches_against_themselves_are_dealt_once_for_each_block(spark, monkeypatch):
    """Two blocks meet in one task, which gives both orders of their pairs: n blocks make n (n + 1) / 2 tasks and n copies of each sketch."""
    tasks = 3 * spark.sparkContext.defaultParallelism
    blocks = next(n for n in itertools.count(1) if n * (n + 1) // 2 >= tasks)
    sketch = spark.createDataFrame([(i, h) for i in range(200) for h in (i % 7, 100 + i % 11, 1000 + i)] + [(None, 1)], "seq_id long, hash long").localCheckpoint()
    sets = {i: {i % 7, 100 + i % 11, 1000 + i} for i in range(200)}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if x & y}
    rows = K.sketch_jaccard(sketch, sketch).collect()
    assert len(rows) == len(want) and {(r.a_id, r.b_id): r.jaccard for r in rows} == want
    assert K.sketch_jaccard(*[sketch.limit(0)] * 2).count() == 0

    def dealt(batches, **_):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([float(len(b))])], names=["a_id", "b_id", "jaccard"])

    monkeypatch.setattr(K, "_shared", dealt)
    assert sum(r.jaccard for r in K.sketch_jaccard(sketch, sketch).collect()) == 200 * blocks
