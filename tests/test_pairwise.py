import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import packing as P
from strandframe.operators import features as FT
from strandframe.operators import pairwise as W
from strandframe.streaming import windows


def brute(q, t, mode, o=5, e=2):
    """Plain three-state recursion."""
    low, n, m = -(10**9), len(q), len(t)
    h = [[low] * (m + 1) for _ in range(n + 1)]
    d, i_ = [r[:] for r in h], [r[:] for r in h]
    for i in range(n + 1):
        for j in range(m + 1):
            if (i, j) == (0, 0) or mode == "local" or (mode == "glocal" and i == 0):
                h[i][j] = 0
            if j:
                d[i][j] = max(h[i][j - 1] - o, d[i][j - 1] - e)
            if i:
                i_[i][j] = max(h[i - 1][j] - o, i_[i - 1][j] - e)
            both = h[i - 1][j - 1] + (1 if q[i - 1] == t[j - 1] else -1) if i and j else low
            if not (mode == "glocal" and i == 0):
                h[i][j] = max(h[i][j], both, d[i][j], i_[i][j])
    return {"local": max(map(max, h)), "global": h[n][m], "glocal": max(h[n])}[mode]


def scored(r, q, t, o=5, e=2):
    """Score of the cigar at its coordinates."""
    import re

    _, i, q1, j, t1, matches, n, cigar = r
    total, ops, same = 0, 0, 0
    for k, op in re.findall(r"(\d+)([MID])", cigar):
        k = int(k)
        ops += k
        if op == "M":
            eq = sum(a == b for a, b in zip(q[i : i + k], t[j : j + k], strict=True))
            total, same, i, j = total + 2 * eq - k, same + eq, i + k, j + k
        else:
            total -= o + (k - 1) * e
            i, j = (i + k, j) if op == "I" else (i, j + k)
    assert (i, j, ops, same) == (q1, t1, n, matches)
    return total


@pytest.mark.parametrize("mode", ["local", "global", "glocal"])
def test_alignment_against_plain_recursion(mode):
    rng = random.Random(5)
    for k in range(150):
        q, t = ("".join(rng.choice("ACGT"[: 2 + k % 3]) for _ in range(rng.randint(0, 14))) for _ in range(2))
        if k % 3 == 0:
            t = t[:5] + q + t[5:]
        r = W.align_pair(q, t, mode)
        assert r[0] == brute(q, t, mode) == scored(r, q, t), (q, t, r)
        if mode != "local":
            assert (r[1], r[2]) == (0, len(q))
        if mode == "global":
            assert (r[3], r[4]) == (0, len(t))


def test_map_finds_both_strands(spark):
    rng = random.Random(2)
    t = "".join(rng.choice("ACGT") for _ in range(600))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    q = spark.createDataFrame([("f", t[100:300]), ("r", rc(t[350:500])), ("x", "".join(rng.choice("ACGT") for _ in range(150))), ("e", "")], "seq_id string, seq string")
    got = W.map_sequences(q, spark.createDataFrame([("t", t)], "seq_id string, seq string"), min_score=50).collect()
    assert sorted((r["query"], r.strand, r.t_start, r.t_end, r.cigar) for r in got) == [("f", 1, 100, 300, "200M"), ("r", -1, 350, 500, "150M")]


def test_align_keeps_columns_and_takes_nulls(spark):
    d = spark.createDataFrame([(1, "ACG", "ACG"), (2, None, "AC"), (3, "", "")], "id long, q_seq string, t_seq string")
    assert {r.id: (r.score, r.cigar) for r in W.align(d, "global").collect()} == {1: (3.0, "3M"), 2: (-7.0, "2D"), 3: (0.0, "")}


def test_content_id_and_packing(spark):
    rows = [("ACGTTGCA" * 3 + "A",), ("",), (None,), ("T",)]
    d = spark.createDataFrame(rows, "s string").select("s", P.content_id(F.col("s")).alias("id"), P.pack(F.col("s")).alias("p"))
    d = d.withColumn("back", P.unpack(F.col("p"), F.length("s")))
    for r in d.collect():
        assert r.back == r.s
        if r.s is not None:
            assert len(r.p) == -(-len(r.s) // 4) and r.id == hashlib.blake2b(bytes("TCAG".index(c) for c in r.s), digest_size=8).hexdigest()
    a = spark.createDataFrame([("MVLW",)], "s string").select(P.unpack(P.pack(F.col("s"), "AMINO"), F.lit(4), "AMINO").alias("b")).first()
    assert a.b == "MVLW" and P.kmer_parameters("DNA", 15) == {"bits": 2, "mask": (1 << 30) - 1, "width": 32}


SEQS, FEATS = "seq_id string, seq string", "seq_id string, feature_id long, start long, end long, strand int, key string"


def test_record_edits(spark):
    s = spark.createDataFrame([("a", "ACGTACGT")], SEQS)
    f = spark.createDataFrame([("a", 1, 0, 2, 1, "g"), ("a", 2, 1, 6, 1, "h"), ("a", 3, 5, 8, -1, "k")], FEATS)
    s2, f2 = FT.insert_sequence(s, f, 3, "TT")
    assert s2.first().seq == "ACGTTTACGT" and {r.feature_id: (r.start, r.end) for r in f2.collect()} == {1: (0, 2), 2: (1, 8), 3: (7, 10)}
    s3, f3 = FT.insert_sequence(s, f, 0, "", 2)
    assert s3.first().seq == "GTACGT" and {r.feature_id: (r.start, r.end) for r in f3.collect()} == {2: (0, 4), 3: (3, 6)}
    p, g = FT.shred(s, f, spark.createDataFrame([("a", 4), ("a", 99)], "seq_id string, at int"))
    assert sorted((r.piece, r.seq) for r in p.collect()) == [(0, "ACGT"), (1, "ACGT")]
    assert sorted((r.piece, r.feature_id, r.start, r.end) for r in g.collect()) == [(0, 1, 0, 2), (0, 2, 1, 4), (1, 2, 0, 2), (1, 3, 1, 4)]


def test_concat_fuses_at_the_boundary(spark):
    s = spark.createDataFrame([("x", 0, "a", "ACGT"), ("x", 1, "b", "GG")], "grp string, part int, seq_id string, seq string")
    f = spark.createDataFrame([("a", 1, 1, 4, 1, "g"), ("b", 2, 0, 1, 1, "g"), ("b", 3, 0, 2, -1, "g")], FEATS)
    out, g = FT.concat_records(s, f)
    assert out.first().seq == "ACGTGG" and sorted((r.strand, r.start, r.end) for r in g.collect()) == [(-1, 4, 6), (1, 1, 5)]


def test_pivot(spark):
    s = spark.createDataFrame([("a", "ACGT")], SEQS)
    f = spark.createDataFrame([(1, [("source", "a")]), (2, [("source", "z")]), (3, [])], "feature_id long, qualifiers array<struct<key:string,value:string>>")
    assert [(r.feature_id, r.seq_id) for r in FT.pivot_features(s, f).collect()] == [(1, "a")]


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    (tmp_path / "in").mkdir()
    batch.write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.read_events(spark, str(tmp_path / "in"), batch.schema))
    windows.run_once(stream, tmp_path.name, str(tmp_path / "out"))
    key = lambda d: {(r.window_start, r.event_type): r.n for r in d.collect()}
    got, want = key(spark.read.parquet(str(tmp_path / "out"))), key(windows.tumbling(batch))
    assert got and all(want[k] == n for k, n in got.items())
