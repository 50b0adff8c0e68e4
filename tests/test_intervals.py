import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import intervals as I

SCHEMA = "contig string, row_id long, start long, end long, strand int"


def frame(spark, rows, contig="c"):
    return spark.createDataFrame([(contig, k, s, e, t) for k, (s, e, t) in enumerate(rows)], SCHEMA)


def test_nested_intervals_intersect_once(spark):
    j = I.overlap_join(frame(spark, [(50, 60, 1)]), frame(spark, [(0, 100, 1), (5, 10, 1)])).collect()
    assert [(r.start, r.end) for r in j] == [(50, 60)]


def test_adjacent_merge_and_strand_conflict(spark):
    m = I.merge(frame(spark, [(0, 5, 1), (5, 9, -1), (20, 21, 1)])).orderBy("start").collect()
    assert [(r.start, r.end, r.strand, r.n) for r in m] == [(0, 9, 0, 2), (20, 21, 1, 1)]
    assert I.coverage(frame(spark, [(0, 5, 1), (5, 9, 1)])).first().bases == 9


def test_complement(spark):
    lengths = spark.createDataFrame([("c", 6)], "contig string, length long")
    assert [(r.start, r.end) for r in I.complement(frame(spark, [(2, 4, 1)]), lengths).orderBy("start").collect()] == [(0, 2), (4, 6)]
    assert [(r.start, r.end) for r in I.complement(frame(spark, []), lengths).collect()] == [(0, 6)]


@pytest.mark.parametrize("width", [1, 7, 64])
def test_overlap_and_subtract_against_brute_force(spark, width):
    rng = random.Random(width)
    a = [(s, s + rng.randint(1, 40), rng.choice((1, -1))) for s in (rng.randint(0, 300) for _ in range(60))]
    b = [(s, s + rng.randint(1, 20), rng.choice((1, -1))) for s in (rng.randint(0, 300) for _ in range(30))]
    got = {(r.a_id, r.b_id, r.start, r.end) for r in I.overlap_join(frame(spark, a), frame(spark, b), width=width).collect()}
    assert got == {(i, j, max(x[0], y[0]), min(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] < y[1] and y[0] < x[1]}
    taken = {p for s, e, _ in b for p in range(s, e)}
    pieces = {}
    for r in I.subtract(frame(spark, a), frame(spark, b)).collect():
        pieces.setdefault(r.row_id, set()).update(range(r.start, r.end))
    assert pieces == {i: left for i, (s, e, _) in enumerate(a) if (left := set(range(s, e)) - taken)}


def test_merge_is_idempotent_and_tiles_stay_inside(spark):
    x = frame(spark, [(k * 3 % 50, k * 3 % 50 + 4, 1) for k in range(30)])
    m = I.merge(x).drop("n").withColumn("row_id", F.monotonically_increasing_id())
    assert sorted(map(tuple, I.merge(m).drop("n").collect())) == sorted(map(tuple, m.drop("row_id").collect()))
    for span in (1, 7, 20):
        for tolerance in (0, 1):
            assert sorted(map(tuple, I.merge(x, tolerance, span=span).collect())) == sorted(map(tuple, I.merge(x, tolerance).collect()))
    sparse = frame(spark, [(0, 100, 1), (3, 5, -1), (90, 95, 1), (101, 102, 1), (130, 131, 1), (131, 140, 1)])
    for span in (1, 10, 64):
        assert sorted((r.start, r.end, r.strand, r.n) for r in I.merge(sparse, span=span).collect()) == [(0, 100, 0, 3), (101, 102, 1, 1), (130, 140, 1, 2)]
    assert I.tile(frame(spark, [(0, 9, 1)]), 10, 5).count() == 0
    assert [r.start for r in I.tile(frame(spark, [(0, 20, 1)]), 10, 5).orderBy("start").collect()] == [0, 5, 10]


def test_cover_linear_keeps_a_chain(spark):
    kept = I.cover_linear(frame(spark, [(0, 10, 1), (5, 15, 1), (10, 20, 1), (19, 40, 1)]), 0.1).orderBy("start").collect()
    assert [(r.start, r.end) for r in kept] == [(0, 10), (10, 20), (19, 40)]
    lengths = spark.createDataFrame([("c", 100)], "contig string, length long")
    x = frame(spark, [(0, 10, 1), (9, 20, 1)])
    assert I.cover_linear(x, lengths=lengths, min_coverage=0.2).count() == 2 and I.cover_linear(x, lengths=lengths, min_coverage=0.21).count() == 0


def test_overlaps_of_all_lengths(spark):
    """Intervals of lengths over many levels of bins, against all pairs."""
    import random

    rng = random.Random(4)
    a, b = ([(s, s + int(2 ** rng.uniform(0, 22)), 1) for s in (rng.randint(0, 1 << 20) for _ in range(60))] for _ in range(2))
    got = [(r.a_id, r.b_id, r.start, r.end) for r in I.overlap_join(frame(spark, a), frame(spark, b)).collect()]
    want = [(i, j, max(x[0], y[0]), min(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] < y[1] and y[0] < x[1]]
    assert sorted(got) == sorted(want)
    assert I.overlap_join(frame(spark, a).limit(0), frame(spark, b).limit(0)).count() == 0
