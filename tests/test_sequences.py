import math

from pyspark.sql import functions as F

from strandframe.functions import sequences as S
from strandframe.operators.orfs import find_orfs


def one(spark, text, *exprs):
    return spark.createDataFrame([(text,)], "s string").select(*(e(F.col("s")) for e in exprs)).first()


def test_clean_and_reverse_complement(spark):
    r = one(spark, "acGTnuZ-", S.clean, lambda s: S.reverse_complement(S.reverse_complement(S.clean(s))))
    assert r[0] == r[1] == "ACGTAT"


def test_detect(spark):
    for text, want in (("ACGT", "DNA"), ("acgt", "DNA"), ("ACGU", "RNA"), ("ACDEFGH", "AMINO"), ("MVL", "AMINO"), ("", "DNA")):
        assert one(spark, text, S.detect)[0] == want


def test_entropy_gc_translate(spark):
    r = one(spark, "ATGGCCTAA", S.entropy, S.gc, S.translate, lambda s: S.translate(s, 0, True), S.is_complete_cds)
    assert math.isclose(r[0], -sum(p / 9 * math.log2(p / 9) for p in (2, 3, 2, 2)))
    assert (round(r[1], 6), r[2], r[3], r[4]) == (round(4 / 9, 6), "MA*", "MA", True)
    assert tuple(one(spark, "", S.entropy, S.gc, S.translate)) == (0.0, 0.0, "")


def test_two_starts_before_one_stop(spark):
    seq = "ATGAAAATGCCCTAA"
    d = find_orfs(spark.createDataFrame([(1, seq)], "seq_id long, seq string")).where("strand = 1")
    assert sorted((r.start, r.end) for r in d.collect()) == [(0, 15), (6, 15)]
