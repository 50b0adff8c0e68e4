import pytest
from pyspark.sql import functions as F

from strandframe.functions import sequences as S
from strandframe.operators import features as FT
from strandframe.operators import motifs as M
from strandframe.sources import generators as R


def test_conversions(spark):
    one = spark.range(1)
    run = lambda t, a, b: one.select(S.convert(F.lit(t), a, b).alias("x")).first().x
    assert run("GATTACA", "DNA", "RNA") == "GAUUACA" and run("GAUUACA", "RNA", "DNA") == "GATTACA"
    assert run("ACDEFGHIKLMNPQRSTVWY", "AMINO", "MURPHY_10") == "ACEEFGHLKLLEPEKSSLFF" and run("LCAGSPFEKH", "MURPHY_10", "AMINO") == "LCAGSPFEKH"
    with pytest.raises(Exception, match="not all symbols"):
        run("GATUACA", "DNA", "RNA")
    with pytest.raises(ValueError):
        run("A", "DNA", "AMINO")


def test_detection_prefers_the_first_of_equals(spark):
    d = spark.createDataFrame([("ACGT",), ("MVL",), ("LCAGSPFEKH",), ("",), ("acgu",)], "t string")
    assert [r.a for r in d.select(S.detect(F.col("t")).alias("a")).collect()] == ["DNA", "AMINO", "AMINO", "DNA", "RNA"]


def test_qualifiers(spark):
    q = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", "1"), ("b", "2"), ("a", "3"))))
    pairs = lambda c: F.transform(c, lambda x: F.concat(x.key, x.value))
    r = spark.range(1).select(q.alias("q")).select(
        FT.qualifier_values(F.col("q"), "a").alias("get"), pairs(FT.set_qualifier(F.col("q"), "a", F.lit("9"))).alias("set"),
        pairs(FT.set_qualifier(F.col("q"), "c", F.lit("9"))).alias("new"), FT.qualifier_map(F.col("q")).alias("map"),
    ).first()
    assert (r.get, r.set, r.new, r.map) == (["1", "3"], ["a9", "b2", "a3"], ["a1", "b2", "a3", "c9"], {"a": "3", "b": "2"})


def test_concat_keeps_ids(spark):
    s = spark.createDataFrame([("g", 0, "x", "AAAA"), ("g", 1, "y", "CCC")], "grp string, part int, seq_id string, seq string")
    f = spark.createDataFrame([("x", 2, 4, 1, "gene", 10), ("y", 0, 2, 1, "gene", 11), ("y", 1, 3, -1, "CDS", 12)], "seq_id string, start long, end long, strand int, key string, feature_id long")
    out, feats = FT.concat_records(s, f)
    assert out.first().seq == "AAAACCC"
    assert sorted((r.start, r.end, r.key, r.feature_id) for r in feats.collect()) == [(2, 6, "gene", 10), (5, 7, "CDS", 12)]


def test_records_are_edited_with_their_features(spark):
    s = spark.createDataFrame([(1, "GATTACA")], "seq_id long, seq string")
    f = spark.createDataFrame([(1, 7, 2, 6, 1, "CDS")], "seq_id long, feature_id long, start int, end int, strand int, key string")
    row = lambda parts: (parts[0].first().seq, *[(r.start, r.end, r.strand) for r in parts[1].collect()])
    assert row(FT.slice_records(s, f, 1, 4)) == ("ATT", (1, 3, 1))
    assert row(FT.delete_from_records(s, f, 1, 4)) == ("GACA", (1, 3, 1))
    assert row(FT.reverse_complement_records(s, f)) == ("TGTAATC", (1, 5, -1))


def test_hits_become_features(spark):
    box = M.sigma70()[0]
    s = spark.createDataFrame([(1, "CCTTGACACC"), (2, "GGTGTCAAGG"), (3, "AA")], "seq_id long, seq string")
    got = M.hits_to_features(M.scan(s, M.sigma70(), 6.0), M.sigma70()).collect()
    assert {(r.seq_id, r.start, r.end, r.strand, r.key) for r in got} == {(1, 2, 8, 1, box.name), (2, 2, 8, -1, box.name)}


def test_generators_repeat_and_follow_weights(spark):
    a = R.sequences(spark, 300, (5, 40), 3, weights=[0, 1, 1, 2])
    text = "".join(r.seq for r in a.collect())
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, R.sequences(spark, 300, (5, 40), 3, weights=[0, 1, 1, 2]).repartition(3).collect()))
    assert "T" not in text and abs(text.count("G") / len(text) - 0.5) < 0.05 and {len(r.seq) for r in a.collect()} <= set(range(5, 41))
    assert R.sequences(spark, 2, 0).collect()[0].seq == ""
    rows = R.intervals(spark, 500, 4, 1000, (1, 50), 2).collect()
    assert all(0 <= r.start < r.end <= 1000 and r.strand in (1, -1) and 0 <= r.contig < 4 for r in rows)
    assert {r.key for r in R.features(spark, 50, 2, 100).collect()} == {"CDS", "gene"}
    with pytest.raises(ValueError):
        R.sequences(spark, 1, 1, weights=[1])
