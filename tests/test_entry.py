import __spark_entry__ as entry


def test_names_match(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and "flagship_overlap_coverage" in q


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
