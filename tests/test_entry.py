import __spark_entry__ as e


def test_entry_runs(spark):
    df = e.entry(spark)
    assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())
