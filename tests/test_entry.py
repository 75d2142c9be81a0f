import __spark_entry__ as entry


def test_registry_is_complete():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 100


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
