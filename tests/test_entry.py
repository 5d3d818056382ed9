import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"edge_resolution_counters", "comm_metrics", "galaxy_catalog", "tile_roundtrip"} <= set(queries)
