"""The driver contract."""

import __spark_entry__ as contract


def test_names_and_twins():
    queries, twins = contract.queries(), contract.oracle_sql()
    assert set(twins) <= set(queries) and all(callable(f) for f in queries.values())
    assert {"p4_found", "p6_found", "p7_found"} <= set(queries)


def test_flagship(spark):
    import os

    if os.path.isdir("/root/testdata/sf0.001"):
        df = contract.entry(spark)
        assert df.columns == ["entity_id", "kind", "start_at", "end_at"] and df.count() > 0
