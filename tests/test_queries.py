"""Every query with an SQL twin against DuckDB, over the whole small tables."""

import pytest
from compare import rows_of_spark, rows_of_sql

from framelore.plans import ALL

CASES = [(p, n) for p in ALL for n in getattr(p, "ORACLES", {})]


@pytest.mark.parametrize("plan,name", CASES, ids=[n for _, n in CASES])
def test_against_sql(spark, sf, oracle, plan, name):
    assert rows_of_spark(plan.QUERIES[name](spark, sf)) == rows_of_sql(oracle, plan.ORACLES[name])


@pytest.mark.parametrize("name", ["document_polygons", "document_masks", "p4_objects", "p4_skipped", "p7_objects", "p7_tiles", "p7_found"])
def test_runs(spark, sf, name):
    query = next(p.QUERIES[name] for p in ALL if name in p.QUERIES)
    assert query(spark, sf).count() > 0
