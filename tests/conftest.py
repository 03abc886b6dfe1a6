import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from framelore.session import local_session

    os.environ.setdefault("FRAMELORE_DRIVER_MEMORY", "4g")
    session = local_session(4, 4, "framelore-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    """The smallest test tables; tests that need them are skipped where they are missing."""
    path = os.environ.get("FRAMELORE_TEST_TABLES", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


@pytest.fixture(scope="session")
def oracle(sf):
    """DuckDB with the test tables as views."""
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(sf):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf}/{name}')")
    return con
