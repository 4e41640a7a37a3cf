"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import duckdb
import pytest

from pathgrade.plans import catalog, extras, integrity  # noqa: F401  these add to the catalog
from tests.session import local_session
from tools.compare import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(db, name):
    said = compare(local_session("4"), db, SF, name)
    assert said.startswith(("equal", "rows")), said


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())
