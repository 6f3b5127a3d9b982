"""Every registered query outside the text subpackage against its SQL twin, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from murmuration.plans.catalog import FLAGSHIP, ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events"

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_and_twin(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    got = table(df.columns, df.collect())
    if name in ORACLES:
        twin = duck.sql(ORACLES[name])
        assert got == table(twin.columns, twin.fetchall())


def test_entry_and_optional_parts(spark):
    import __spark_entry__ as entry

    assert FLAGSHIP in QUERIES and entry.entry(spark).columns == ["tick", "total", "min", "max"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
