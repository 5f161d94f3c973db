"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from tidewell.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_oracle(name, spark, duck, sf):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()])


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
