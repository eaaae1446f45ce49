"""Every query against DuckDB on the same tables, by its whole rows."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest
from kithgraph.plans.every import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def _rows(found) -> list:
    return sorted((tuple(_plain(x) for x in r) for r in found), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = _rows(df.select(*names).collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    found = con.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == names
    assert rows == _rows(found.project(", ".join(f'"{c}"' for c in names)).fetchall())


def test_entry_names_every_query():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
