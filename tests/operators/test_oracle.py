"""Every library query against its SQL, value for value; those without SQL must run and have unique columns."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from quire.plans import catalog

DIR = os.environ.get("QUIRE_TEST_DIR", "/root/testdata/sf0.001")
TABLES = [p.stem for p in Path(DIR).glob("*.parquet")]


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, DIR)
    assert len(set(df.columns)) == len(df.columns)
    got = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    assert norm(got, df.columns) == norm(rel.fetchall(), rel.columns)
