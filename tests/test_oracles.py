"""Every registered query of the markets part against its DuckDB oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pmspark import registry


@pytest.fixture(scope="session")
def tables(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows):
    def cell(x):
        if x is None or x != x:
            return "null"
        return repr(round(float(x), 8)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, small, tables, name):
    got = registry.queries()[name](spark, small)
    columns = sorted(got.columns)
    result = tables.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in result.fetchall()]
    assert canonical(tuple(r) for r in got.select(*columns).collect()) == canonical(want)
