"""Every registered query against its independent DuckDB statement on the
smallest test tables (the driver does the same at sf0.01)."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry
from marginlens.plans import registry

RAW = "region nation customer supplier part orders lineitem events".split()
ORACLE = entry.oracle_sql()
QUERIES = entry.queries()
OWN = sorted([s.name for s in registry.SPECS] + list(registry.OF_SOURCE))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in RAW:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return c


def _norm(v):
    return ("n", "") if v is None else ("f", v) if isinstance(v, float) else ("v", str(v))


def _close(a, b):
    if a[0] == b[0] == "f":
        return a[1] == b[1] or abs(a[1] - b[1]) <= 1e-9 * max(1.0, abs(a[1]), abs(b[1])) or (math.isnan(a[1]) and math.isnan(b[1]))
    return a == b


def test_every_query_is_registered_with_oracle_or_exempt():
    own = {s.name for s in registry.SPECS}
    assert own <= set(QUERIES) and own <= set(ORACLE)
    assert set(ORACLE) <= set(QUERIES)
    assert len(own) == 46


@pytest.mark.parametrize("name", OWN)
def test_query_matches_oracle(spark, con, name):
    s_tab = QUERIES[name](spark, SF_SMALL).toArrow()
    d_tab = con.sql(ORACLE[name]).to_arrow_table()
    cols = sorted(s_tab.column_names)
    assert cols == sorted(d_tab.column_names)
    for c in cols:
        assert str(s_tab.schema.field(c).type) == str(d_tab.schema.field(c).type), c
    assert s_tab.num_rows == d_tab.num_rows
    srows = sorted(tuple(_norm(r[c]) for c in cols) for r in s_tab.to_pylist())
    drows = sorted(tuple(_norm(r[c]) for c in cols) for r in d_tab.to_pylist())
    for a, b in zip(srows, drows):
        assert all(_close(x, y) for x, y in zip(a, b)), (a, b)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "contribution_margin" in df.columns
