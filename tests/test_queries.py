"""Every registered query against its DuckDB twin, on the small tables, where they are there."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = sorted(entry.plans.registered())


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def test_every_query_has_sql():
    assert set(OWN) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    same(spark, db, name, SF)


def test_permutation_errors_of_a_symbol_of_one_block(spark, tmp_path):
    """Larger tables have an order in each of the first weeks: the symbol that is cut there has just a block of bars."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    db, file = duckdb.connect(), str(tmp_path / "orders.parquet")
    db.execute(
        f"copy (select * from '{SF}/orders.parquet' union all by name select 900000 + k as o_orderkey, '3-MEDIUM' as o_orderpriority, 100.25 + k as "
        f"o_totalprice, timestamp '1994-12-28' + to_days((7 * k)::int) as o_orderdate from range(5) t(k)) to '{file}' (format parquet)"
    )
    db.execute(f"create view orders as select * from '{file}'")
    got = same(spark, db, "permutation_errors", str(tmp_path)).set_index("symbol")
    assert got.permutation_error["3-MEDIUM"] is None and got.permutation_error["1-URGENT"] == "price_unusable"


def same(spark, db, name, sf):
    got = entry.queries()[name](spark, sf).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    order = [c for c in cols if got[c].dtype != float] or cols
    a, b = (d[cols].sort_values(order + [c for c in cols if c not in order]).reset_index(drop=True) for d in (got, want))
    for c in cols:
        if a[c].dtype == float:
            close = (a[c] - b[c].astype(float)).abs() <= 1e-5 * b[c].astype(float).abs().clip(lower=1)
            assert (close | a[c].isna()).all() and (a[c].isna() == b[c].isna()).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).where(~(a[c].isna() & b[c].isna()), True).all(), c
    return got


def test_entry(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).count() == 5
