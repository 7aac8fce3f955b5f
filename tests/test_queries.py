"""Every registered raster and array query against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gridloom import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return c


def plain(rows):
    return sorted(tuple("null" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    got = catalog.queries()[name](spark, DATA)
    want = db.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_stack_holds_all_event_types(spark, tmp_path):
    kinds = ["a", "b", "c", "d", "e", "f", "g", None]
    rows = [(k, f"2024-01-04 0{k % 8}:00:00", kinds[k % 8], float(k)) for k in range(16)]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: {tuple(r)[:-1]: r.v for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    t = run("arr_transpose")
    assert len(t) == 31 * 24 * 7 and {at: v for at, v in t.items() if v is not None} == {(k, 3, k): 8.0 + k for k in range(7)}
    assert run("arr_max_over")[(3, 6)] == 14.0 and run("arr_min_over") == {(k,): 8.0 + k for k in range(7)}
    assert sum(v for v in run("arr_reshape").values() if v is not None) == sum(8.0 + k for k in range(7))
    assert run("arr_broadcast_to")[(1, 6, 6)] == 14.0 and run("arr_sum_over")[(3,)] == sum(8.0 + k for k in range(7))
