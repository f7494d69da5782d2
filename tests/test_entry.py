import datetime as dt

import duckdb
import pandas as pd
import pytest

from tallyproof import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return ""
        if isinstance(v, float) or getattr(getattr(v, "dtype", None), "kind", "-") in "iuf":
            return f"{float(v):.9g}"
        return f"{v:.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, db, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = db.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_window_stream(spark, tmp_path):
    from tallyproof.streaming.ingest import run_windows, windowed_counts

    events = spark.read.parquet(f"{DATA}/events.parquet")
    run_windows(spark, f"{DATA}/events.parque[t]", events.schema, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["window"]["start"], r["event_type"]): r["n"] for r in windowed_counts(events).collect()}
    # what the watermark, two hours behind the last event, has passed is there, and nothing else
    last = events.agg({"ts": "max"}).first()[0]
    done = {k: n for k, n in want.items() if k[0] + dt.timedelta(hours=1) <= last - dt.timedelta(hours=2)}
    assert done and got == done


def test_late_events(spark, tmp_path):
    """Three files in turn: an event within the watermark counts, one behind it doesn't."""
    from tallyproof.streaming.ingest import run_windows

    at = lambda h, m=0: dt.datetime(2024, 5, 1, h, m)
    schema = "event_id long, ts timestamp, event_type string, value double"
    batches = [[(1, at(1, 10), "a", 1.0), (2, at(4), "a", 1.0)], [(3, at(3, 5), "a", 1.0), (4, at(1, 20), "a", 1.0)], [(5, at(9), "a", 1.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_windows(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = {r["start"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {at(1): 1, at(3): 1, at(4): 1}
