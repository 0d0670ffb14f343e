"""The driver contract, with a sample of queries held against DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("dq_daily_scores", "pa1_unallocated", "pa11_column_names", "pf5_missing_indicators", "ag5_trust_score", "wn4_pct_changes", "wn16_measurements_last_nd", "jn8_as_of", "ml9_ordinal_targets")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 120


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda v: None if pd.isna(v) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) else str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v
    return sorted((tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_results_match_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, str(SF)).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_failed_rows_are_filtered_after_parsing(spark):
    """The status is parsed in steps; a filter on it that is moved below them grows beyond the driver's memory."""
    db = duckdb.connect()
    db.execute(f"create view events as select * from read_parquet('{SF}/events.parquet')")
    found = entry.queries()["pf19_failed_rows"](spark, str(SF))
    assert "TEST_RESULT" not in found._jdf.queryExecution().logical().toString()
    assert rows(found.toPandas()) == rows(db.execute(entry.oracle_sql()["pf19_failed_rows"]).df())


@pytest.mark.parametrize("finished", [(0,), (0, 70), (60, 59), (85, 99), (99,)])
def test_the_lowest_band_is_told_whichever_bands_occur(spark, tmp_path, finished):
    """Of the bands that occur, the lowest may be the only one and so the first in order, or be missing."""
    days = [(f"2024-01-{d + 1:02d}", "F" if i < n else "O", "1-URGENT") for d, n in enumerate(finished) for i in range(100)]
    df = spark.createDataFrame(days, "o_orderdate string, o_orderstatus string, o_orderpriority string")
    df.selectExpr("cast(o_orderdate as date) as o_orderdate", "o_orderstatus", "o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    db.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = rows(db.execute(entry.oracle_sql()["jn6_ml11_one_hot"]).df())
    assert rows(entry.queries()["jn6_ml11_one_hot"](spark, str(tmp_path)).toPandas()) == want
    assert {r[0]: r[2] for r in want} == {n / 100: float(n < 60) for n in finished}
