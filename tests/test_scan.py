"""Prefix scans over several levels, and what is built on them, against one pass in memory."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import events, forecast, scan
from tallymark.sources.test_results import load_events

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize("fan", [2, 3, 512])
def test_carry_over_levels(spark, monkeypatch, fan):
    monkeypatch.setattr(scan, "FAN", fan)
    rng = random.Random(fan)
    parts = sorted(rng.sample(range(-60, 400), 45))
    rows = [(p, rng.randint(0, 9), rng.choice((None, f"v{p}")), rng.choice((None, None, float(p)))) for p in parts]
    df = spark.createDataFrame(rows, "part long, n long, s string, x double").repartition(5)
    got = {r.part: r for r in scan.carry(df, "part", ("n",), ("s", "x")).collect()}
    n, s, x = 0, None, None
    for part, a, b, c in rows:
        assert (got[part].n, got[part].s, got[part].x) == (n, s, x)
        n, s, x = n + a, (s if b is None else b), (x if c is None else c)
    assert len(got) == len(rows)


def test_carry_of_nothing(spark):
    assert scan.carry(spark.createDataFrame([], "part long, n long"), "part", ("n",)).collect() == []


def test_numbers_follow_the_order_with_one_partitioned_scan(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 40), rng.choice((None, "a", "b")), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, scan_at string, i int").repartition(7)
    out = scan.numbered(df, [F.col("k").desc(), F.col("i")], "number", first=1)
    want = {i: n + 1 for n, (_, i) in enumerate(sorted((-k, i) for k, _, i in rows))}
    assert {r.i: r.number for r in out.collect()} == want and "scan_at" in out.columns
    assert scan.numbered(df.limit(0), [F.col("i")]).collect() == []


def test_synthetic_dates_by_several_columns(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (1, 1), (3, 0)], "a int, b int")
    assert {(r.a, r.b): r.date.day for r in load_events(df, order=["a", "b"]).collect()} == {(1, 1): 1, (1, 2): 2, (2, 1): 3, (3, 0): 4}


@pytest.mark.parametrize("fan", [2, 512])
def test_fill_forward_through_empty_and_negative_ranges(spark, monkeypatch, fan):
    monkeypatch.setattr(scan, "FAN", fan)
    rows = [(i, float(i) if i % 13 == 3 else None, "s" if i == -7 else None) for i in (*range(-20, 10), *range(300, 340))]
    df = spark.createDataFrame(rows, "event_id long, x double, status string")
    got = {r.event_id: (r.x, r.status) for r in events.fill_forward(df, ["x", "status"], width=4).collect()}
    x, s = 0.0, "0"
    for i, a, b in rows:
        x, s = (x if a is None else a), (s if b is None else b)
        assert got[i] == (x, s)


def test_as_of_a_hot_day_is_spread(spark):
    known = spark.createDataFrame([(DAY + dt.timedelta(d), d / 100) for d in (3, 10, 40)], "calendar_date date, DQ_SCORE double")
    asked = [DAY + dt.timedelta(10)] * 4000 + [DAY + dt.timedelta(d) for d in range(60)] + [None]
    days = spark.createDataFrame([(d,) for d in asked], "day date").repartition(6)
    rows = forecast.as_of_each(days, known)
    for r in rows.collect():
        best = [d for d in (3, 10, 40) if r.day is not None and DAY + dt.timedelta(d) <= r.day]
        assert (r.date, r.DQ_SCORE) == ((DAY + dt.timedelta(best[-1]), best[-1] / 100) if best else (None, None))
    assert rows.count() == len(asked)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join ranges this small
    spread = scan.dealt(days.select(F.col("day").alias("at"), F.xxhash64(F.monotonically_increasing_id()).alias("s")), [F.col("at"), F.col("s")], "place")
    assert spread.groupBy(F.shiftright("place", 33)).count().agg(F.max("count")).first()[0] < 2500
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_both_periods_from_one_pass(spark):
    rng = random.Random(8)
    columns = ["test_passed", "test_failed", "test_error", "has_violations", "violation_count", "execution_time", "records_processed"]
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=rng.randint(0, 24 * 70)), *[rng.choice((None, rng.randint(0, 50))) for _ in columns]) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, run_ts timestamp_ntz, " + ", ".join(f"{c} int" for c in columns))
    both = events.both_periods(df)
    for period in ("week", "month"):
        want = events.period_stats(df, period)
        got = both.where(F.col("period") == period).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    joined = events.join_periods(df)
    assert joined.count() == len(rows) and "SortMergeJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert events.join_periods(df, "intended").where("test_passed_sum is null").count() == 0
