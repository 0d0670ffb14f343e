"""Models from sums: walk-forward folds, trees and served expressions against rows in memory."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import forecast, gram, trees

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    """Sixty days, columns of very different size, a constant one, one constant at first, a copy and a missing value."""
    rng = np.random.default_rng(7)
    rows, score = [], 0.6
    for i in range(60):
        big = 5e8 + 1e5 * rng.normal()
        small = 1e-6 * rng.normal()
        score = float(np.clip(0.3 + 0.5 * score + 0.1 * rng.normal() + (big - 5e8) / 2e6, 0, 1))
        rows.append((DAY + dt.timedelta(i), score, big, small, 4.0, 0.0 if i < 30 else float(rng.integers(3)), big, None if i == 5 else float(i % 7)))
    return spark.createDataFrame(rows, "calendar_date date, DQ_SCORE double, big double, small double, same double, later double, copy double, gap double")


def brute_linear(x, y, name):
    """Each model by its textbook form, on rows."""
    if name == "Ridge":
        return np.linalg.solve(x.T @ x + 5.0 * np.eye(x.shape[1]), x.T @ y)
    w = np.zeros(x.shape[1])
    if name == "ElasticNet":
        n, size = len(x), (x * x).sum(0)
        for _ in range(10_000):
            most = 0.0
            for j in np.flatnonzero(size):
                old = w[j]
                rho = x[:, j] @ (y - x @ w) + size[j] * old
                w[j] = np.sign(rho) * max(abs(rho) - n * 0.05, 0) / (size[j] + n * 0.05)
                most = max(most, abs(w[j] - old))
            if most <= 1e-4 * max(np.abs(w).max(), 1e-12):
                return w
    noise, weight = 1 / (y.var() + 1e-15), 1.0
    for _ in range(300):
        old = w
        a = noise * x.T @ x + weight * np.eye(x.shape[1])
        w = noise * np.linalg.solve(a, x.T @ y)
        gamma = x.shape[1] - weight * np.trace(np.linalg.inv(a))
        weight = (gamma + 2e-6) / (w @ w + 2e-6)
        noise = (len(x) - gamma + 2e-6) / (((y - x @ w) ** 2).sum() + 2e-6)
        if np.abs(w - old).sum() < 1e-3:
            return w
    return w


@pytest.mark.parametrize("block", [7, 128])
def test_every_fold_is_the_fit_of_the_rows_before(table, block):
    rows = table.orderBy("calendar_date").fillna(0.0).collect()
    x = np.array([[r[c] for c in table.columns[1:]] for r in rows[:-1]])
    y = np.array([r.DQ_SCORE for r in rows[1:]])
    got = {(r.fold, r.model): r for r in forecast.walk_forward(table, block=block).collect()}
    first = int(0.4 * len(x))
    assert len(got) == 5 * (len(x) - first)
    for t in range(first, len(x)):
        mean, scale = x[:t].mean(0), x[:t].std(0)
        scale = np.where(scale <= 1e-9 * np.abs(mean), 1.0, scale)
        z, here = (x[:t] - mean) / scale, (x[t] - mean) / scale
        z[:, scale == 1.0] = 0.0
        for name in forecast.LINEAR:
            w = brute_linear(z, y[:t] - y[:t].mean(), name)
            assert got[t, name].pred == pytest.approx(y[:t].mean() + here @ w, abs=1e-6), (t, name)
        assert got[t, forecast.TREE].pred == pytest.approx(trees.tree(x[:t], y[:t]).predict(x[t : t + 1])[0])
        assert got[t, forecast.NAIVE].pred == x[t, 0] and got[t, "Ridge"].actual == y[t] and got[t, "Ridge"].date == rows[t].calendar_date


def test_moments_add_up_and_come_back_from_bytes():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=50)
    whole = gram.Moments.of(x, y)
    parts = gram.Moments.of(x[:13], y[:13]) + gram.Moments(6) + gram.Moments.from_bytes(gram.Moments.of(x[13:], y[13:]).to_bytes())
    one = gram.Moments(6)
    for a, b in zip(x, y):
        one.add(a, b)
    for m in (parts, one):
        assert m.n == 50 and m.products == pytest.approx(whole.products) and m.sums == pytest.approx(whole.sums)


def test_moments_of_many_tasks(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 3)), rng.normal(size=400)
    df = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y)], "y double, x array<double>").repartition(9)
    shift = gram.shift_of(df)
    assert shift[0] == pytest.approx(x.mean(0)) and shift[1] == pytest.approx(x.std(0))
    whole = gram.Moments.of((x - shift[0]) / shift[1], y)
    for fan in (2, 64):
        assert gram.total(df, shift, fan).products == pytest.approx(whole.products, abs=1e-9)
    blocks = gram.block_moments(df.withColumn("block", F.floor(F.rand(1) * 11).cast("long")), shift)
    assert blocks.count() == 11


def test_moments_before_each_block(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(90, 2)), rng.normal(size=90)
    df = spark.createDataFrame([(i // 10, float(y[i]), [float(v) for v in x[i]]) for i in range(90)], "block long, y double, x array<double>")
    shift = (np.zeros(2), np.ones(2))
    got = {r.block: gram.Moments.from_bytes(bytes(r.moments)) for r in gram.before_blocks(gram.block_moments(df, shift), 8).collect()}
    assert sorted(got) == list(range(1, 10))
    for b, m in got.items():
        assert m.products == pytest.approx(gram.Moments.of(x[: 10 * b], y[: 10 * b]).products)


# --- trees ---


def same_tree(a, b):
    assert a.value == pytest.approx(b.value, abs=1e-9) and (a.low is None) == (b.low is None)
    if a.low is not None:
        assert (a.feature, a.at) == (b.feature, pytest.approx(b.at)) and a.gain == pytest.approx(b.gain, abs=1e-9)
        same_tree(a.low, b.low)
        same_tree(a.high, b.high)


@pytest.mark.parametrize("seed", range(4))
def test_a_grown_tree_is_the_tree_of_rows_in_memory(spark, seed):
    rng = np.random.default_rng(seed)
    n = (3, 40, 200, 200)[seed]
    x = np.round(rng.normal(size=(n, 4)), (3, 1, 0, 3)[seed])
    x[:, 3] = x[:, 0]  # a copy: the first of equal columns counts
    y = np.where(x[:, 1] > 0, x[:, 0], 3.0) + 0.1 * rng.normal(size=n)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, d double, y double").repartition(5)
    for depth, leaf in ((1, 1), (2, 2), (3, 5)):
        same_tree(trees.grow(df, "y", names, depth, leaf), trees.tree(x, y, depth, leaf))


def test_trees_of_no_rows_one_label_and_missing_values(spark):
    empty = spark.createDataFrame([], "a double, y double")
    assert trees.grow(empty, "y", ["a"]) == trees.Node(0.0)
    flat = spark.createDataFrame([(float(i), 2.5) for i in range(9)], "a double, y double")
    assert trees.grow(flat, "y", ["a"]).low is None and trees.grow(flat, "y", ["a"]).value == 2.5
    gaps = spark.createDataFrame([(None, 1.0), (None, 1.0), (5.0, 3.0), (5.0, 3.0), (9.0, None)], "a double, y double")
    grown = trees.grow(gaps, "y", ["a"])
    assert (grown.at, grown.low.value, grown.high.value) == (2.5, 1.0, 3.0)


# --- served expressions ---


def test_a_served_expression_is_the_model(table):
    rows = table.orderBy("calendar_date").collect()
    for only in (*forecast.LINEAR, forecast.TREE):
        labelled = forecast.labelled(table)
        names = [c for c in table.columns if c != "calendar_date"]
        artifact = forecast.fit(labelled, only, "DQ_SCORE", names, "DQ_SCORE_next")
        again = forecast.Artifact.from_json(artifact.to_json())
        served = forecast.predict(table, again)
        assert "Python" not in served._jdf.queryExecution().toString() and "Pandas" not in served._jdf.queryExecution().toString()
        want = artifact.predict(np.array([[r[c] or 0.0 for c in names] for r in rows]))
        got = {r.date: r for r in served.collect()}
        for r, w in zip(rows, want):
            assert got[r.calendar_date].predicted == pytest.approx(w, abs=1e-9) and got[r.calendar_date].model == only
            assert got[r.calendar_date].missing == (r["gap"] is None)


def test_training_takes_the_best_model_and_serves_it(table):
    artifact = forecast.train(table)
    assert artifact.model == min(artifact.rmse, key=lambda m: (artifact.rmse[m], m)) and len(artifact.rmse) == 5
    row = forecast.forecast(table, artifact).first()
    assert row.date == DAY + dt.timedelta(59) and math.isfinite(row.predicted)


def test_a_wide_linear_model_is_a_shallow_expression(spark):
    names = [f"c{i}" for i in range(600)]
    df = spark.range(3).select(F.to_date(F.lit("2024-01-01")).alias("calendar_date"), F.lit(0.5).alias("DQ_SCORE"), *[(F.col("id") * i).cast("double").alias(c) for i, c in enumerate(names)])
    artifact = forecast.Artifact("Ridge", "DQ_SCORE", names, "post_run", {}, [0.0] * 600, [1.0] * 600, forecast.Linear(np.full(600, 0.001), 0.25))
    assert sorted(r.predicted for r in forecast.predict(df, artifact).collect()) == pytest.approx([0.25 + 0.001 * k * sum(range(600)) for k in range(3)])
