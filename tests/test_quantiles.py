"""Exact quantiles by repeated histograms against sorting, with small buffers so that many passes are needed."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import profile, quantiles

SHARES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def cases():
    rng = random.Random(3)
    return {
        "uniform": [rng.random() for _ in range(300)],
        "few": [float(rng.randint(0, 3)) for _ in range(300)],
        "wide": [math.exp(rng.uniform(-60, 60)) * rng.choice((-1, 1)) for _ in range(300)],
        "extreme": [rng.choice((-1.7e308, 1.7e308, 5e-324, 0.0, -0.0)) for _ in range(300)],
        "one": [7.5] * 300,
        "hot": [1.0] * 200 + [rng.random() for _ in range(100)],
        "gaps": [rng.choice((None, float("nan"), rng.random())) for _ in range(300)],
        "endless": [rng.choice((float("inf"), -float("inf"), rng.random())) for _ in range(300)],
        "none": [None] * 300,
        "single": [3.25] + [None] * 299,
    }


@pytest.mark.parametrize("buckets, listed", [(64, 8), (2048, 4096)])
def test_quantiles_against_sorting(spark, buckets, listed):
    data = cases()
    df = spark.createDataFrame([*zip(*data.values())], ", ".join(f"{c} double" for c in data)).repartition(5)
    got = quantiles.exact_quantiles(df, {c: F.col(c) for c in data}, SHARES, buckets, listed)
    for c, values in data.items():
        kept = sorted(v for v in values if v is not None and not math.isnan(v))
        for share, g in zip(SHARES, got[c]):
            if not kept:
                assert g is None
                continue
            at = share * (len(kept) - 1)
            low, high = kept[math.floor(at)], kept[math.ceil(at)]
            assert g == (low if low == high else (math.floor(at) + 1 - at) * low + (at - math.floor(at)) * high), (c, share)


def test_quantiles_of_an_empty_table(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "x double"), {"x": F.col("x")}, SHARES) == {"x": [None] * 6}


def test_many_distinct_values_take_few_passes(spark):
    df = spark.range(2_000_000).select((F.xxhash64("id") % 1_000_003 / 7.0).alias("x"))
    passes = []
    narrowed = quantiles._narrowed
    quantiles._narrowed = lambda *a: passes.append(1) or narrowed(*a)
    try:
        got = quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.5])["x"][0]
    finally:
        quantiles._narrowed = narrowed
    assert got == df.agg(F.percentile("x", F.lit(0.5))).first()[0] and len(passes) <= 2


def test_describe(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=301)
    df = spark.createDataFrame([(float(v), int(i)) for i, v in enumerate(x)] + [(None, None)], "x double, i int")
    rows = {r["column"]: r for r in profile.describe(df, ["x", "i"]).collect()}
    assert rows["x"].n == 301 and rows["i"].median == 150.0 and (rows["i"].q1, rows["i"].q3) == (75.0, 225.0)
    assert [rows["x"].q1, rows["x"].median, rows["x"].q3] == pytest.approx(np.percentile(x, [25, 50, 75]), abs=1e-6)
    nothing = profile.describe(df.where("i < 0"), ["x"]).first()
    assert nothing.n == 0 and nothing.median is None
