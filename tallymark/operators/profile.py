"""Profiles: coverage, distributions, top values and exploratory summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.quantiles import exact_quantiles
from tallymark.operators.stored import stored
from tallymark.operators.temporal import numeric_columns


def coverage(df: DataFrame) -> DataFrame:
    """Missing values and coverage in percent by column: one aggregation, then a row for each column."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in df.columns])
    rows = counts.select("n", F.explode(pairs).alias("x")).select("x.column", (F.col("n") - F.col("x.present")).alias("missing"), "n")
    return rows.select("column", "missing", F.round(100.0 * (F.col("n") - F.col("missing")) / F.nullif("n", F.lit(0)), 4).alias("coverage"))


def span(df: DataFrame, ts: str) -> DataFrame:
    """First and last time, days between and rows."""
    return df.agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.datediff(F.max(ts), F.min(ts)).alias("days"), F.count("*").alias("n")
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of numeric columns, a row for each.

    Quartiles come from repeated histograms, so no task holds a column's distinct values; the columns are stored first.
    """
    rows = stored(df.select(*columns), "described")
    quartiles = exact_quantiles(rows, {c: F.col(f"`{c}`") for c in columns}, [0.25, 0.5, 0.75])

    def one(c: str):
        x = F.col(c).cast("double")
        q = [F.round(F.lit(v).cast("double"), 6) for v in quartiles[c]]
        return F.struct(
            F.lit(c).alias("column"),
            F.count(x).alias("n"),
            F.round(F.avg(x), 6).alias("mean"),
            F.round(F.stddev_samp(x), 6).alias("std"),
            F.min(x).alias("min"),
            *[v.alias(n) for v, n in zip(q, ("q1", "median", "q3"))],
            F.max(x).alias("max"),
        )

    return rows.agg(F.array(*[one(c) for c in columns]).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column with their share; ties go to the smaller value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    # a partial limit by rank comes before the shuffle, so no column's values meet in one task in full
    total = df.agg(F.count("*").alias("rows"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.crossJoin(F.broadcast(total)).select("column", "value", "n", "rank", F.round(100.0 * F.col("n") / F.col("rows"), 4).alias("percent"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.lit(c).alias("column"), F.countDistinct(c).alias("n_distinct")) for c in columns])


def score_stats(daily: DataFrame) -> DataFrame:
    """Mean, std, least, most and median of both scores."""
    out = [
        F.round(f(F.when(F.abs(c) < float("inf"), F.col(c))), 6).alias(f"{c}_{n}")
        for c in ("DQ_SCORE", "TRUST_SCORE")
        for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max), ("median", F.median))
    ]
    return daily.agg(*out)


def variances(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sample variance by column, a row for each."""
    columns = columns or numeric_columns(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.var_samp(F.col(c).cast("double")), 6).alias("variance")) for c in columns])
    return df.agg(pairs.alias("all")).select(F.explode("all").alias("x")).select("x.*")


def top_variances(df: DataFrame, k: int = 10, columns: list[str] | None = None) -> DataFrame:
    return variances(df, columns).where("variance is not null").orderBy(F.desc("variance"), "column").limit(k)


def hourly_histogram(df: DataFrame, ts: str = "RUN_TIMESTAMP") -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))


def peak_hour(df: DataFrame, ts: str = "RUN_TIMESTAMP") -> DataFrame:
    """The hour with the most rows, the earliest of equals."""
    return hourly_histogram(df, ts).agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("hour"), F.max("n").alias("n"))


def numeric_results(df: DataFrame, result: str = "TEST_RESULT") -> DataFrame:
    """Results that read as numbers: count, mean, median, most and zeros."""
    rows = stored(df.select(F.col(result).try_cast("double").alias("x")), "numbers")
    median = F.lit(exact_quantiles(rows, {"x": F.col("x")}, [0.5])["x"][0]).cast("double")
    return rows.agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), median.alias("median"), F.max("x").alias("max"), F.count_if(F.col("x") == 0).alias("zeros"))


def status_summary(parsed: DataFrame) -> DataFrame:
    """Rows, passes, failures and their rates in percent."""
    n = F.count("*")
    count = lambda s: F.count_if(F.col("STATUS") == s)
    return parsed.agg(
        n.alias("n"),
        count("pass").alias("passed"),
        count("fail").alias("failed"),
        F.round(100.0 * count("pass") / n, 4).alias("pass_rate"),
        F.round(100.0 * count("fail") / n, 4).alias("fail_rate"),
    )


def distribution(df: DataFrame, *by, n: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(n))
