"""Daily roll-ups and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import features
from tallymark.operators.events import add
from tallymark.schema import FAMILIES, SETTINGS, STATUSES, Settings


def daily_features(events: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """All daily aggregates, family counts, daily statistics and TRUST_SCORE in one aggregation.

    What might be joins of separate aggregates (failures with totals, features with
    statistics) are conditional sums of the same grouping.
    """
    aggregates = features.daily(features.numeric()) | {"TRUST_SCORE": features.trust(s)}
    return events.groupBy(F.to_date("run_ts").alias("calendar_date")).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])


def add_scores(daily: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """DQ_SCORE, rates, counts and categories from daily aggregates."""
    score = F.when(F.col("daily_total_tests") > 0, F.col("daily_test_passed_sum").cast("double") / F.col("daily_total_tests")).otherwise(0.0)
    return add(daily.withColumn("DQ_SCORE", score), features.scores(s))


def daily_scores(events: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Only the scores of each day: two sums and a count, of status, severity and time alone."""
    sums = events.groupBy(F.to_date("run_ts").alias("calendar_date")).agg(
        F.count("*").alias("daily_total_tests"),
        F.count_if(F.col("status") == "pass").alias("daily_test_passed_sum"),
        F.expr(features.trust(s)).alias("TRUST_SCORE"),
    )
    score = F.col("daily_test_passed_sum").cast("double") / F.col("daily_total_tests")
    return sums.select("calendar_date", score.alias("DQ_SCORE"), "TRUST_SCORE", F.col("daily_total_tests").alias("total_tests"))


def family_counts(events: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("test_family") == f).alias(f"daily_{f}_count") for f in FAMILIES]
    return events.groupBy(F.to_date("run_ts").alias("calendar_date")).agg(*counts)


def status_rates(events: DataFrame) -> DataFrame:
    """Rates of each status by timestamp, rounded to 4 digits."""
    n = F.count("status")
    rates = [F.round(F.count_if(F.col("status") == s) / F.nullif(n, F.lit(0)), 4).alias(f"{s}_rate") for s in STATUSES]
    return events.groupBy("run_ts").agg(*rates)


def failures_and_totals(events: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Weight and number of failures, and the most weight possible, by day."""
    failed = F.col("status") == "fail"
    return events.groupBy(F.to_date("run_ts").alias("calendar_date")).agg(
        F.sum(F.when(failed, F.expr(features.weight("violation_severity", 1, s))).otherwise(0)).alias("severity_weight"),
        F.count_if(failed).alias("failed"),
        F.sum(F.expr(features.weight("violation_severity", 0, s))).alias("max_possible_weighted_points"),
    )
