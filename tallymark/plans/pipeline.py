"""Compositions: from a raw log to the daily table, the irregular table and a forecast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallymark.functions import features
from tallymark.functions.parse import parse_events
from tallymark.operators import daily, encode, events, forecast, irregular, temporal
from tallymark.schema import SETTINGS, Settings


def events_to_daily(parsed: DataFrame, mode: str = "as_coded", s: Settings = SETTINGS) -> DataFrame:
    """Parsed events to the scored daily table, before temporal features."""
    return daily.add_scores(daily.daily_features(events.engineer(parsed, mode), s), s)


def standard(parsed: DataFrame, mode: str = "as_coded", s: Settings = SETTINGS) -> DataFrame:
    """The wide daily table: aggregates, scores, categories and temporal features, filled backward."""
    wide = temporal.temporal_features(events_to_daily(parsed, mode, s), s)
    return temporal.fill_backward(wide, [*temporal.numeric_columns(wide)])


def irregular_table(standard_table: DataFrame, mode: str = "as_coded", s: Settings = SETTINGS) -> DataFrame:
    """The gap-aware table without missing or infinite numbers."""
    return irregular.prepared(irregular.irregular_features(standard_table, mode, s))


@dataclass
class Result:
    standard: DataFrame
    irregular: DataFrame | None
    artifact: forecast.Artifact | None


def run(raw: DataFrame, out: str, mode: str = "as_coded", with_irregular: bool = True, with_forecast: bool = False) -> Result:
    """The whole pipeline; each table is written under ``out`` as Parquet and read back by what follows."""
    spark = raw.sparkSession
    parse_events(raw, mode).write.mode("overwrite").parquet(f"{out}/events")
    standard(spark.read.parquet(f"{out}/events"), mode).write.mode("overwrite").parquet(f"{out}/standard")
    table = spark.read.parquet(f"{out}/standard")
    gap = None
    if with_irregular:
        irregular_table(table, mode).write.mode("overwrite").parquet(f"{out}/irregular")
        gap = spark.read.parquet(f"{out}/irregular")
    artifact = forecast.train(gap if gap is not None else table) if with_forecast else None
    return Result(table, gap, artifact)


def width(families: int = len(features.FAMILIES)) -> int:
    """Columns of the standard table but for its date."""
    return len(features.daily(features.numeric())) + 2 + len(features.scores()) + len(features.temporal())


__all__ = ["encode", "events_to_daily", "irregular_table", "run", "standard", "width"]
