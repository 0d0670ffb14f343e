"""Sinks: tables, JSON summaries and Markdown reports, from small aggregates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import forecast, irregular, profile
from tallymark.operators.stored import publish, published
from tallymark.operators.temporal import numeric_columns


def save(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text by Spark's writer, so that any store can hold it."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def load_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first().value.rstrip("\n")


def summary(df: DataFrame, key: str = "calendar_date") -> dict:
    """Shape, span, missing values and score statistics of a daily table."""
    first, last, days, n = profile.span(df, key).first()
    missing = {r.column: r.missing for r in profile.coverage(df).collect() if r.missing}
    scores = profile.score_stats(df).first().asDict() if "DQ_SCORE" in df.columns else {}
    return {"rows": n, "columns": len(df.columns), "first": str(first), "last": str(last), "days": days, "missing": missing, "scores": scores}


def save_summary(df: DataFrame, path: str) -> None:
    save_text(df.sparkSession, json.dumps(summary(df), sort_keys=True), path)


def publish_text(spark: SparkSession, text: str, folder: str) -> None:
    """A summary, report or artifact as a version of its own, committed by manifest."""
    publish(spark.createDataFrame([(text,)], "value string").coalesce(1), folder)


def published_text(spark: SparkSession, folder: str) -> str | None:
    """The newest text whose files agree with its manifest."""
    df = published(spark, folder)
    return None if df is None else df.first().value


def publish_artifact(spark: SparkSession, artifact: forecast.Artifact, folder: str) -> None:
    publish_text(spark, artifact.to_json(), f"{folder}/dq_score_next_forecaster")


def published_artifact(spark: SparkSession, folder: str) -> forecast.Artifact | None:
    """The newest artifact that can be read; None where there is none."""
    text = published_text(spark, f"{folder}/dq_score_next_forecaster")
    try:
        return None if text is None else forecast.Artifact.from_json(text)
    except (ValueError, KeyError, TypeError):
        return None


def processing_report(df: DataFrame) -> str:
    s = summary(df)
    top = profile.top_variances(df, 10, numeric_columns(df)).collect()
    lines = [
        "# Processing report",
        f"- Rows: {s['rows']}, columns: {s['columns']}",
        f"- From {s['first']} to {s['last']} ({s['days']} days)",
        f"- Columns with missing values: {len(s['missing'])}",
        *[f"- {k}: {v}" for k, v in s["scores"].items()],
        "## Largest variances",
        *[f"- {r.column}: {r.variance}" for r in top],
    ]
    return "\n".join(lines)


def irregular_report(df: DataFrame) -> str:
    g, i = irregular.gap_stats(df).first(), irregular.infinities(df).first()
    return "\n".join(
        [
            "# Irregular series",
            f"- Gaps in days: mean {g.mean_gap}, median {g.median_gap}, {g.min_gap} to {g.max_gap}",
            f"- Share of days with a measurement: {g.sparsity}",
            f"- Infinite values: {i.infinite_values}, missing: {i.null_values}",
        ]
    )


def forecast_report(artifact: forecast.Artifact) -> str:
    rows = sorted(artifact.rmse.items(), key=lambda r: (r[1], r[0]))
    return "\n".join(["# Forecast", f"- Model: {artifact.model}", *[f"- {m}: RMSE {v:.6f}" for m, v in rows]])


def save_artifact(spark: SparkSession, artifact: forecast.Artifact, folder: str, stamp: str) -> str:
    """Under a name with its UTC stamp, so that the newest sorts last."""
    path = f"{folder}/dq_score_next_forecaster/stamp={stamp}"
    save_text(spark, artifact.to_json(), path)
    return path


def load_artifact(spark: SparkSession, folder: str) -> forecast.Artifact | None:
    """The newest artifact, or None where there is none that can be read."""
    from pyspark.errors import PySparkException

    try:
        rows = spark.read.option("wholetext", True).text(f"{folder}/dq_score_next_forecaster")
        newest = rows.orderBy(F.desc(F.col("stamp").cast("string"))).first()
        return forecast.Artifact.from_json(newest.value) if newest else None
    except (PySparkException, ValueError, KeyError, TypeError):
        return None
