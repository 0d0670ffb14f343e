"""Encodings of the daily table for models."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.temporal import numeric_columns
from tallymark.schema import SETTINGS, check_mode

CATEGORIES = ("DQ_SCORE_CATEGORY", "TRUST_SCORE_CATEGORY")


def levels(target: str, mode: str = "as_coded") -> dict[str, int]:
    """Ordinal codes, the lowest band first; as coded, HIGH_QUALITY has none."""
    if target not in CATEGORIES:
        raise ValueError(f"target must be one of {CATEGORIES}, not {target!r}")
    s = SETTINGS
    names = [s.dq_lowest, *[n for _, n in s.dq_bands[::-1]]] if target == CATEGORIES[0] else [s.trust_lowest, *[n for _, n in s.trust_bands[::-1]]]
    if not check_mode(mode):
        names = [n for n in names if n != "HIGH_QUALITY"]
    return {n: i for i, n in enumerate(names)}


def for_classification(df: DataFrame, target: str = CATEGORIES[0], mode: str = "as_coded") -> DataFrame:
    """Adds the ordinal code of the target category; unknown ones have none."""
    if target not in df.columns:
        raise ValueError(f"{target} is not a column")
    code = F.lit(None).cast("int")
    for name, i in levels(target, mode).items():
        code = F.when(F.col(target) == name, i).otherwise(code)
    return df.withColumn(f"{target}_encoded", code)


def for_regression(df: DataFrame) -> DataFrame:
    return df.drop(*CATEGORIES)


def one_hot(df: DataFrame, columns: tuple[str, ...] = CATEGORIES, values: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """0/1 columns for all values of a category that occur but the first in order.

    The columns are those that occur, as the encoded table holds no others; they are bands, so the list has a fixed bound.
    For a category in ``values`` they are all of its values there but the first in order, whether they occur or not.
    """
    for c in columns:
        found = (values or {}).get(c) or [r[0] for r in df.select(c).distinct().where(F.col(c).isNotNull()).collect()]
        df = df.withColumns({f"{c}_{v}": (F.col(c) == v).cast("double") for v in sorted(found)[1:]}).drop(c)
    return df


def model_ready(df: DataFrame, task: str = "regression", target: str = CATEGORIES[0], mode: str = "as_coded") -> DataFrame:
    """Numeric columns for regression or classification."""
    if task == "regression":
        df = for_regression(df)
    elif task == "classification":
        df = for_classification(df, target, mode).drop(*CATEGORIES)
    else:
        raise ValueError(f"task must be regression or classification, not {task!r}")
    return df.select("calendar_date", *numeric_columns(df))
