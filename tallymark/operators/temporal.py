"""Lags, changes, rolling statistics and momentum over the rows of a daily table.

All offsets count rows, not days.  A daily table has a row for each day at most, so a window
over all of its rows stays small however many events there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import features
from tallymark.operators.events import add
from tallymark.schema import SETTINGS, Settings


def temporal_features(daily: DataFrame, s: Settings = SETTINGS, order: str = "calendar_date") -> DataFrame:
    return add(daily, features.temporal(order, s))


def numeric_columns(df: DataFrame, *without: str) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without]


def fill_backward(df: DataFrame, columns: list[str] | None = None, order: str = "calendar_date") -> DataFrame:
    """The next value of each column, then 0: early rows learn from later ones, as coded."""
    after = Window.orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    types = dict(df.dtypes)
    columns = columns or numeric_columns(df)
    value = lambda c: F.coalesce(F.first(F.nanvl(c, F.lit(None)) if types[c] == "double" else c, ignorenulls=True).over(after), F.lit(0).cast(types[c]))
    return df.withColumns({c: value(c) for c in columns})


def clean(df: DataFrame, columns: list[str] | None = None, order: str = "calendar_date") -> DataFrame:
    """Infinite values to missing, then the value before, the value after, or 0 (of a text column, its text)."""
    w = Window.orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    types = dict(df.dtypes)

    def value(c: str):
        x = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) if types[c] in ("double", "float") else F.col(c)
        return F.coalesce(F.last(x, ignorenulls=True).over(before), F.first(x, ignorenulls=True).over(after), F.lit(0).cast(types[c]))  # 0 as text is "0"

    return df.withColumns({c: value(c) for c in columns or numeric_columns(df)})
