"""Gap-aware features for measurements at irregular days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import features
from tallymark.operators.events import add
from tallymark.operators.temporal import clean, numeric_columns
from tallymark.schema import SETTINGS, Settings, check_mode

INF = float("inf")


def gaps(df: DataFrame, order: str = "calendar_date", s: Settings = SETTINGS) -> DataFrame:
    """Days since the last and to the next measurement, long gaps and their severity."""
    since = f"coalesce(datediff({order}, lag({order}) over (order by {order})), 0)"
    df = df.withColumn("days_since_last_measurement", F.expr(since))
    mean = "avg(days_since_last_measurement) over ()"
    return add(
        df,
        {
            "days_to_next_measurement": f"coalesce(cast(datediff(lead({order}) over (order by {order}), {order}) as double), {mean})",
            "is_long_gap": f"case when days_since_last_measurement > {s.long_gap} then 1 else 0 end",
            "gap_severity": f"case when days_since_last_measurement <= 1 then 0 when days_since_last_measurement <= {s.long_gap} then 1 else 2 end",
        },
    )


def repair_infinities(df: DataFrame, mode: str = "as_coded") -> DataFrame:
    """Infinite changes in percent to 1000 (as intended with their sign), other infinities to the column's median."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    changes = [c for c in doubles if "pct_change" in c]
    others = [c for c in doubles if c not in changes]
    up = lambda c: F.when(F.col(c) < 0, -1000.0).otherwise(1000.0) if check_mode(mode) else F.lit(1000.0)
    df = df.withColumns({c: F.when(F.abs(c) == INF, up(c)).otherwise(F.col(c)) for c in changes})
    medians = df.agg(*[F.median(F.when(F.abs(c) < INF, F.col(c))).alias(f"median_{c}") for c in others])
    df = df.crossJoin(F.broadcast(medians))  # one row
    df = df.withColumns({c: F.when(F.abs(c) == INF, F.col(f"median_{c}")).otherwise(F.col(c)) for c in others})
    return df.drop(*medians.columns)


def rename_changes(df: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Changes over 1 to 14 rows are named for what they are; the one over 30 keeps its name."""
    return df.withColumnsRenamed({f"{x}_pct_change_{n}d": f"{x}_pct_change_lag_{n}obs" for x in features.SCORES for n in s.lags if n < 30})


def gap_aware_trends(df: DataFrame, order: str = "calendar_date") -> DataFrame:
    out = {}
    for x in features.SCORES:
        change = f"{x} - lag({x}) over (order by {order})"
        out[f"{x}_absolute_change"] = change
        out[f"{x}_daily_rate"] = f"case when days_since_last_measurement > 0 then coalesce(({change}) / days_since_last_measurement, 0.0) else 0.0 end"
    return add(df, out)


def frequency(df: DataFrame, order: str = "calendar_date", s: Settings = SETTINGS) -> DataFrame:
    """Measurements of the last 30, 60 and 90 days (the day itself in, the day that far back out) and their regularity."""
    day = f"unix_date({order})"
    out = {f"measurements_last_{n}d": f"count(*) over (order by {day} range between {n - 1} preceding and current row)" for n in s.horizons}
    w = f"over (order by {order} rows between 4 preceding and current row)"
    x = "days_since_last_measurement"
    out["measurement_regularity"] = f"case when count({x}) {w} = 5 then 1.0 / (1.0 + var_samp({x}) {w}) else 0.0 end"
    return add(df, out)


def irregular_features(daily: DataFrame, mode: str = "as_coded", s: Settings = SETTINGS) -> DataFrame:
    df = gaps(daily, s=s).drop(*features.misleading(s))
    return frequency(gap_aware_trends(rename_changes(repair_infinities(df, mode), s)), s=s)


def prepared(irregular: DataFrame) -> DataFrame:
    """Without missing or infinite numbers, for models."""
    return clean(irregular, numeric_columns(irregular))


def prepared_with_metadata(table: DataFrame, targets: tuple[str, ...] = features.SCORES, order: str = "calendar_date") -> tuple[DataFrame, DataFrame]:
    """The gap-aware table without missing or infinite values in any column, and a row that describes it.

    Numbers and texts take the value before, the value after, or 0.  The row has the numbers of rows, columns and
    features (by kind; all but the targets and the date), the targets, the span, the mean gap, and how many infinite
    values were found, repaired and left.  ``table`` is read twice: store it where it is dear.
    """
    kinds = dict(table.dtypes)
    numbers = numeric_columns(table)
    texts = [c for c, t in kinds.items() if t == "string" and c != order]
    done = clean(table, [*numbers, *texts], order)
    own = [c for c in table.columns if c not in (*targets, order)]
    number = {c: F.lit(c in numbers) for c in own}
    count = lambda xs: F.lit(len([c for c in own if c in xs]))
    found = infinities(table).select(F.col("infinite_values").alias("infinite_found"))
    row = done.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(table.columns) - 1).alias("n_columns"),
        F.lit(len(number)).alias("feature_count"),
        F.array(*[F.lit(t) for t in targets]).alias("target_variables"),
        F.min(order).alias("first"),
        F.max(order).alias("last"),
        F.avg("days_since_last_measurement").alias("average_gap_days"),
        count(numbers).alias("numeric_features"),
        count(texts).alias("categorical_features"),
        sum((F.count_if(F.abs(c) == INF) for c, t in kinds.items() if t in ("double", "float")), F.lit(0)).cast("long").alias("infinite_remaining"),
    )
    both = row.crossJoin(F.broadcast(found))  # one row each
    return done, both.withColumn("infinite_fixed", F.col("infinite_found") - F.col("infinite_remaining"))


def gap_stats(df: DataFrame, order: str = "calendar_date") -> DataFrame:
    """Mean, median, most and least days between measurements, and sparsity."""
    gap = df.selectExpr(order, f"datediff({order}, lag({order}) over (order by {order})) as gap")
    return gap.agg(
        F.avg("gap").alias("mean_gap"),
        F.median("gap").alias("median_gap"),
        F.max("gap").alias("max_gap"),
        F.min("gap").alias("min_gap"),
        (F.count("*") / (F.datediff(F.max(order), F.min(order)) + 1)).alias("sparsity"),
    )


def gap_histogram(df: DataFrame, order: str = "calendar_date", k: int = 10) -> DataFrame:
    """How often each gap occurs; the ``k`` smallest gaps."""
    gap = df.selectExpr(f"datediff({order}, lag({order}) over (order by {order})) as gap").where("gap is not null")
    return gap.groupBy("gap").agg(F.count("*").alias("n")).orderBy("gap").limit(k)


def infinities(df: DataFrame) -> DataFrame:
    """Infinite and missing values over all numeric columns."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    inf = sum((F.count_if(F.abs(c) == INF) for c in doubles), F.lit(0))
    null = sum((F.count_if(F.col(c).isNull()) for c in numeric_columns(df)), F.lit(0))
    return df.agg(inf.cast("long").alias("infinite_values"), null.cast("long").alias("null_values"))
