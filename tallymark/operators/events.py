"""Event-level features: flattening, flags, rates, period statistics and carrying values forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import classify, features, parse
from tallymark.operators.scan import carried_forward, unused
from tallymark.operators.stored import stored
from tallymark.schema import NO_VIOLATIONS, NOT_APPLICABLE, NUMERIC_METRICS, check_mode


def add(df: DataFrame, columns: features.Columns) -> DataFrame:
    """All columns of one stage in one projection."""
    return df.withColumns({n: F.expr(e) for n, e in columns.items()})


def flatten(parsed: DataFrame, mode: str = "as_coded") -> DataFrame:
    """One flat row for each parsed event: event_id, run_ts, status, severity, metrics and objects.

    A row without an event becomes an error row.  As coded, a missing severity stays
    missing and a missing column is the only missing field that counts as such.
    """
    e = F.col("DQ_EVENT")
    broken = e.isNull()
    severity = F.col("SEVERITY_LEVEL")
    by_status = F.when(e["status"] == "pass", NO_VIOLATIONS).otherwise("HIGH SEVERITY")
    if check_mode(mode):
        violation = F.when(e["status"] == "pass", NO_VIOLATIONS).otherwise(F.coalesce(F.nullif(severity, F.lit("")), F.lit("HIGH SEVERITY")))
    else:
        violation = F.when(severity == "", by_status).otherwise(severity)
    columns = [
        F.col("EVENT_ID").alias("event_id"),
        F.col("RUN_TIMESTAMP").alias("run_ts"),
        F.when(broken, "ERROR").otherwise(e["status"]).alias("status"),
        F.when(broken, NOT_APPLICABLE).otherwise(e["test_family"]).alias("test_family"),
        F.when(broken, NOT_APPLICABLE).otherwise(e["test_category"]).alias("test_category"),
        F.when(e["test_category"] == "ALLOCATION_ALLOCATED", e["metrics"]["curr_alloc_count"]).otherwise(0).alias("records_processed"),
        F.when(broken, "UNKNOWN").otherwise(violation).alias("violation_severity"),
    ]
    for side in ("source", "target"):
        o = e["objects"][side]
        for field in ("database", "table", "column", "object_level"):
            value = F.coalesce(o[field], F.lit(NOT_APPLICABLE)) if field == "column" or check_mode(mode) else o[field]
            columns.append(F.when(o.isNull(), NOT_APPLICABLE).otherwise(value).alias(f"{side}_{field}"))
    columns += [e["metrics"][m].alias(f"metric_{m}") for m in NUMERIC_METRICS]
    return parsed.select(*columns)


def statuses(raw: DataFrame, mode: str = "as_coded") -> DataFrame:
    """event_id, run_ts, status, test_family and violation_severity of raw rows, as ``flatten`` has them, without the rest.

    Store it before a filter on the status: Catalyst moves a filter below the steps of the parsers and writes each of
    them out wherever the next one uses it, which the driver cannot hold.
    """
    rows = parse.routed(raw, mode).select("EVENT_ID", "RUN_TIMESTAMP", "TEST_FAMILY", "SEVERITY_LEVEL", parse.status(mode).alias("status"))
    clean = F.col("status") == "pass"
    if check_mode(mode):
        severity = F.when(clean, NO_VIOLATIONS).otherwise(F.coalesce(F.nullif("SEVERITY_LEVEL", F.lit("")), F.lit("HIGH SEVERITY")))
    else:
        severity = F.when(F.col("SEVERITY_LEVEL") == "", F.when(clean, NO_VIOLATIONS).otherwise("HIGH SEVERITY")).otherwise(F.col("SEVERITY_LEVEL"))
    return rows.select(
        F.col("EVENT_ID").alias("event_id"), F.col("RUN_TIMESTAMP").alias("run_ts"), "status", F.col("TEST_FAMILY").alias("test_family"), severity.alias("violation_severity")
    )


def event_features(flat: DataFrame, mode: str = "as_coded") -> DataFrame:
    """All event-level columns but the period statistics; one shuffle, by timestamp."""
    check_mode(mode)
    for stage in features.stages(mode):
        flat = add(flat, stage)
    return flat


def _label(ts, period: str):
    """The label of a time's week (its Sunday) or month (its last day), at midnight."""
    day = F.date_add(F.to_date(F.date_trunc("week", ts)), 6) if period == "week" else F.last_day(ts)
    return day.cast("timestamp_ntz")


def period_stats(events: DataFrame, period: str) -> DataFrame:
    """Sums and means by week (to its Sunday) or month (to its last day), with the label at midnight."""
    suffix = {"week": "", "month": "_monthly"}[period]
    aggregates = [F.expr(e).alias(n) for n, e in features.period(suffix).items()]
    return events.groupBy(_label(F.col("run_ts"), period).alias("label")).agg(*aggregates)


def both_periods(events: DataFrame) -> DataFrame:
    """``period_stats`` of weeks and months from one pass: label, period and the columns of both, null in the other's rows.

    Events are summed by day; a day's sums and counts then go to its week and its month.
    """
    used = features.period_columns()
    day = F.to_date("run_ts")
    sums = [F.sum(c).alias(f"sum_{c}") for c in used] + [F.count(c).alias(f"count_{c}") for c in used]
    days = events.groupBy(day.alias("day")).agg(*sums)
    labels = F.array(*[F.struct(_label(F.col("day").cast("timestamp_ntz"), p).alias("label"), F.lit(p).alias("period")) for p in ("week", "month")])
    spread = days.withColumn("to", F.explode(labels)).groupBy("to.label", "to.period")
    stats = [F.round(F.sum(f"sum_{c}").cast("double"), 4).alias(f"{c}_sum") for c in used]
    means = [F.round((F.sum(f"sum_{c}") / F.sum(f"count_{c}")).cast("double"), 4).alias(f"{c}_mean") for c in used]
    table = spread.agg(*stats, *means)
    out = [F.when(F.col("period") == p, F.col(name.removesuffix(suffix))).alias(name) for p, suffix in (("week", ""), ("month", "_monthly")) for name in features.period(suffix)]
    return table.select("label", "period", *out)


#: Periods up to which their statistics are sent to all tasks.
SENT_PERIODS = 50_000


def join_periods(events: DataFrame, mode: str = "as_coded") -> DataFrame:
    """Weekly and monthly statistics joined to events: as coded by exact timestamp, as intended by period.

    There are a few rows of statistics for each year; they are counted, and sent to all tasks if they are indeed few, so
    that events stay where they are.
    """
    stats = stored(both_periods(events), "periods")
    few = stats.count() <= SENT_PERIODS
    send = F.broadcast if few else (lambda df: df)
    ts = F.col("run_ts")
    if check_mode(mode):
        for p, suffix in (("week", ""), ("month", "_monthly")):
            side = stats.where(F.col("period") == p).select("label", *features.period(suffix))
            events = events.join(send(side), _label(ts, p) == F.col("label"), "left").drop("label")
        return events
    # a week and a month can end on one day: both meet the events of its midnight in one join
    side = stats.groupBy("label").agg(*[F.max(c).alias(c) for c in stats.columns[2:]])
    return events.join(send(side), ts == F.col("label"), "left").drop("label")


def fill_forward(events: DataFrame, columns: list[str], order: str = "event_id", width: int = 100_000) -> DataFrame:
    """Carry the last value of each column forward in row order, then fill numbers with 0.

    The order runs over all rows.  Rows are dealt into ranges of ``width`` ids; each range gives its last values, these
    are carried over the ranges in blocks, and every range starts from what was carried in.  So no task holds more than
    a range, and no window all ranges.  ``events`` is read twice: store it where it is dear.
    """
    part = unused(events, "fill_part")
    filled = carried_forward(events.withColumn(part, F.floor(F.col(order) / width)), columns, part, order).drop(part)
    types = dict(events.dtypes)
    nothing = {c: F.lit("0") if types[c] == "string" else F.lit(0).cast(types[c]) for c in columns}
    return filled.select(*[F.coalesce(c, nothing[c]).alias(c) if c in nothing else F.col(c) for c in events.columns])


def engineer(parsed: DataFrame, mode: str = "as_coded") -> DataFrame:
    """Parsed events to all event-level features.

    As intended, nothing is carried between unrelated tests: missing numbers stay missing.
    """
    # the period table reads this, and filling forward twice
    events = join_periods(stored(event_features(flatten(parsed, mode), mode), "events"), mode)
    if check_mode(mode):
        return events
    return fill_forward(events, features.filled())
