"""Event-level features as SQL expressions, in the order of their columns.

They are plain CASE expressions over the flat event, so that the same text runs in Spark and in
the SQL that checks it; what differs between the two is left to the callers.
"""

from __future__ import annotations

from tallymark.schema import FAMILIES, NO_VIOLATIONS, NOT_APPLICABLE, NUMERIC_METRICS, SETTINGS, STATUSES, Settings

Columns = dict[str, str]
_FIELDS = ("database", "table", "column", "object_level")


def _if(condition: str) -> str:
    return f"case when {condition} then 1 else 0 end"


def status_flags() -> Columns:
    return {f"test_{n}": _if(f"status = '{s}'") for n, s in zip(("passed", "failed", "error", "skipped"), STATUSES)}


def base() -> Columns:
    return status_flags() | {
        "execution_time": "0",
        "records_failed": "0",
        "has_violations": "case when status = 'pass' then 0 else 1 end",
        "violation_count": "case when status = 'pass' then 0 else 1 end",
    }


def calendar(ts: str = "run_ts", weekday: str = "weekday({0})", next_day: str = "date_add(cast({0} as date), 1)") -> Columns:
    d = f"cast({ts} as date)"
    w, tomorrow = weekday.format(ts), next_day.format(ts)
    quarter = lambda x: f"month({x}) in (1, 4, 7, 10) and day({x}) = 1"
    return {
        "year": f"year({d})",
        "month": f"month({d})",
        "day": f"day({d})",
        "dayofweek": w,
        "dayofyear": f"dayofyear({d})",
        "week": f"weekofyear({d})",
        "quarter": f"quarter({d})",
        "month_sin": f"sin(2 * pi() * month({d}) / 12)",
        "month_cos": f"cos(2 * pi() * month({d}) / 12)",
        "dayofweek_sin": f"sin(2 * pi() * {w} / 7)",
        "dayofweek_cos": f"cos(2 * pi() * {w} / 7)",
        "is_weekend": _if(f"{w} >= 5"),
        "is_month_start": _if(f"day({d}) = 1"),
        "is_month_end": _if(f"day({tomorrow}) = 1"),
        "is_quarter_start": _if(quarter(d)),
        "is_quarter_end": _if(quarter(tomorrow)),
    }


def by_status(mode: str) -> Columns:
    flags = {f"is_{n}": _if(f"status = '{s}'") for n, s in zip(("passed", "failed", "error", "skipped"), STATUSES)}
    for f in FAMILIES:
        flags |= {f"{f}_{n}": _if(f"test_family = '{f}' and status = '{s}'") for n, s in zip(("passed", "failed", "error"), STATUSES)}
    fits = "status = 'pass' and has_violations = 0 or status = 'fail' and has_violations = 1 or status in ('error', 'skipped')"
    return flags | {"status_consistent_with_results": _if(fits)}


def clean_and_consistent(mode: str) -> Columns:
    """As coded, names are compared in the wrong case and statuses by the wrong words, so most of these never hold."""
    intended = mode == "intended"
    name = (lambda x: x.upper()) if intended else (lambda x: x)
    passed, failed = ("pass", "fail") if intended else ("passed", "failed")
    clean = f"violation_severity = '{NO_VIOLATIONS}'"
    fits = f"status = '{passed}' and has_violations = 0 or status = '{failed}' and has_violations = 1"
    return {
        "has_no_violations": _if(clean),
        "allocation_passed_clean": _if(f"test_family = '{name('allocation')}' and {clean}"),
        "uniqueness_passed_clean": _if(f"test_family = '{name('uniqueness')}' and {clean}"),
        "status_consistent": _if(fits),
        "clean_result_consistent": _if(f"status = '{passed}' and {clean}"),
        "status_inconsistent": f"case when {fits} then 0 else 1 end",
    }


def indicators() -> Columns:
    out = {f"has_{s}_{f}": f"case when {s}_{f} = '{NOT_APPLICABLE}' then 0 else 1 end" for s in ("source", "target") for f in _FIELDS}
    for s in ("source", "target"):
        out[f"has_{s}_object"] = "case when " + " and ".join(f"{s}_{f} = '{NOT_APPLICABLE}'" for f in _FIELDS[:3]) + " then 0 else 1 end"
    return out


def test_types(mode: str) -> Columns:
    name = (lambda *x: ", ".join(f"'{n.upper() if mode == 'intended' else n}'" for n in x))
    return {
        "is_schema_test": _if(f"test_family in ({name('schema')})"),
        "is_allocation_test": _if(f"test_family in ({name('allocation')})"),
        "is_uniqueness_test": _if(f"test_family in ({name('uniqueness')})"),
        "requires_source_target": _if(f"test_family in ({name('allocation', 'completeness', 'referential_integrity')})"),
        "requires_source_only": _if(f"test_family in ({name('uniqueness', 'schema' if mode == 'intended' else 'schema_drift')})"),
    }


def weight(severity: str, otherwise: int, s: Settings = SETTINGS) -> str:
    return f"case {severity}" + "".join(f" when '{k}' then {v}" for k, v in s.severity_weights.items()) + f" else {otherwise} end"


def severities(s: Settings = SETTINGS) -> Columns:
    levels = {"high": "HIGH SEVERITY", "medium": "MEDIUM SEVERITY", "low": "LOW SEVERITY"}
    out = {f"is_{k}_severity": _if(f"violation_severity = '{v}'") for k, v in levels.items()}
    out |= {"is_no_violations": _if(f"violation_severity = '{NO_VIOLATIONS}'"), "severity_weight": weight("violation_severity", 0, s)}
    for f in FAMILIES:
        out |= {f"{f}_{k}_severity": _if(f"test_family = '{f}' and violation_severity = '{v}'") for k, v in levels.items()}
    return out


def performance() -> Columns:
    """Needs the indicators."""
    both = "has_source_object * has_target_object"
    return {
        "execution_time_per_record": "case when records_processed > 0 then cast(execution_time as double) / records_processed else 0.0 end",
        "failure_rate": "case when records_processed > 0 then cast(records_failed as double) / records_processed else 0.0 end",
        "has_source_and_target": both,
        "complexity_score": f"2 * {both} + has_source_object + has_target_object + has_violations",
    }


def interactions() -> Columns:
    """Needs performance and severities; rates are means over the rows of the same timestamp."""
    out = {}
    for f in FAMILIES:
        for n in ("passed", "failed"):
            out[f"{f}_{n}_rate"] = f"avg({f}_{n}) over (partition by run_ts)"
    return out | {
        "violations_with_source": "has_violations * has_source_object",
        "violations_with_target": "has_violations * has_target_object",
        "violations_with_both": "has_violations * has_source_and_target",
        "high_severity_performance_impact": "is_high_severity * execution_time",
        "violation_count_performance_impact": "violation_count * execution_time_per_record",
    }


#: Statistics of a period: column, aggregate.
_PERIOD = [(c, "sum") for c in ("test_passed", "test_failed", "test_error", "has_violations", "violation_count")] + [
    ("execution_time", "avg"), ("execution_time", "sum"), ("records_processed", "sum"),
]


def period(suffix: str) -> Columns:
    """Sums and a mean of a period; the weekly names come without a suffix, as they clash with nothing."""
    return {f"{c}_{'mean' if a == 'avg' else a}{suffix}": f"round(cast({a}({c}) as double), 4)" for c, a in _PERIOD}


def period_columns() -> list[str]:
    """The columns that periods are summed over."""
    return list(dict.fromkeys(c for c, _ in _PERIOD))


#: The stages that build on one another, each seeing the columns of those before.
def stages(mode: str, **dialect: str) -> list[Columns]:
    return [
        base() | calendar(**dialect),
        by_status(mode) | clean_and_consistent(mode) | indicators() | test_types(mode) | severities(),
        performance(),
        interactions(),
    ]


def filled() -> list[str]:
    """Columns that carry their last value into later rows."""
    return ["status", "violation_severity", "records_processed", *(f"metric_{m}" for m in NUMERIC_METRICS), *period(""), *period("_monthly")]


def numeric() -> list[str]:
    """All numeric event columns, in order."""
    first = [*base()]
    head = [*first[:5], "records_processed", *first[5:]]
    rest = [c for s in stages("as_coded")[1:] for c in s]
    return [*head, *calendar(), *rest, *period(""), *period("_monthly"), *(f"metric_{m}" for m in NUMERIC_METRICS)]


def daily(columns: list[str]) -> Columns:
    """Daily aggregates of numeric columns by the naming rule; the first rule that fits counts."""
    out = {}
    for c in columns:
        if c in status_flags() or "count" in c or "has_" in c or c.endswith(("_passed", "_failed")):
            out[f"daily_{c}_sum"] = f"sum({c})"
        elif "rate" in c or "ratio" in c or "score" in c:
            out |= {f"daily_{c}_mean": f"avg({c})", f"daily_{c}_max": f"max({c})", f"daily_{c}_min": f"min({c})"}
        else:
            out[f"daily_{c}_mean"] = f"avg({c})"
    out |= {f"daily_{f}_count": f"sum(case when test_family = '{f}' then 1 else 0 end)" for f in FAMILIES}
    return out | {
        "daily_total_tests": "count(*)",
        "execution_time_mean": "round(avg(execution_time), 2)",
        "execution_time_sum": "sum(execution_time)",
        "records_processed_sum": "sum(records_processed)",
    }


def trust(s: Settings = SETTINGS) -> str:
    """1 - weight of failures / weight of all; 1 where both are 0, minus infinity where only the latter is."""
    lost = f"sum(case when status = 'fail' then {weight('violation_severity', 1, s)} else 0 end)"
    most = f"sum({weight('violation_severity', 0, s)})"
    return (
        f"case when {most} > 0 then round(1.0 - cast({lost} as double) / {most}, 4) "
        f"when {lost} > 0 then cast('-Infinity' as double) else cast(1.0 as double) end"
    )


def band(column: str, bands, lowest: str) -> str:
    rules = "".join(f" when {column} >= {b} then '{n}'" for b, n in bands)
    return f"case when {column} is null or isnan({column}) then 'UNKNOWN'{rules} else '{lowest}' end"


def scores(s: Settings = SETTINGS) -> Columns:
    """From the daily aggregates and TRUST_SCORE."""
    rate = lambda c: f"cast({c} as double) / daily_total_tests"
    return {
        "passed_tests": "daily_test_passed_sum",
        "failed_tests": "daily_test_failed_sum",
        "total_tests": "daily_total_tests",
        "pass_rate": "DQ_SCORE",
        "fail_rate": rate("daily_test_failed_sum"),
        "error_rate": rate("daily_test_error_sum"),
        "error_tests": "daily_test_error_sum",
        "skipped_tests": "daily_test_skipped_sum",
        "DQ_SCORE_CATEGORY": band("DQ_SCORE", s.dq_bands, s.dq_lowest),
        "TRUST_SCORE_CATEGORY": band("TRUST_SCORE", s.trust_bands, s.trust_lowest),
    }


SCORES = ("DQ_SCORE", "TRUST_SCORE")


def _ratio_change(x: str, before: str) -> str:
    up = f"case when {x} > 0 then cast('Infinity' as double) when {x} < 0 then cast('-Infinity' as double) end"
    return f"case when {before} is null then null when {before} = 0 then {up} else nullif({x} / {before} - 1, cast('NaN' as double)) end"


def lags(order: str, s: Settings = SETTINGS) -> Columns:
    out = {}
    for x in SCORES:
        for n in s.lags:
            before = f"lag({x}, {n}) over (order by {order})"
            out |= {f"{x}_lag_{n}d": before, f"{x}_change_{n}d": f"{x} - {before}", f"{x}_pct_change_{n}d": _ratio_change(x, before)}
    return out


def _full(agg: str, x: str, n: int, order: str) -> str:
    w = f"over (order by {order} rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {w} = {n} then {agg}({x}) {w} end"


def rolling(order: str, s: Settings = SETTINGS) -> Columns:
    out = {}
    for x in SCORES:
        for n in s.windows:
            for name, agg in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
                out[f"{x}_rolling_{name}_{n}d"] = _full(agg, x, n, order)
            out[f"{x}_rolling_trend_{n}d"] = f"{x} - {_full('avg', x, n, order)}"
    return out


def momentum(order: str) -> Columns:
    out = {f"{x}_momentum_{n}d": _ratio_change(x, f"lag({x}, {n}) over (order by {order})") for x in SCORES for n in (7, 14)}
    return out | {f"{x}_volatility_{n}d": _full("stddev_samp", x, n, order) for x in SCORES for n in (7, 14)}


def temporal(order: str = "calendar_date", s: Settings = SETTINGS) -> Columns:
    return lags(order, s) | rolling(order, s) | momentum(order)


def misleading(s: Settings = SETTINGS) -> list[str]:
    """Columns that assume regular intervals: lags, rolling statistics, momentum and volatility."""
    kept = ("_change_", "_pct_change_")
    return [c for c in temporal(s=s) if not any(k in c for k in kept)]
