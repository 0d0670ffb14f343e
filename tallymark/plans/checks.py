"""The rules of the event, daily and temporal features in SQL written apart from the engine's expressions.

Flags are comparisons cast to integers, rates are joined from groups instead of windows, lags and rolling statistics
are slices of one ordered list, and bands are looked up in lists of limits: what agrees with the engine does so by its
rule and not by its text.  All names are spelled out here.
"""

from __future__ import annotations

import re

# Fixed values of the checked rules.
_STATUS = {"passed": "pass", "failed": "fail", "error": "error", "skipped": "skipped"}
_CLEAN = "NO_VIOLATIONS"
_NONE = "NOT_APPLICABLE"
_LEVEL = {"high": ("HIGH SEVERITY", 3), "medium": ("MEDIUM SEVERITY", 2), "low": ("LOW SEVERITY", 1)}
_DQ_BANDS = [("CLINICAL_EXCELLENCE", 0.98), ("HIGH_QUALITY", 0.92), ("ACCEPTABLE", 0.80), ("NEEDS_ATTENTION", 0.60), ("UNACCEPTABLE", "-Infinity")]
_TRUST_BANDS = [("EXCELLENT_TRUST", 0.90), ("GOOD_TRUST", 0.75), ("MODERATE_TRUST", 0.50), ("POOR_TRUST", 0.25), ("CRITICAL_RISK", "-Infinity")]
_SCORES = ("DQ_SCORE", "TRUST_SCORE")
_LAGS, _WINDOWS, _TURNS = (1, 3, 7, 14, 30), (7, 14, 30), (7, 14)


def _flag(condition: str) -> str:
    return f"coalesce(({condition})::int, 0)"


def _select(columns: dict[str, str], source: str) -> str:
    return f"select *, {', '.join(f'{e} as {c}' for c, e in columns.items())} from {source}"


def weight(severity: str, otherwise: int) -> str:
    """The weight of a severity, looked up by its place in a list."""
    names, weights = [n for n, _ in _LEVEL.values()], [w for _, w in _LEVEL.values()]
    return f"coalesce({weights}[list_position({names}, {severity})], {otherwise})"


def stages(families: tuple[str, ...]) -> dict[str, str]:
    """``stage0`` to ``stage3`` over the flat events."""
    day = "run_ts::date"
    zero = {
        **{f"test_{n}": _flag(f"status = '{s}'") for n, s in _STATUS.items()},
        "execution_time": "0",
        "records_failed": "0",
        "has_violations": "(status is distinct from 'pass')::int",
        "violation_count": "(status is distinct from 'pass')::int",
        **{p: f"date_part('{p}', {day})::int" for p in ("year", "month", "day", "week", "quarter")},
        "dayofweek": f"isodow({day}) - 1",
        "dayofyear": f"date_part('doy', {day})::int",
        **{f"month_{f}": f"{f}(month({day}) * pi() / 6)" for f in ("sin", "cos")},
        **{f"dayofweek_{f}": f"{f}((isodow({day}) - 1) * pi() / 3.5)" for f in ("sin", "cos")},
        "is_weekend": _flag(f"isodow({day}) in (6, 7)"),
        "is_month_start": _flag(f"{day} = date_trunc('month', {day})"),
        "is_month_end": _flag(f"{day} = last_day({day})"),
        "is_quarter_start": _flag(f"{day} = date_trunc('quarter', {day})"),
        "is_quarter_end": _flag(f"{day} + 1 = date_trunc('quarter', {day} + 1)"),
    }
    # as coded, statuses and families are asked for in words that never occur
    fits = "(status, has_violations) in (('passed', 0), ('failed', 1))"
    sides, fields = ("source", "target"), ("database", "table", "column", "object_level")
    one = {
        **{f"is_{n}": _flag(f"status = '{s}'") for n, s in _STATUS.items()},
        **{f"{f}_{n}": _flag(f"(test_family, status) = ('{f}', '{_STATUS[n]}')") for f in families for n in ("passed", "failed", "error")},
        "status_consistent_with_results": _flag("(status, has_violations) in (('pass', 0), ('fail', 1)) or status in ('error', 'skipped')"),
        "has_no_violations": _flag(f"violation_severity = '{_CLEAN}'"),
        "allocation_passed_clean": _flag(f"(test_family, violation_severity) = ('allocation', '{_CLEAN}')"),
        "uniqueness_passed_clean": _flag(f"(test_family, violation_severity) = ('uniqueness', '{_CLEAN}')"),
        "status_consistent": _flag(fits),
        "clean_result_consistent": _flag(f"(status, violation_severity) = ('passed', '{_CLEAN}')"),
        "status_inconsistent": f"1 - {_flag(fits)}",
        **{f"has_{s}_{f}": f"({s}_{f} is distinct from '{_NONE}')::int" for s in sides for f in fields},
        **{f"has_{s}_object": f"(len(list_filter([{s}_database, {s}_table, {s}_column], lambda v: v is distinct from '{_NONE}')) > 0)::int" for s in sides},
        **{f"is_{f}_test": _flag(f"test_family = '{f}'") for f in ("schema", "allocation", "uniqueness")},
        "requires_source_target": _flag("list_contains(['allocation', 'completeness', 'referential_integrity'], test_family)"),
        "requires_source_only": _flag("list_contains(['uniqueness', 'schema_drift'], test_family)"),
        **{f"is_{k}_severity": _flag(f"violation_severity = '{n}'") for k, (n, _) in _LEVEL.items()},
        "is_no_violations": _flag(f"violation_severity = '{_CLEAN}'"),
        "severity_weight": weight("violation_severity", 0),
        **{f"{f}_{k}_severity": _flag(f"(test_family, violation_severity) = ('{f}', '{n}')") for f in families for k, (n, _) in _LEVEL.items()},
    }
    two = {
        "execution_time_per_record": "if(records_processed > 0, execution_time / records_processed, 0.0)",
        "failure_rate": "if(records_processed > 0, records_failed / records_processed, 0.0)",
        "has_source_and_target": "least(has_source_object, has_target_object)",
        "complexity_score": "has_violations + has_source_object + has_target_object + 2 * least(has_source_object, has_target_object)",
    }
    rates = [f"{f}_{n}" for f in families for n in ("passed", "failed")]
    three = {
        "violations_with_source": "least(has_violations, has_source_object)",
        "violations_with_target": "least(has_violations, has_target_object)",
        "violations_with_both": "least(has_violations, has_source_object, has_target_object)",
        "high_severity_performance_impact": "if(is_high_severity = 1, execution_time, 0)",
        "violation_count_performance_impact": "violation_count * execution_time_per_record",
    }
    means = ", ".join(f"sum({c}) / count(*) as {c}_rate" for c in rates)
    grouped = f"(select run_ts as rate_ts, {means} from stage2 group by run_ts)"
    return {
        "stage0": _select(zero, "flat"),
        "stage1": _select(one, "stage0"),
        "stage2": _select(two, "stage1"),
        "stage3": f"select * exclude (rate_ts) from ({_select(three, 'stage2')}) join {grouped} on run_ts is not distinct from rate_ts",
    }


def intended(source: str) -> str:
    """event_id and the columns whose words are wrong as coded, with the right ones."""
    fits = _flag("(status, has_violations) in (('pass', 0), ('fail', 1))")
    columns = {
        "has_no_violations": _flag(f"violation_severity = '{_CLEAN}'"),
        **{f"{f}_passed_clean": _flag(f"(test_family, violation_severity) = ('{f.upper()}', '{_CLEAN}')") for f in ("allocation", "uniqueness")},
        "status_consistent": fits,
        "clean_result_consistent": _flag(f"(status, violation_severity) = ('pass', '{_CLEAN}')"),
        "status_inconsistent": f"1 - {fits}",
        **{f"is_{f}_test": _flag(f"test_family = '{f.upper()}'") for f in ("schema", "allocation", "uniqueness")},
        "requires_source_target": _flag("list_contains(['ALLOCATION', 'COMPLETENESS', 'REFERENTIAL_INTEGRITY'], test_family)"),
        "requires_source_only": _flag("list_contains(['UNIQUENESS', 'SCHEMA'], test_family)"),
    }
    return f"select event_id, {', '.join(f'{e} as {c}' for c, e in columns.items())} from {source}"


def period(label: str, suffix: str) -> str:
    sums = ("test_passed", "test_failed", "test_error", "has_violations", "violation_count", "execution_time", "records_processed")
    out = [f"round(sum({c})::double, 4) as {c}_sum{suffix}" for c in sums]
    return f"select ({label})::timestamp as label, {', '.join(out)}, round(sum(execution_time) / count(execution_time), 4) as execution_time_mean{suffix} from stage3 group by 1"


def daily(numeric: list[str], doubles: set[str], families: tuple[str, ...]) -> str:
    """Daily aggregates by the names of columns: counts and flags are summed, rates have three statistics, the rest a mean."""

    def put(how: str, c: str) -> str:
        e = f"{how}({c})"
        return f"{e}::bigint" if how == "sum" and c not in doubles else e

    out = {}
    for c in numeric:
        if re.search(r"count|has_|_(passed|failed)$", c) or c in [f"test_{n}" for n in _STATUS]:
            out[f"daily_{c}_sum"] = put("sum", c)
        elif re.search(r"rate|ratio|score", c):
            out |= {f"daily_{c}_{n}": put(how, c) for n, how in (("mean", "avg"), ("max", "max"), ("min", "min"))}
        else:
            out[f"daily_{c}_mean"] = put("avg", c)
    out |= {f"daily_{f}_count": f"count(*) filter (where test_family = '{f}')" for f in families}
    out |= {"daily_total_tests": "count(*)", "execution_time_mean": "round(avg(execution_time), 2)"}
    out |= {f"{c}_sum": f"sum({c})::bigint" for c in ("execution_time", "records_processed")} | {"TRUST_SCORE": trust()}
    return f"select run_ts::date as calendar_date, {', '.join(f'{e} as {c}' for c, e in out.items())} from filled group by 1"


def trust() -> str:
    """Share of the weight that did not fail; failures of no weight at all count against nothing."""
    lost, most = f"sum({weight('violation_severity', 1)}) filter (where status = 'fail')", f"sum({weight('violation_severity', 0)})"
    return f"case sign({most}) when 1 then round(({most} - coalesce({lost}, 0)) / {most}, 4) else if(coalesce({lost}, 0) > 0, -1.0, 1.0) / if(coalesce({lost}, 0) > 0, 0.0, 1.0) end"


def band(score: str, bands: list[tuple[str, float | str]]) -> str:
    limits = "[" + ", ".join(f"{{'name': '{n}', 'low': '{low}'::double}}" for n, low in bands) + "]"
    return f"coalesce(list_filter({limits}, lambda b: not isnan({score}) and {score} >= b.low)[1].name, 'UNKNOWN')"


def bands(source: str) -> dict[str, str]:
    return {"DQ_SCORE_CATEGORY": band(f"{source}DQ_SCORE", _DQ_BANDS), "TRUST_SCORE_CATEGORY": band(f"{source}TRUST_SCORE", _TRUST_BANDS)}


def scored() -> str:
    share = {"pass_rate": "passed", "fail_rate": "failed", "error_rate": "error", "DQ_SCORE": "passed"}
    number = {"passed_tests": "passed", "failed_tests": "failed", "error_tests": "error", "skipped_tests": "skipped"}
    columns = {c: f"daily_test_{n}_sum" for c, n in number.items()} | {c: f"daily_test_{n}_sum / daily_total_tests" for c, n in share.items()}
    return _select(bands(""), f"({_select(columns | {'total_tests': 'daily_total_tests'}, 'daily')})")


def temporal(source: str) -> str:
    """Lags, changes, rolling statistics, momentum and volatility, from slices of the scores in the order of days."""
    lists = ", ".join(f"list({x} order by calendar_date) as all_{x}" for x in _SCORES)
    numbered = f"(select *, (row_number() over (order by calendar_date))::int as i from {source}), (select {lists} from {source})"
    out = {}
    for x in _SCORES:
        v = f"all_{x}"

        def change(n: int) -> str:
            old = f"{v}[i - {n}]"
            # dividing by 0 gives null, so the sign is taken apart; 0 of 0 is nothing
            ratio = f"if({old} = 0, if({x} = 0, null, sign({x}) * 'Infinity'::double), {x} / nullif({old}, 0) - 1)"
            return f"if(i > {n} and {old} is not null, nullif({ratio}, 'NaN'::double), null)"

        def over(n: int, how: str) -> str:
            part = f"{v}[i - {n - 1}:i]"
            return f"if(i >= {n} and len(list_filter({part}, lambda y: y is not null)) = {n}, list_aggregate({part}, '{how}'), null)"

        for n in _LAGS:
            old = f"if(i > {n}, {v}[i - {n}], null)"
            out |= {f"{x}_lag_{n}d": old, f"{x}_change_{n}d": f"{x} - {old}", f"{x}_pct_change_{n}d": change(n)}
        for n in _WINDOWS:
            out |= {f"{x}_rolling_{name}_{n}d": over(n, how) for name, how in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))}
            out[f"{x}_rolling_trend_{n}d"] = f"{x} - {over(n, 'avg')}"
        for n in _TURNS:
            out |= {f"{x}_momentum_{n}d": change(n), f"{x}_volatility_{n}d": over(n, "stddev_samp")}
    return f"select * exclude (i, {', '.join(f'all_{x}' for x in _SCORES)}) from ({_select(out, numbered)})"
