"""DuckDB SQL of the same results, built from common table expressions.

Each name in ``CTES`` is a relation and what it is made from; ``sql(select)`` puts before a SELECT
exactly those that it needs.
"""

from __future__ import annotations

import re

from tallymark.functions import features
from tallymark.functions.classify import CATEGORY_RULES, FAMILY_RULES, ROUTES
from tallymark.plans import checks
from tallymark.schema import FAMILIES, NO_VIOLATIONS, NOT_APPLICABLE, NUMERIC_METRICS, SETTINGS
from tallymark.sources.test_results import SILENT_DAYS, derived_sql

def _chain(rules, otherwise: str) -> str:
    return "case" + "".join(f" when contains(lower(NAME_OF_TEST), '{a}') then '{b}'" for a, b in rules) + f" else '{otherwise}' end"


def _routes() -> str:
    out = "case"
    for family, rules in ROUTES.items():
        for part, name in rules:
            out += f" when TEST_FAMILY = '{family}' and contains(trim(upper(NAME_OF_TEST)), '{part}') then '{name}'"
    return out + " end"


def _x(text: str, pattern: str, group: int = 1, flags: str = "") -> str:
    f = f", '{flags}'" if flags else ""
    return f"nullif(regexp_extract({text}, '{pattern}', {group}{f}), '')"


def _n(text: str, pattern: str, flags: str = "") -> str:
    return f"cast({_x(text, pattern, 1, flags)} as bigint)"


def _on(routes: str, expression: str) -> str:
    names = ", ".join(f"'{r}'" for r in routes.split())
    return f"case when route in ({names}) then {expression} end"


def _context(side: str) -> str:
    d, s, t, c = (f"{side}_{x}" for x in ("DATABASE", "SCHEMA", "TABLE", "COLUMN"))
    given = lambda x: f"case when trim({x}) <> '' and {x} <> 'nan' then {x} end"
    truthy = lambda x: f"({x} is null or {x} <> '')"
    low = side.lower()
    return (
        f"case when {truthy(c)} then 'column' when {truthy(t)} then 'table' when {truthy(s)} then 'schema' else 'database' end as {low}_level, "
        f"nullif(concat_ws('.', {given(d)}, {given(s)}, {given(t)}), '') as {low}_name"
    )


_UNGLUED = r"regexp_replace(t, '(org_code\s*:\s*[A-Z0-9_]+)([A-Za-z])', '\1 \2', 'gi')"
_MIS = r"misallocated\s+records\s*:\s*(\d+)"


def _positions(text: str) -> str:
    """name -> position of a list without repeated names."""
    parts = f"list_filter(string_split(coalesce({text}, ''), ','), lambda p: contains(p, ':'))"
    return f"map_from_entries(list_transform({parts}, lambda p: row(trim(split_part(p, ':', 1)), cast(trim(split_part(p, ':', 2)) as int))))"


def _types(text: str) -> str:
    parts = f"list_filter(string_split(coalesce({text}, ''), ','), lambda p: contains(p, ':'))"
    return f"map_from_entries(list_transform({parts}, lambda p: row(upper(trim(split_part(p, ':', 1))), upper(trim(split_part(p, ':', 2))))))"


def _minus(a: str, b: str) -> str:
    return f"list_filter(map_keys({a}), lambda k: not list_contains(map_keys({b}), k))"


def _moved(a: str, b: str) -> str:
    return f"list_filter(map_keys({a}), lambda k: list_contains(map_keys({b}), k) and {a}[k] is distinct from {b}[k])"


def _parsed() -> str:
    hashes = {
        "table_count": (r"curr_hash\s*=\s*([A-Za-z0-9]+)", r"prev_hash\s*=\s*([A-Za-z0-9]+)", ""),
        "column_count": (r"curr_col_count\s*=\s*\d+\s+hash=([A-Za-z0-9]+)", r"prev_col_count\s*=\s*\d+\s+hash=([A-Za-z0-9]+)", ""),
        "column_names": (r"curr_col_names.*?hash\s*=\s*([A-Za-z0-9]+)", r"prev_col_names.*?hash\s*=\s*([A-Za-z0-9]+)", "i"),
        "column_position": (r"curr_col_pos=.*?hash=([A-Za-z0-9]+)", r"prev_col_pos=.*?hash=([A-Za-z0-9]+)", ""),
    }
    block = r"{}_col_datatypes=(.+?)hash=([0-9a-f]{{32}})"

    def side_hash(i: int) -> str:
        cases = "".join(f" when '{k}' then {_x('r', v[i], 1, v[2])}" for k, v in hashes.items())
        return f"case route{cases} when 'datatypes' then {_x('r', block.format(('curr', 'prev')[i]), 2, 'is')} end"

    names = {s: _x("r", s + r"_col_names\s*=\s*(.*?)\s*hash=", 1, "i") for s in ("curr", "prev")}
    places = {s: _x("r", s + r"_col_pos\s*=\s*(.*?)\s*hash=") for s in ("curr", "prev")}
    kinds = {s: _x("r", block.format(s), 1, "is") for s in ("curr", "prev")}
    first = f"""
      select *, {_routes()} as route, coalesce(TEST_RESULT, 'nan') as r, replace(trim(coalesce(TEST_RESULT, 'nan')), chr(10), ' ') as t from classified"""
    second = rf"""
      select *, {_UNGLUED} as u,
        contains(lower(t), 'unallocated_records') as signal,
        lower(t) in ('0', '0.0', 'none', '') or regexp_matches(lower(t), 'misallocated\s+records\s*:\s*0\b') as zero,
        {_on('unallocated', _n('t', 'unallocated_records' + chr(92) + r's*:\s*(\d+)', 'i'))} as unallocated_records,
        {_on('allocated', _n(_UNGLUED, r'curr_alloc_count\s*=\s*(\d+)', 'i'))} as curr_alloc_count,
        {_on('allocated', _n(_UNGLUED, r'prev_alloc_count\s*=\s*(\d+)', 'i'))} as prev_alloc_count,
        {_on('completeness', f"try_cast({_x('t', '([0-9]*[.]?[0-9]+)')} as double)")} as completeness_ratio,
        {_on('duplicates', "cast(trunc(try_cast(t as double)) as bigint)")} as duplicate_count,
        {_on('referential', _n('r', r'(\d+)'))} as broken_fk_count,
        {_on('person', _n('t', r'count_person_id\s*:\s*(\d+)', 'i'))} as count_person_id,
        {_on('person', _n('t', r'count_distinct_person_id\s*:\s*(\d+)', 'i'))} as count_distinct_person_id,
        {_on('table_count', _n('r', r'curr_tbl_count\s*=\s*(\d+)'))} as curr_tbl_count,
        {_on('table_count', _n('r', r'prev_tbl_count\s*=\s*(\d+)'))} as prev_tbl_count,
        {_on('column_count', _n('r', r'curr_col_count\s*=\s*(\d+)'))} as curr_col_count,
        {_on('column_count', _n('r', r'prev_col_count\s*=\s*(\d+)'))} as prev_col_count,
        {side_hash(0)} as curr_hash, {side_hash(1)} as prev_hash,
        {_on('column_names', _positions(names['curr']))} as curr_columns, {_on('column_names', _positions(names['prev']))} as prev_columns,
        {_on('column_position', _positions(places['curr']))} as curr_positions, {_on('column_position', _positions(places['prev']))} as prev_positions,
        {_on('datatypes', _types(kinds['curr']))} as curr_types, {_on('datatypes', _types(kinds['prev']))} as prev_types
      from ({first})"""
    third = rf"""
      select *,
        {_on('misallocated', f"case when not zero then {_n('u', _MIS, 'i')} end")} as misallocated_records,
        case route when 'column_names' then list_sort({_minus('curr_columns', 'prev_columns')}) when 'column_position' then {_minus('curr_positions', 'prev_positions')}
          when 'datatypes' then {_minus('curr_types', 'prev_types')} end as columns_added,
        case route when 'column_names' then list_sort({_minus('prev_columns', 'curr_columns')}) when 'column_position' then {_minus('prev_positions', 'curr_positions')}
          when 'datatypes' then {_minus('prev_types', 'curr_types')} end as columns_removed,
        {_on('column_names', _moved('curr_columns', 'prev_columns'))} as moved_names,
        {_on('column_position', _moved('curr_positions', 'prev_positions'))} as columns_moved,
        {_on('datatypes', _moved('curr_types', 'prev_types'))} as moved_types,
        {_on('column_names', "list_filter(map_keys(curr_columns), lambda c: len(list_filter(map_keys(prev_columns), lambda p: lower(p) = lower(c) and p <> c)) > 0)")} as case_names
      from ({second})"""
    mismatch = "case when curr_hash <> prev_hash then 1 else 0 end"
    status = """
        case route
          when 'unallocated' then case when not signal then 'pass' when unallocated_records > 0 then 'fail' when unallocated_records = 0 then 'pass' else 'unknown' end
          when 'misallocated' then case when zero then 'pass' when misallocated_records > 0 then 'fail' when misallocated_records = 0 then 'pass' else 'unknown' end
          when 'allocated' then case when curr_alloc_count is null or prev_alloc_count is null then 'unknown' when curr_alloc_count >= prev_alloc_count then 'pass' else 'fail' end
          when 'completeness' then case when completeness_ratio is null then 'unknown' when completeness_ratio >= 1 then 'pass' else 'fail' end
          when 'duplicates' then case when duplicate_count is null then 'unknown' when duplicate_count = 0 then 'pass' else 'fail' end
          when 'referential' then case when broken_fk_count is null then 'unknown' when broken_fk_count = 0 then 'pass' else 'fail' end
          when 'person' then case when count_person_id is null or count_distinct_person_id is null then 'unknown' when count_person_id >= count_distinct_person_id then 'pass' else 'fail' end
          when 'sensitive' then case when r = '' then 'unknown' when lower(t) = 'no sensitive codes found' then 'pass' else 'fail' end
          when 'table_count' then case when curr_tbl_count is not distinct from prev_tbl_count and curr_hash is not distinct from prev_hash then 'pass' else 'fail' end
          when 'column_count' then case when curr_col_count is not distinct from prev_col_count and curr_hash is not distinct from prev_hash then 'pass' else 'fail' end
          when 'column_names' then case when curr_hash is not distinct from prev_hash and len(columns_added) + len(columns_removed) + len(moved_names) = 0 then 'pass' else 'fail' end
          when 'column_position' then case when curr_hash is not distinct from prev_hash then 'pass' else 'fail' end
          when 'datatypes' then case when curr_hash is null or prev_hash is null then 'unknown'
            when len(columns_added) + len(columns_removed) + len(moved_types) = 0 then 'pass' else 'fail' end
        end"""
    org = r"org_code\s*:\s*([A-Z0-9_]+)"
    return rf"""
      select *, {status} as status,
        case when route is not null then TEST_CATEGORY end as event_category,
        route is not null and not (route = 'duplicates' and duplicate_count is null) and not (route = 'datatypes' and (curr_hash is null or prev_hash is null)) as has_objects,
        case route when 'unallocated' then {_n('t', r'number_of_medical_units\s*:\s*(\d+)', 'i')}
          when 'misallocated' then case when not zero then {_n('u', r'number_of_medical_units\s*:\s*(\d+)', 'i')} end end as number_of_medical_units,
        curr_alloc_count - prev_alloc_count as alloc_diff,
        case when completeness_ratio >= 1 then 1 when completeness_ratio < 1 then 0 end as is_complete,
        case when duplicate_count > 0 then 1 when duplicate_count <= 0 then 0 end as has_duplicates,
        case when count_person_id < count_distinct_person_id then count_distinct_person_id - count_person_id end as violation_amount,
        {_on('sensitive', "case when r = '' then null when lower(t) = 'no sensitive codes found' then 0 else 1 end")} as sensitive_flag,
        {_on('sensitive', "case when r <> '' and lower(t) <> 'no sensitive codes found' then r end")} as reported_sensitive_content,
        abs(curr_tbl_count - prev_tbl_count) as count_diff,
        {_on('table_count column_count column_position', mismatch)} as hash_mismatch,
        curr_col_count - prev_col_count as column_diff,
        {_on('column_position', 'cast(len(columns_added) as int)')} as count_added,
        {_on('column_position', 'cast(len(columns_removed) as int)')} as count_removed,
        {_on('column_position', 'cast(len(columns_moved) as int)')} as count_moved,
        case when curr_col_count - prev_col_count is not null then greatest(curr_col_count - prev_col_count, 0) end as columns_added_n,
        case when curr_col_count - prev_col_count is not null then greatest(prev_col_count - curr_col_count, 0) end as columns_removed_n,
        case route when 'unallocated' then case when signal then {_x('t', r'org_code\s*:\s*([A-Z0-9_]+?)(?:for\s+table\s*:|[^A-Z0-9_]|$)', 1, 'i')} end
          when 'allocated' then {_x('u', org, 1, 'i')} when 'person' then upper({_x('t', r'(?:org_code:)?(ORG_[0-9]+)', 1, 'i')}) end as org_code,
        {_on('misallocated', f"case when not zero then {_x('u', 'misallocated' + chr(92) + 's+' + org, 1, 'i')} end")} as misallocated_org_code,
        {_on('misallocated', f"case when not zero then {_x('u', 'owner' + chr(92) + 's+' + org, 1, 'i')} end")} as owner_org_code,
        {_on('unallocated', f"case when signal then upper({_x('t', 'for' + chr(92) + r's+table\s*:\s*([A-Za-z0-9_]+)', 1, 'i')}) end")} as object_table,
        {_context('SOURCE')}, {_context('TARGET')}
      from ({third})"""


def _flat() -> str:
    sides = []
    for s in ("source", "target"):
        up = s.upper()
        na = lambda x: f"case when has_objects then {x} else '{NOT_APPLICABLE}' end"
        sides += [
            f"{na(f'{up}_DATABASE')} as {s}_database",
            f"{na(f'{up}_TABLE')} as {s}_table",
            f"""{na(f"coalesce({up}_COLUMN, '{NOT_APPLICABLE}')")} as {s}_column""",
            f"{na(f'{s}_level')} as {s}_object_level",
        ]
    return f"""
      select EVENT_ID as event_id, RUN_TIMESTAMP as run_ts, status, TEST_FAMILY as test_family, event_category as test_category,
        case when event_category = 'ALLOCATION_ALLOCATED' then curr_alloc_count else 0 end as records_processed,
        case when SEVERITY_LEVEL = '' then case when status = 'pass' then '{NO_VIOLATIONS}' else 'HIGH SEVERITY' end else SEVERITY_LEVEL end as violation_severity,
        {', '.join(sides)}, {', '.join(f'{m} as metric_{m}' for m in NUMERIC_METRICS)}
      from parsed"""


_WEEK = "cast(date_trunc('week', run_ts) as date) + 6"
_MONTH = "last_day(run_ts)"


def _fill() -> str:
    text = ("status", "violation_severity")
    value = lambda c: f"""coalesce(last_value({c} ignore nulls) over (order by event_id rows unbounded preceding), {"'0'" if c in text else 0})"""
    return "select * replace (" + ", ".join(f"{value(c)} as {c}" for c in features.filled()) + ") from joined"


#: Numeric event columns that are not whole.
DOUBLES = {
    *(c for c in features.numeric() if c.endswith(("_sin", "_cos", "_rate", "_impact", "_per_record"))), *features.period(""), *features.period("_monthly"), "metric_completeness_ratio",
}


def _more(columns: features.Columns, source: str, *extra: str) -> str:
    return "select *, " + ", ".join([*extra, *(f"{e} as {c}" for c, e in columns.items())]) + f" from {source}"


_D = "calendar_date"
_SINCE = f"coalesce({_D} - lag({_D}) over (order by {_D}), 0)"


def trend_columns() -> features.Columns:
    out = {}
    for x in features.SCORES:
        change = f"{x} - lag({x}) over (order by {_D})"
        out[f"{x}_absolute_change"] = change
        out[f"{x}_daily_rate"] = f"case when days_since_last_measurement > 0 then coalesce(({change}) / days_since_last_measurement, 0) else 0 end"
    return out


def frequency_columns() -> features.Columns:
    out = {
        f"measurements_last_{n}d": f"count(*) over (order by {_D} range between interval {n - 1} day preceding and current row)" for n in SETTINGS.horizons
    }
    w = f"over (order by {_D} rows between 4 preceding and current row)"
    x = "days_since_last_measurement"
    out["measurement_regularity"] = f"case when count({x}) {w} = 5 then 1 / (1 + var_samp({x}) {w}) else 0 end"
    return out


GAPS = {
    "days_to_next_measurement": f"coalesce(lead({_D}) over (order by {_D}) - {_D}, avg(days_since_last_measurement) over ())",
    "is_long_gap": "case when days_since_last_measurement > 7 then 1 else 0 end",
    "gap_severity": "case when days_since_last_measurement <= 1 then 0 when days_since_last_measurement <= 7 then 1 else 2 end",
}


def finite(c: str) -> str:
    return f"case when not isnan({c}) and not isinf({c}) then {c} end"


def cleaned(c: str, source: str = _D) -> str:
    x = finite(c)
    return (
        f"coalesce(last_value({x} ignore nulls) over (order by {source} rows unbounded preceding), "
        f"first_value({x} ignore nulls) over (order by {source} rows between current row and unbounded following), 0)"
    )


def back(c: str, source: str = _D) -> str:
    return f"coalesce(first_value(case when not isnan({c}) then {c} end ignore nulls) over (order by {source} rows between current row and unbounded following), 0)"


CATEGORIES = ("DQ_SCORE_CATEGORY", "TRUST_SCORE_CATEGORY")
#: Numeric columns of the standard table.
STANDARD = [*features.daily(features.numeric()), *features.SCORES, *(c for c in features.scores() if c not in CATEGORIES), *features.temporal()]


def _irregular() -> dict[str, str]:
    """The gap-aware table from the standard one, stage by stage; the columns of its last stage are ``IRREGULAR``."""
    lost = {f"{x}_{kind}_{n}d" for x in features.SCORES for kind in ("lag",) for n in SETTINGS.lags}
    lost |= {f"{x}_rolling_{kind}_{n}d" for x in features.SCORES for kind in ("mean", "std", "min", "max", "trend") for n in SETTINGS.windows}
    lost |= {f"{x}_{kind}_{n}d" for x in features.SCORES for kind in ("momentum", "volatility") for n in (7, 14)}
    kept = [c for c in STANDARD if c not in lost] + ["days_to_next_measurement"]
    whole_gaps = ["days_since_last_measurement", "is_long_gap", "gap_severity"]
    out = {"standard": f"select calendar_date, {', '.join(CATEGORIES)}, {', '.join(f'{back(c)} as {c}' for c in STANDARD)} from ({checks.temporal('scored')})"}
    out["standard_gaps"] = f"select s.*, {', '.join(f'{e} as {n}' for n, e in GAPS.items())} from (select *, {_SINCE} as days_since_last_measurement from standard) s"

    def repaired(c: str) -> str:
        new = re.sub(r"_pct_change_(\d|1\d)d$", r"_pct_change_lag_\1obs", c)
        value = "1000.0" if "pct_change" in c else f"median(case when not isinf({c}) then {c} end) over ()"
        return f"case when isinf({c}) then {value} else {c} end as {new}"

    out["repaired"] = f"select calendar_date, {', '.join([*CATEGORIES, *whole_gaps])}, {', '.join(map(repaired, kept))} from standard_gaps"
    more = trend_columns() | frequency_columns()
    out["irregular"] = f"select *, {', '.join(f'{e} as {n}' for n, e in more.items())} from repaired"
    names = [re.search(r" as (\w+)$", repaired(c))[1] for c in kept]
    IRREGULAR.extend([*whole_gaps, *names, *more])
    return out


IRREGULAR: list[str] = []


#: Columns of the tree queries: those of the long series that are never infinite.
TREE_COLUMNS = [*features.SCORES, *(c for c in features.temporal() if "pct_change" not in c and "momentum" not in c)]


def _best(cells: str) -> str:
    """The split of each node that removes most of the squared error of y, with both sides' numbers and sums."""
    return f"""
      select node, f, (v + nv) / 2 as cut, gain, nl, sl, nt - nl as nr, st - sl as sr from (
        select *, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt as gain from (
          select node, f, v, lead(v) over upto as nv, sum(n) over upto as nl, sum(s) over upto as sl, sum(n) over whole as nt, sum(s) over whole as st
          from (select node, f, v, count(*) as n, sum(y) as s from ({cells}) group by all)
          window upto as (partition by node, f order by v), whole as (partition by node, f))
        where nv is not null and nl >= 2 and nt - nl >= 2)
      where gain > 1e-12 qualify row_number() over (partition by node order by round(gain, 9) desc, f, v) = 1"""


def _side(table: str) -> str:
    """The node of the second level that a row's cells of the split column put it in."""
    return f"select c.calendar_date, case when c.v <= b.cut then 2 else 3 end as node from {table} c join best1 b on c.f = b.f"


#: A tree of two levels over the long series, with leaves of two rows or more.
TREE = {
    "frame": f"select calendar_date, lead(DQ_SCORE) over (order by calendar_date) as label, * exclude (calendar_date) from (select calendar_date, {', '.join(f'coalesce(round({c}, 6), 0) as {c}' for c in TREE_COLUMNS)} from lagged)",
    "taught": "select calendar_date, label - (select avg(label) from frame) as y, * exclude (calendar_date, label) from frame where label is not null",
    "places": f"select unnest(range({len(TREE_COLUMNS)})) as f, unnest([{', '.join(repr(c) for c in TREE_COLUMNS)}]) as name",
    "cells": f"select calendar_date, y, f, v from ((select * from taught) unpivot (v for name in ({', '.join(TREE_COLUMNS)}))) join places using (name)",
    "served": f"select calendar_date, f, v from ((select * from frame) unpivot (v for name in ({', '.join(TREE_COLUMNS)}))) join places using (name)",
    "best1": _best("select 1 as node, f, v, y from cells"),
    "best2": _best(f"select s.node, c.f, c.v, c.y from cells c join ({_side('cells')}) s using (calendar_date)"),
    "splits": "select b.*, p.name as feature from (select * from best1 union all select * from best2) b join places p using (f)",
}

CTES: dict[str, str] = {
    "raw": f"select {', '.join(derived_sql(chr(106) + 'son_extract_string(props, ' + chr(39) + '$.k' + chr(39) + ')'))} from events where day(ts) not in ({', '.join(map(str, SILENT_DAYS))})",
    "classified": f"select * exclude (STATUS), {_chain(CATEGORY_RULES, 'OTHER')} as TEST_CATEGORY, {_chain(FAMILY_RULES, 'OTHER')} as TEST_FAMILY from raw",
    "parsed": _parsed(),
    "flat": _flat(),
    **checks.stages(FAMILIES),
    "weekly": checks.period(_WEEK, ""),
    "monthly": checks.period(_MONTH, "_monthly"),
    "joined": "select e.*, w.* exclude (label), m.* exclude (label) from stage3 e left join weekly w on e.run_ts = w.label left join monthly m on e.run_ts = m.label",
    "filled": _fill(),
    "daily": checks.daily(features.numeric(), DOUBLES, FAMILIES),
    "scored": checks.scored(),
    "scores": "select calendar_date, DQ_SCORE, TRUST_SCORE from scored",
    "series": "select cast(o_orderdate as date) as calendar_date, avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) as DQ_SCORE, "
    "avg(case when o_orderpriority like '1%' or o_orderpriority like '2%' then 1.0 else 0.0 end) as TRUST_SCORE from orders group by 1",
    "lagged": checks.temporal("series"),
    **TREE,
    **_irregular(),
    "gapped": _more(GAPS, f"(select *, {_SINCE} as days_since_last_measurement from series)"),
}


def sql(select: str) -> str:
    """The SELECT with the relations that it needs before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(select)
    head = ", ".join(f"{n} as ({CTES[n]})" for n in needed)
    return f"with {head} {select}" if needed else select


__all__ = ["CTES", "FAMILIES", "sql"]
