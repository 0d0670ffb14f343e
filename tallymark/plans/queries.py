"""All queries of the engine by name, each with DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import classify, features
from tallymark.functions.parse import PARSERS, parse_events
from tallymark.operators import daily, encode, events, forecast, irregular, profile, temporal, trees
from tallymark.operators.stored import publish, published, shared_path, stored
from tallymark.plans import checks, oracle, reports
from tallymark.plans.oracle import sql
from tallymark.plans.pipeline import events_to_daily, irregular_table, standard
from tallymark.schema import FAMILIES, NUMERIC_METRICS
from tallymark.sources.test_results import derived_results, latest_sorted, load_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, select: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if select is not None:
            SQL[name] = sql(select)
        return f

    return put


def _r(*columns: str, digits: int = 6) -> str:
    """Columns rounded, in SQL of both engines."""
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns)


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return derived_results(spark, sf)


def parsed(spark: SparkSession, sf: str, *parsers: str) -> DataFrame:
    return parse_events(raw(spark, sf), parsers=parsers or None)


def flat(spark: SparkSession, sf: str) -> DataFrame:
    return events.flatten(parsed(spark, sf))


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    return events.statuses(raw(spark, sf))


def featured(spark: SparkSession, sf: str) -> DataFrame:
    return events.event_features(flat(spark, sf))


def engineered(spark: SparkSession, sf: str) -> DataFrame:
    return events.engineer(parsed(spark, sf))


def short(spark: SparkSession, sf: str) -> DataFrame:
    """The daily scores of the derived log: 19 days a month.

    The trust score reads statuses carried forward, the pass rate those of the rows themselves.
    """
    own = stored(statuses(spark, sf).withColumn("own_status", F.col("status")), "statuses")
    filled = events.fill_forward(own, ["status", "violation_severity"])
    return filled.groupBy(F.to_date("run_ts").alias("calendar_date")).agg(
        (F.count_if(F.col("own_status") == "pass") / F.count("*")).alias("DQ_SCORE"), F.expr(features.trust()).alias("TRUST_SCORE"), F.count("*").alias("total_tests")
    )


def series(spark: SparkSession, sf: str) -> DataFrame:
    """A long daily series with two scores, from orders."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    urgent = F.col("o_orderpriority").like("1%") | F.col("o_orderpriority").like("2%")
    return orders.groupBy(F.to_date("o_orderdate").alias("calendar_date")).agg(
        share(F.col("o_orderstatus") == "F").alias("DQ_SCORE"), share(urgent).alias("TRUST_SCORE")
    )


# --- sources ---------------------------------------------------------------------------------------------------

_RAW = "EVENT_ID, TEST_RUN_ID, NAME_OF_TEST, SOURCE_DATABASE, SOURCE_SCHEMA, SOURCE_TABLE, SOURCE_COLUMN, TARGET_DATABASE, TEST_RESULT, SEVERITY_LEVEL, RUN_TIMESTAMP, IS_LATEST"


@query("io1_read_raw", f"select {_RAW} from raw")
def io1(spark, sf):
    return raw(spark, sf).select(*_RAW.split(", "))


_HOUR = "hour(RUN_TIMESTAMP)"


@query(
    "io2_load_events",
    f"""select EVENT_ID, {_HOUR}::int as hour, minute(RUN_TIMESTAMP)::int as minute, second(RUN_TIMESTAMP)::int as second, (isodow(RUN_TIMESTAMP) - 1)::int as day_of_week,
      round(sin(2 * pi() * {_HOUR} / 24), 6) + 0 as hour_sin, round(cos(2 * pi() * {_HOUR} / 24), 6) + 0 as hour_cos,
      round({_HOUR} + minute(RUN_TIMESTAMP) / 60 + second(RUN_TIMESTAMP) / 3600, 6) as time_of_day,
      ({_HOUR} between 6 and 11)::int as is_morning, ({_HOUR} between 12 and 17)::int as is_afternoon, ({_HOUR} between 18 and 21)::int as is_evening,
      ({_HOUR} >= 22 or {_HOUR} < 6)::int as is_night, ({_HOUR} between 9 and 16 and isodow(RUN_TIMESTAMP) < 6)::int as is_business_hours,
      RUN_TIMESTAMP::date as date from raw where RUN_TIMESTAMP is not null""",
)
def io2(spark, sf):
    rows = load_events(raw(spark, sf))
    names = "minute second day_of_week is_morning is_afternoon is_evening is_night is_business_hours date".split()
    return rows.select("EVENT_ID", "hour", *names, *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("hour_sin", "hour_cos", "time_of_day")])


@query("io3_date_fallback", "select EVENT_ID, try_cast(case when EVENT_ID % 5 = 0 then 'bad' else cast(RUN_TIMESTAMP::date as varchar) end as date) as date from raw where EVENT_ID % 5 <> 0")
def io3(spark, sf):
    text = F.when(F.col("EVENT_ID") % 5 == 0, "bad").otherwise(F.to_date("RUN_TIMESTAMP").cast("string"))
    return load_events(raw(spark, sf).select("EVENT_ID", text.alias("date"))).select("EVENT_ID", "date")


@query("io4_synthetic_dates", "select l_orderkey, l_linenumber, date '2024-01-01' + (row_number() over (order by l_orderkey, l_linenumber) - 1)::int as date from lineitem")
def io4(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    return load_events(spark.read.parquet(f"{sf}/lineitem.parquet").select(*keys), order=keys).select(*keys, "date")


@query("io5_read_daily", f"select calendar_date, {_r('DQ_SCORE', 'TRUST_SCORE')} from series")
def io5(spark, sf):
    return series(spark, sf).select("calendar_date", F.round("DQ_SCORE", 6).alias("DQ_SCORE"), F.round("TRUST_SCORE", 6).alias("TRUST_SCORE"))


@query("io12_sorted_daily", f"select calendar_date, {_r('DQ_SCORE')} from series order by calendar_date")
def io12(spark, sf):
    return latest_sorted(series(spark, sf).select("calendar_date", F.round("DQ_SCORE", 6).alias("DQ_SCORE")))


# --- classification --------------------------------------------------------------------------------------------


@query("cl1_category", "select EVENT_ID, TEST_CATEGORY from classified")
def cl1(spark, sf):
    return raw(spark, sf).select("EVENT_ID", classify.category(F.col("NAME_OF_TEST")).alias("TEST_CATEGORY"))


@query("cl2_family", "select EVENT_ID, TEST_FAMILY from classified")
def cl2(spark, sf):
    return raw(spark, sf).select("EVENT_ID", classify.family(F.col("NAME_OF_TEST")).alias("TEST_FAMILY"))


@query("cl3_parse_events", "select EVENT_ID, TEST_FAMILY as test_family, event_category as test_category, status, case when route is not null then r end as original_test from parsed")
def cl3(spark, sf):
    e = F.col("DQ_EVENT")
    return parsed(spark, sf).select("EVENT_ID", e["test_family"].alias("test_family"), e["test_category"].alias("test_category"), "STATUS", e["raw"]["original_test"].alias("original_test")).withColumnRenamed("STATUS", "status")


@query("cl4_empty_event", "select EVENT_ID, TEST_FAMILY as test_family, status, event_category as test_category from parsed where TEST_FAMILY = 'OTHER'")
def cl4(spark, sf):
    e = F.col("DQ_EVENT")
    return parsed(spark, sf).where("TEST_FAMILY = 'OTHER'").select("EVENT_ID", e["test_family"].alias("test_family"), e["status"].alias("status"), e["test_category"].alias("test_category"))


def _context(spark, sf, side):
    parts = [F.col(f"{side.upper()}_{c}") for c in ("DATABASE", "SCHEMA", "TABLE", "COLUMN")]
    rows = raw(spark, sf).withColumn("c", classify.context(*parts))
    return rows.select("EVENT_ID", F.col("c.object_level").alias(f"{side}_level"), F.col("c.fully_qualified_name").alias(f"{side}_name"))


@query("cl5_source_context", "select EVENT_ID, source_level, source_name from parsed")
def cl5(spark, sf):
    return _context(spark, sf, "source")


@query("cl6_target_context", "select EVENT_ID, target_level, target_name from parsed")
def cl6(spark, sf):
    return _context(spark, sf, "target")


# --- parsers ---------------------------------------------------------------------------------------------------

#: name -> (parser, metrics, further columns as (name, path in the event))
_PARSER_QUERIES = {
    "pa1_unallocated": ("unallocated", "unallocated_records number_of_medical_units", {"org_code": "entities.org_code", "object_table": "objects.table"}),
    "pa2_misallocated": ("misallocated", "misallocated_records number_of_medical_units", {c: f"entities.{c}" for c in ("misallocated_org_code", "owner_org_code")}),
    "pa3_allocated": ("allocated", "curr_alloc_count prev_alloc_count alloc_diff", {"org_code": "entities.org_code"}),
    "pa4_completeness": ("completeness", "completeness_ratio is_complete", {}),
    "pa5_duplicates": ("duplicates", "duplicate_count has_duplicates", {}),
    "pa6_referential": ("referential", "broken_fk_count", {}),
    "pa7_person": ("person", "count_person_id count_distinct_person_id violation_amount", {"org_code": "entities.org_code"}),
    "pa8_sensitive": ("sensitive", "sensitive_flag", {"reported_sensitive_content": "structure.reported_sensitive_content"}),
    "pa9_table_count": ("table_count", "curr_tbl_count prev_tbl_count count_diff hash_mismatch curr_hash prev_hash", {}),
    "pa10_column_count": ("column_count", "curr_col_count prev_col_count column_diff columns_added_n columns_removed_n hash_mismatch curr_hash prev_hash", {}),
    "pa15_column_position": ("column_position", "count_added count_removed count_moved hash_mismatch curr_hash prev_hash", {}),
}


def _parser_query(name: str, parser: str, metrics: str, more: dict[str, str]) -> None:
    names = metrics.split()

    @query(name, f"select EVENT_ID, status, {', '.join([*names, *more])} from parsed where route = '{parser}'")
    def one(spark, sf):
        rows = parsed(spark, sf, parser)
        e = F.col("DQ_EVENT")
        columns = [F.col(f"DQ_EVENT.metrics.{m}").alias(m) for m in names] + [F.col(f"DQ_EVENT.{p}").alias(c) for c, p in more.items()]
        return rows.select("EVENT_ID", e["status"].alias("status"), *columns)


for _name, _how in _PARSER_QUERIES.items():
    _parser_query(_name, *_how)


def _list(c: str) -> str:
    return f"array_to_string(list_sort({c}), ',')"


def _text(c):
    return F.array_join(F.array_sort(c), ",")


@query(
    "pa11_column_names",
    f"select EVENT_ID, status, {_list('columns_added')} as added, {_list('columns_removed')} as removed, {_list('moved_names')} as moved, {_list('case_names')} as cases, curr_hash, prev_hash from parsed where route = 'column_names'",
)
def pa11(spark, sf):
    rows, m = parsed(spark, sf, "column_names"), "DQ_EVENT.metrics."
    return rows.select(
        "EVENT_ID",
        F.col("STATUS").alias("status"),
        _text(F.col(m + "columns_added")).alias("added"),
        _text(F.col(m + "columns_removed")).alias("removed"),
        _text(F.map_keys(m + "changed_positions")).alias("moved"),
        _text(F.map_keys(m + "case_mismatches")).alias("cases"),
        F.col(m + "curr_hash").alias("curr_hash"),
        F.col(m + "prev_hash").alias("prev_hash"),
    )


def _pairs(c: str) -> str:
    return f"array_to_string(list_sort(list_transform(map_entries({c}), lambda e: e.key || ':' || e.value)), ',')"


def _pairs_text(c):
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ",")


def _structure_query(name: str, parser: str, curr: str, prev: str) -> None:
    @query(name, f"select EVENT_ID, {_pairs(curr)} as curr, {_pairs(prev)} as prev from parsed where route = '{parser}'")
    def one(spark, sf):
        rows = parsed(spark, sf, parser)
        return rows.select("EVENT_ID", _pairs_text(F.col(f"DQ_EVENT.structure.{curr}")).alias("curr"), _pairs_text(F.col(f"DQ_EVENT.structure.{prev}")).alias("prev"))


_structure_query("pa12_column_list", "column_names", "curr_columns", "prev_columns")
_structure_query("pa14_datatype_list", "datatypes", "curr_types", "prev_types")
_structure_query("pa16_positions", "column_position", "curr_positions", "prev_positions")


@query(
    "pa13_datatypes",
    f"select EVENT_ID, status, {_list('columns_added')} as added, {_list('columns_removed')} as removed, {_list('moved_types')} as changed, curr_hash, prev_hash from parsed where route = 'datatypes'",
)
def pa13(spark, sf):
    rows, m = parsed(spark, sf, "datatypes"), "DQ_EVENT.metrics."
    return rows.select(
        "EVENT_ID",
        F.col("STATUS").alias("status"),
        _text(F.col(m + "columns_added")).alias("added"),
        _text(F.col(m + "columns_removed")).alias("removed"),
        _text(F.map_keys(m + "changed_datatypes")).alias("changed"),
        F.col(m + "curr_hash").alias("curr_hash"),
        F.col(m + "prev_hash").alias("prev_hash"),
    )


# --- projections -----------------------------------------------------------------------------------------------


@query(
    "pf1_schema_change_counts",
    "select EVENT_ID, status, 0 as ADDED_COLUMNS, 0 as REMOVED_COLUMNS, coalesce(len(moved_names), 0)::int as COLUMN_POSITION_CHANGES, coalesce(len(case_names), 0)::int as CASE_MISMATCHES from parsed",
)
def pf1(spark, sf):
    return parsed(spark, sf).select("EVENT_ID", F.col("STATUS").alias("status"), "ADDED_COLUMNS", "REMOVED_COLUMNS", "COLUMN_POSITION_CHANGES", "CASE_MISMATCHES")


_FLAT = ["status", "test_family", "test_category", "records_processed", "violation_severity"] + [
    f"{s}_{f}" for s in ("source", "target") for f in ("database", "table", "column", "object_level")
]


@query("pf2_flatten", f"select event_id, run_ts, {', '.join(_FLAT)}, {', '.join('metric_' + m for m in NUMERIC_METRICS)} from flat")
def pf2(spark, sf):
    return flat(spark, sf)


@query("pf3_broken_events", "select event_id, case when event_id % 7 = 0 then 'ERROR' else status end as status, case when event_id % 7 = 0 then 'UNKNOWN' else violation_severity end as violation_severity, case when event_id % 7 = 0 then 'NOT_APPLICABLE' else test_family end as test_family from flat")
def pf3(spark, sf):
    rows = parsed(spark, sf)
    broken = rows.withColumn("DQ_EVENT", F.when(F.col("EVENT_ID") % 7 != 0, F.col("DQ_EVENT")))
    return events.flatten(broken).select("event_id", "status", "violation_severity", "test_family")


def _stage_query(name: str, stage: int, columns: list[str], digits: dict[str, int] | None = None) -> None:
    rounded = digits or {}
    out = [f"round({c}, {rounded[c]}) + 0.0 as {c}" if c in rounded else c for c in columns]  # + 0.0: no negative zero

    @query(name, f"select event_id, {', '.join(out)} from stage{stage}")
    def one(spark, sf):
        df = flat(spark, sf)
        for s in features.stages("as_coded")[: stage + 1]:
            df = events.add(df, s)
        return df.select("event_id", *[(F.round(c, rounded[c]) + F.lit(0.0)).alias(c) if c in rounded else c for c in columns])


_CLEAN = [*features.clean_and_consistent("as_coded")]
_stage_query("pf2_status_flags", 0, [*features.base()])
_stage_query("fn_calendar_features", 0, [*features.calendar()], {c: 6 for c in features.calendar() if c.endswith(("_sin", "_cos"))})
_stage_query("pf4_status_features", 1, [*features.by_status("as_coded")])
_stage_query("pf5_missing_indicators", 1, [*features.indicators()])
_stage_query("pf6_test_types", 1, [*features.test_types("as_coded")])
_stage_query("pf7_clean_results", 1, _CLEAN[:3])
_stage_query("pf8_status_consistency", 1, _CLEAN[3:])
_stage_query("pf9_severity", 1, [*features.severities()])
_stage_query("pf10_performance", 2, [*features.performance()], {"execution_time_per_record": 6, "failure_rate": 6})
_RATES = [c for c in features.interactions() if c.endswith("_rate")]
_stage_query("pf11_interactions", 3, [c for c in features.interactions() if c not in _RATES], {"violation_count_performance_impact": 6})
_stage_query("wn1_family_rates", 3, _RATES, {c: 6 for c in _RATES})


@query("pf4_status_features_intended", checks.intended("stage0"))
def pf4_intended(spark, sf):
    columns = features.clean_and_consistent("intended") | features.test_types("intended")
    return events.add(events.add(flat(spark, sf), features.base()), columns).select("event_id", *columns)


@query("pf12_score_bands", f"select calendar_date, {', '.join(f'{e} as {c}' for c, e in checks.bands('').items())} from series")
def pf12(spark, sf):
    columns = {c: features.scores()[c] for c in encode.CATEGORIES}
    return events.add(series(spark, sf), columns).select("calendar_date", *columns)


def lagged(spark, sf):
    return temporal.temporal_features(series(spark, sf))


_TEMPORAL = [*features.temporal()]
_KEPT = [c for c in _TEMPORAL if c not in features.misleading()]


def _finite6(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) as {name or c}"


@query("pf13_drop_misleading", f"select calendar_date, {', '.join(_finite6(c) for c in ['DQ_SCORE', 'TRUST_SCORE', *_KEPT])} from lagged")
def pf13(spark, sf):
    kept = lagged(spark, sf).drop(*features.misleading())
    return kept.select("calendar_date", *[F.round(c, 6).alias(c) for c in kept.columns if c != "calendar_date"])


def _obs(c: str) -> str:
    head, _, n = c.rpartition("_pct_change_")
    return f"{head}_pct_change_lag_{n[:-1]}obs" if head and n != "30d" else c


_CHANGES = [c for c in _TEMPORAL if "_pct_change_" in c]


@query("pf14_rename_changes", f"select calendar_date, {', '.join(_finite6(c, _obs(c)) for c in _CHANGES)} from lagged")
def pf14(spark, sf):
    renamed = irregular.rename_changes(lagged(spark, sf))
    return renamed.select("calendar_date", *[F.round(_obs(c), 6).alias(_obs(c)) for c in _CHANGES])


def gapped(spark, sf):
    return irregular.gaps(series(spark, sf))


@query("pf15_without_future", "select calendar_date, days_since_last_measurement, is_long_gap, gap_severity from gapped")
def pf15(spark, sf):
    return forecast.without_future(gapped(spark, sf)).drop("DQ_SCORE", "TRUST_SCORE").withColumn("days_since_last_measurement", F.col("days_since_last_measurement").cast("long"))


@query("pf16_numeric_only", f"select {_r('DQ_SCORE', 'TRUST_SCORE')} from series")
def pf16(spark, sf):
    df = events.add(series(spark, sf), {c: features.scores()[c] for c in encode.CATEGORIES})
    return df.select(*[F.round(c, 6).alias(c) for c in temporal.numeric_columns(df)])


@query("pf17_pre_run", "select calendar_date, cast(daily_total_tests as bigint) as total_tests, cast(daily_test_passed_sum as bigint) as passed_tests, round(DQ_SCORE, 6) as DQ_SCORE from scored")
def pf17(spark, sf):
    df = forecast.for_mode(events_to_daily(parsed(spark, sf)), "pre_run")
    return df.select("calendar_date", "total_tests", "passed_tests", F.round("DQ_SCORE", 6).alias("DQ_SCORE"))


_NEXT = "lead(DQ_SCORE) over (order by calendar_date)"


@query("pf18_features_and_label", f"select * from (select calendar_date, {_r('DQ_SCORE', 'TRUST_SCORE')}, round({_NEXT}, 6) as DQ_SCORE_next from series) where DQ_SCORE_next is not null")
def pf18(spark, sf):
    return forecast.labelled(series(spark, sf)).select("calendar_date", *[F.round(c, 6).alias(c) for c in ("DQ_SCORE", "TRUST_SCORE", "DQ_SCORE_next")])


@query("pf19_failed_rows", "select event_id, run_ts, violation_severity from flat where status = 'fail'")
def pf19(spark, sf):
    columns = ["event_id", "run_ts", "violation_severity"]
    return stored(statuses(spark, sf).select("status", *columns), "statuses").where("status = 'fail'").select(*columns)


@query("pf20_reindex", f"select calendar_date, {_r('DQ_SCORE')}, 0.0::double as missing_feature from series")
def pf20(spark, sf):
    df = series(spark, sf)
    want = ["DQ_SCORE", "missing_feature"]
    return df.select("calendar_date", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in want])


@query("pf21_feature_metadata", "select count(*) as n, min(calendar_date) as first, max(calendar_date) as last, round(avg(days_since_last_measurement), 6) as average_gap_days, 4 as feature_count from gapped")
def pf21(spark, sf):
    df = gapped(spark, sf)
    kinds = len([c for c in temporal.numeric_columns(df) if c not in features.SCORES])
    return df.agg(F.count("*").alias("n"), F.min("calendar_date").alias("first"), F.max("calendar_date").alias("last"), F.round(F.avg("days_since_last_measurement"), 6).alias("average_gap_days"), F.lit(kinds).alias("feature_count"))


@query("pf22_positive_changes", "select calendar_date, round(DQ_SCORE_change_1d, 6) as change from lagged where abs(DQ_SCORE_change_1d) > 0 and DQ_SCORE_change_1d > 0")
def pf22(spark, sf):
    x = F.col("DQ_SCORE_change_1d")
    return lagged(spark, sf).where((F.abs(x) > 0) & (x > 0)).select("calendar_date", F.round(x, 6).alias("change"))


# --- joins -----------------------------------------------------------------------------------------------------

_WEEKLY, _MONTHLY = [*features.period("")], [*features.period("_monthly")]


@query("jn1_join_weekly", f"select event_id, {', '.join(_WEEKLY)} from joined")
def jn1(spark, sf):
    return events.join_periods(stored(featured(spark, sf), "featured")).select("event_id", *_WEEKLY)


@query("jn2_join_monthly", f"select event_id, {', '.join(_MONTHLY)} from joined")
def jn2(spark, sf):
    return events.join_periods(stored(featured(spark, sf), "featured")).select("event_id", *_MONTHLY)


_LOST = f"case when status = 'fail' then {checks.weight('violation_severity', 1)} else 0 end"


@query(
    "jn3_failures_and_totals",
    f"""select coalesce(f.d, t.d) as calendar_date, coalesce(w, 0)::bigint as severity_weight, coalesce(n, 0) as failed, coalesce(m, 0)::bigint as max_possible_weighted_points
      from (select run_ts::date as d, sum({_LOST}) as w, count(*) as n from flat where status = 'fail' group by 1) f
      full join (select run_ts::date as d, sum({checks.weight('violation_severity', 0)}) as m from flat group by 1) t on f.d = t.d""",
)
def jn3(spark, sf):
    return daily.failures_and_totals(statuses(spark, sf))


@query("jn4_daily_stats", "select calendar_date, cast(daily_total_tests as bigint) as daily_total_tests, execution_time_mean, cast(execution_time_sum as bigint) as execution_time_sum, cast(records_processed_sum as bigint) as records_processed_sum from daily")
def jn4(spark, sf):
    return daily.daily_features(engineered(spark, sf)).select("calendar_date", "daily_total_tests", "execution_time_mean", "execution_time_sum", "records_processed_sum")


@query("jn5_daily_scores", f"select calendar_date, {_r('DQ_SCORE', 'TRUST_SCORE')} from scores")
def jn5(spark, sf):
    return short(spark, sf).select("calendar_date", *[F.round(c, 6).alias(c) for c in features.SCORES])


_BANDS = {c: features.scores()[c] for c in encode.CATEGORIES}
_BANDED = "(select *, " + ", ".join(f"{e} as {c}" for c, e in checks.bands("").items()) + " from series)"


def banded(spark, sf):
    return events.add(series(spark, sf), _BANDS)


def _hot(c: str, names: list[str]) -> list[str]:
    return [f"(case when {c} = '{n}' then 1.0 else 0.0 end)::double as {c}_{n}" for n in sorted(names)[1:]]


@query(
    "jn6_ml11_one_hot",
    f"select calendar_date, {_r('DQ_SCORE')}, coalesce((DQ_SCORE_CATEGORY = 'UNACCEPTABLE')::int, 0)::double as is_unacceptable from {_BANDED}",
)
def jn6(spark, sf):
    c = "DQ_SCORE_CATEGORY"
    # all bands, not those that occur: the lowest may be the only one, and the first in order has no column
    df = encode.one_hot(banded(spark, sf), (c,), {c: encode.levels(c, "intended")})
    return df.select("calendar_date", F.round("DQ_SCORE", 6).alias("DQ_SCORE"), F.col(f"{c}_UNACCEPTABLE").alias("is_unacceptable"))


@query(
    "jn7_expanding_windows",
    "select f.i::int as fold, count(*) as n_train, round(avg(r.DQ_SCORE), 6) as mean_train from (select row_number() over (order by calendar_date) - 1 as i, * from scores) f "
    "join (select row_number() over (order by calendar_date) - 1 as i, * from scores) r on r.i < f.i where f.i >= 8 group by 1",
)
def jn7(spark, sf):
    from pyspark.sql import Window

    rows = short(spark, sf).withColumn("fold", F.row_number().over(Window.orderBy("calendar_date")) - 1)
    before = Window.orderBy("calendar_date").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("fold", F.count("*").over(before).alias("n_train"), F.round(F.avg("DQ_SCORE").over(before), 6).alias("mean_train")).where("fold >= 8")


@query(
    "jn8_as_of",
    "select day, date, round(DQ_SCORE, 6) as DQ_SCORE from (select distinct (ts::date + 1) as day from events) left join "
    "(select calendar_date as date, DQ_SCORE from scores) s on s.date = (select max(calendar_date) from scores where calendar_date <= day)",
)
def jn8(spark, sf):
    days = spark.read.parquet(f"{sf}/events.parquet").select(F.date_add(F.to_date("ts"), 1).alias("day")).distinct()
    return forecast.as_of_each(days, short(spark, sf)).select("day", "date", F.round("DQ_SCORE", 6).alias("DQ_SCORE"))


# --- aggregations ----------------------------------------------------------------------------------------------

_DAILY = features.daily(features.numeric())
_DAILY_WHOLE = [c for c, e in _DAILY.items() if e.startswith("sum(") and e[4:-1] not in oracle.DOUBLES or e == "count(*)"]


def _daily_sql(c: str) -> str:
    return c if c in _DAILY_WHOLE else f"round({c}, 6) as {c}"


@query("ag1_daily_features", f"select calendar_date, {', '.join(_daily_sql(c) for c in _DAILY)} from daily")
def ag1(spark, sf):
    df = daily.daily_features(engineered(spark, sf))
    return df.select("calendar_date", *[c if c in _DAILY_WHOLE else F.round(c, 6).alias(c) for c in _DAILY])


@query("ag2_family_counts", f"select run_ts::date as calendar_date, {', '.join(f'''count(*) filter (where test_family = '{f}') as daily_{f}_count''' for f in FAMILIES)} from flat group by 1")
def ag2(spark, sf):
    return daily.family_counts(raw(spark, sf).select(F.col("RUN_TIMESTAMP").alias("run_ts"), classify.family(F.col("NAME_OF_TEST")).alias("test_family")))


@query("ag3_daily_stats", "select run_ts::date as calendar_date, count(*) as daily_total_tests, round(avg(execution_time), 2) as execution_time_mean, sum(execution_time)::bigint as execution_time_sum, sum(records_processed)::bigint as records_processed_sum from stage0 group by 1")
def ag3(spark, sf):
    f = events.add(flat(spark, sf), features.base())
    return f.groupBy(F.to_date("run_ts").alias("calendar_date")).agg(
        F.count("*").alias("daily_total_tests"), F.round(F.avg("execution_time"), 2).alias("execution_time_mean"), F.sum("execution_time").alias("execution_time_sum"), F.sum("records_processed").alias("records_processed_sum")
    )


_DQ = [c for c in features.scores() if c not in encode.CATEGORIES]
_DQ_WHOLE = [c for c in _DQ if c.endswith("_tests")]


@query("ag4_dq_score", f"select calendar_date, {_r('DQ_SCORE', *[c for c in _DQ if c not in _DQ_WHOLE])}, {', '.join(f'cast({c} as bigint) as {c}' for c in _DQ_WHOLE)} from scored")
def ag4(spark, sf):
    f = events.add(statuses(spark, sf), features.status_flags())
    sums = f.groupBy(F.to_date("run_ts").alias("calendar_date")).agg(
        *[F.sum(c).alias(f"daily_{c}_sum") for c in features.status_flags()], F.count("*").alias("daily_total_tests"), F.lit(None).cast("double").alias("TRUST_SCORE")
    )
    df = daily.add_scores(sums)
    return df.select("calendar_date", *[F.round(c, 6).alias(c) for c in ("DQ_SCORE", *_DQ) if c not in _DQ_WHOLE], *_DQ_WHOLE)


@query("ag5_trust_score", "select calendar_date, round(TRUST_SCORE, 6) as TRUST_SCORE from scores")
def ag5(spark, sf):
    filled = events.fill_forward(stored(statuses(spark, sf), "statuses"), ["status", "violation_severity"])
    return daily.daily_scores(filled).select("calendar_date", F.round("TRUST_SCORE", 6).alias("TRUST_SCORE"))


@query("ag5_trust_score_unfilled", f"select run_ts::date as calendar_date, round({checks.trust()}, 6) as TRUST_SCORE from flat group by 1")
def ag5_plain(spark, sf):
    return daily.daily_scores(statuses(spark, sf)).select("calendar_date", F.round("TRUST_SCORE", 6).alias("TRUST_SCORE"))


@query("ag6_status_rates", f"""select run_ts, {', '.join(f'''round(count(*) filter (where status = '{s}') / nullif(count(status), 0), 4) as {s}_rate''' for s in ('pass', 'fail', 'error', 'skipped'))} from flat group by 1""")
def ag6(spark, sf):
    return daily.status_rates(statuses(spark, sf))


@query("ag7_weekly", f"select label, {', '.join(_WEEKLY)} from weekly")
def ag7(spark, sf):
    return events.period_stats(featured(spark, sf), "week")


@query("ag8_monthly", f"select label, {', '.join(_MONTHLY)} from monthly")
def ag8(spark, sf):
    return events.period_stats(featured(spark, sf), "month")


_COVERED = "TEST_RESULT SOURCE_COLUMN TARGET_DATABASE TARGET_TABLE SEVERITY_LEVEL".split()


@query("ag9_coverage", " union all ".join(f"select '{c}' as \"column\", count(*) - count({c}) as missing, round(100.0 * count({c}) / count(*), 4) as coverage from raw" for c in _COVERED))
def ag9(spark, sf):
    return profile.coverage(raw(spark, sf).select(*_COVERED))


@query("ag9_span", "select min(RUN_TIMESTAMP) as first, max(RUN_TIMESTAMP) as last, (max(RUN_TIMESTAMP)::date - min(RUN_TIMESTAMP)::date)::int as days, count(*) as n from raw")
def ag9_span(spark, sf):
    return profile.span(raw(spark, sf), "RUN_TIMESTAMP")


def _describe(c: str, source: str) -> str:
    q = lambda p: f"round(quantile_cont({c}::double, {p}), 6)"
    return f"select '{c}' as \"column\", count({c}) as n, round(avg({c}::double), 6) as mean, round(stddev_samp({c}::double), 6) as std, min({c}::double) as min, {q(0.25)} as q1, {q(0.5)} as median, {q(0.75)} as q3, max({c}::double) as max from {source}"


_DESCRIBED = ["metric_completeness_ratio", "metric_duplicate_count", "metric_curr_alloc_count", "metric_alloc_diff"]


@query("ag10_describe", " union all ".join(_describe(c, "flat") for c in _DESCRIBED))
def ag10(spark, sf):
    return profile.describe(flat(spark, sf), _DESCRIBED)


_PRICED = ["l_extendedprice", "l_quantity", "l_discount", "l_orderkey"]


@query("ag10_describe_lineitem", " union all ".join(_describe(c, "lineitem") for c in _PRICED))
def ag10_lineitem(spark, sf):
    return profile.describe(spark.read.parquet(f"{sf}/lineitem.parquet"), _PRICED)


_VALUED = ["NAME_OF_TEST", "SOURCE_DATABASE", "SEVERITY_LEVEL", "SOURCE_COLUMN"]


def _top(c: str, k: int) -> str:
    return f"select * from (select '{c}' as \"column\", {c} as value, count(*) as n, row_number() over (order by count(*) desc, {c})::int as rank, round(100.0 * count(*) / (select count(*) from raw), 4) as percent from raw where {c} is not null group by {c}) where rank <= {k}"


@query("ag11_top_values", " union all ".join(_top(c, 10) for c in _VALUED))
def ag11(spark, sf):
    return profile.top_values(raw(spark, sf), _VALUED)


@query("ag12_score_stats", "select " + ", ".join(f"round({f}({c}), 6) as {c}_{n}" for c in features.SCORES for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("median", "median"))) + " from series")
def ag12(spark, sf):
    return profile.score_stats(series(spark, sf))


@query("ag13_variances", " union all ".join(f"select '{c}' as \"column\", round(var_samp({c}::double), 6) as variance from flat" for c in _DESCRIBED))
def ag13(spark, sf):
    return profile.variances(flat(spark, sf), _DESCRIBED)


_GAP = "(select calendar_date, calendar_date - lag(calendar_date) over (order by calendar_date) as gap from {0})"


@query("ag14_gap_stats", f"select round(avg(gap), 6) as mean_gap, median(gap)::double as median_gap, max(gap)::int as max_gap, min(gap)::int as min_gap, round(count(*) / (max(calendar_date) - min(calendar_date) + 1), 6) as sparsity from {_GAP.format('scores')}")
def ag14(spark, sf):
    g = irregular.gap_stats(short(spark, sf))
    return g.withColumn("mean_gap", F.round("mean_gap", 6)).withColumn("sparsity", F.round("sparsity", 6))


_SMALLEST = f"select gap::int as gap, count(*) as n from {_GAP.format('series')} where gap is not null group by 1 order by 1 limit 10"


@query("ag14_gap_histogram", _SMALLEST)
def ag14_histogram(spark, sf):
    return irregular.gap_histogram(series(spark, sf))


@query("ag15_infinities", "select (" + " + ".join(f"count(*) filter (where isinf({c}))" for c in _TEMPORAL) + ")::bigint as infinite_values, (" + " + ".join(f"count(*) - count({c})" for c in _TEMPORAL) + ")::bigint as null_values from lagged")
def ag15(spark, sf):
    return irregular.infinities(lagged(spark, sf).select(*_TEMPORAL))


@query("ag16_finite_median", "select round(median(case when not isinf(DQ_SCORE_pct_change_1d) then DQ_SCORE_pct_change_1d end), 6) as median from lagged")
def ag16(spark, sf):
    c = "DQ_SCORE_pct_change_1d"
    return lagged(spark, sf).agg(F.round(F.median(F.when(F.abs(c) < float("inf"), F.col(c))), 6).alias("median"))


_FOLDS = f"(select calendar_date, DQ_SCORE, {_NEXT} as actual, row_number() over (order by calendar_date) - 1 as fold from {{0}})"
_NAIVE = f"select calendar_date as date, fold::int as fold, round(actual, 6) as actual, round(DQ_SCORE, 6) as pred_naive, round(DQ_SCORE - actual, 6) as error_naive from {_FOLDS} where actual is not null and fold >= greatest(8, floor(0.4 * (select count(*) - 1 from {{0}})))"


@query("ag17_naive_rmse", f"select 'Naive(last_value)' as model, round(sqrt(avg(pow(DQ_SCORE - actual, 2))), 6) as RMSE from {_FOLDS.format('scores')} where actual is not null and fold >= greatest(8, floor(0.4 * (select count(*) - 1 from scores)))")
def ag17(spark, sf):
    return forecast.naive_rmse(short(spark, sf))


@query("ag18_distinct_counts", " union all ".join(f"select '{c}' as \"column\", count(distinct {c}) as n_distinct from raw" for c in _VALUED))
def ag18_distinct(spark, sf):
    return profile.distinct_counts(raw(spark, sf), _VALUED)


@query("ag18_top_three", " union all ".join(_top(c, 3) for c in _VALUED))
def ag18_top(spark, sf):
    return profile.top_values(raw(spark, sf), _VALUED, 3)


@query("ag18_hourly_histogram", "select hour(RUN_TIMESTAMP)::int as hour, count(*) as n from raw group by 1")
def ag18_hours(spark, sf):
    return profile.hourly_histogram(raw(spark, sf))


@query("ag18_peak_hour", "select hour(RUN_TIMESTAMP)::int as hour, count(*) as n from raw group by 1 order by 2 desc, 1 limit 1")
def ag18_peak(spark, sf):
    return profile.peak_hour(raw(spark, sf))


@query("ag18_numeric_results", "select count(x) as n, round(avg(x), 6) as mean, median(x) as median, max(x) as max, count(*) filter (where x = 0) as zeros from (select try_cast(TEST_RESULT as double) as x from raw)")
def ag18_numeric(spark, sf):
    return profile.numeric_results(raw(spark, sf))


_COUNT = "count(*) filter (where status = '{0}')"


@query("ag18_status_summary", f"select count(*) as n, {_COUNT.format('pass')} as passed, {_COUNT.format('fail')} as failed, round(100.0 * {_COUNT.format('pass')} / count(*), 4) as pass_rate, round(100.0 * {_COUNT.format('fail')} / count(*), 4) as fail_rate from flat")
def ag18_status(spark, sf):
    return profile.status_summary(statuses(spark, sf))


@query("ag19_sparsity", "select count(*) as n, (max(calendar_date) - min(calendar_date) + 1)::int as days, round(count(*) / (max(calendar_date) - min(calendar_date) + 1), 6) as sparsity from series")
def ag19(spark, sf):
    days = F.datediff(F.max("calendar_date"), F.min("calendar_date")) + 1
    return series(spark, sf).agg(F.count("*").alias("n"), days.alias("days"), F.round(F.count("*") / days, 6).alias("sparsity"))


@query("ag20_status_distribution", "select status, count(*) as n from flat group by 1")
def ag20_status(spark, sf):
    return profile.distribution(statuses(spark, sf), "status")


@query("ag20_top_families", "select TEST_FAMILY, count(*) as n from classified group by 1 order by 2 desc, 1 limit 10")
def ag20_families(spark, sf):
    df = raw(spark, sf).select(classify.family(F.col("NAME_OF_TEST")).alias("TEST_FAMILY"))
    return profile.distribution(df, "TEST_FAMILY").orderBy(F.desc("n"), "TEST_FAMILY").limit(10)


@query("ag20_top_categories", "select TEST_CATEGORY, count(*) as n from classified group by 1 order by 2 desc, 1 limit 10")
def ag20_categories(spark, sf):
    df = raw(spark, sf).select(classify.category(F.col("NAME_OF_TEST")).alias("TEST_CATEGORY"))
    return profile.distribution(df, "TEST_CATEGORY").orderBy(F.desc("n"), "TEST_CATEGORY").limit(10)


@query("ag20_severities", "select SEVERITY_LEVEL, count(*) as n from raw group by 1")
def ag20_severities(spark, sf):
    return profile.distribution(raw(spark, sf), "SEVERITY_LEVEL")


@query("ag20_monthly", "select date_trunc('month', RUN_TIMESTAMP)::date as month, count(*) as n from raw group by 1")
def ag20_monthly(spark, sf):
    return profile.distribution(raw(spark, sf), F.trunc("RUN_TIMESTAMP", "month").alias("month"))


@query("ag20_weekdays", "select (isodow(RUN_TIMESTAMP) - 1)::int as weekday, count(*) as n from raw group by 1")
def ag20_weekdays(spark, sf):
    return profile.distribution(raw(spark, sf), F.weekday("RUN_TIMESTAMP").alias("weekday"))


# --- windows ---------------------------------------------------------------------------------------------------


def _window_query(name: str, columns: list[str]) -> None:
    @query(name, f"select calendar_date, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in columns)} from lagged")
    def one(spark, sf):
        df = events.add(series(spark, sf), {c: e for c, e in features.temporal().items() if c in columns})
        return df.select("calendar_date", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in columns])


_window_query("wn2_lags", [c for c in _TEMPORAL if "_lag_" in c])
_window_query("wn3_changes", [c for c in _TEMPORAL if "_change_" in c and "pct" not in c])
_window_query("wn4_pct_changes", _CHANGES)
_window_query("wn5_rolling", [c for c in _TEMPORAL if "_rolling_" in c and "trend" not in c])
_window_query("wn6_rolling_trend", [c for c in _TEMPORAL if "_rolling_trend_" in c])
_window_query("wn7_momentum", [c for c in _TEMPORAL if "_momentum_" in c])
_window_query("wn8_volatility", [c for c in _TEMPORAL if "_volatility_" in c])

_SOME = ["DQ_SCORE_lag_30d", "DQ_SCORE_pct_change_7d", "TRUST_SCORE_rolling_mean_14d", "TRUST_SCORE_rolling_std_30d"]


@query("wn9_fill_backward", f"select calendar_date, {', '.join(f'round({oracle.back(c)}, 6) as {c}' for c in _SOME)} from lagged")
def wn9(spark, sf):
    df = temporal.fill_backward(lagged(spark, sf).select("calendar_date", *_SOME), _SOME)
    return df.select("calendar_date", *[F.round(c, 6).alias(c) for c in _SOME])


_FILLED = ["status", "violation_severity", "metric_completeness_ratio", "metric_duplicate_count", "metric_alloc_diff", "records_processed"]


@query("wn10_fill_forward", f"select event_id, {', '.join(_FILLED)} from filled")
def wn10(spark, sf):
    return events.fill_forward(stored(flat(spark, sf).select("event_id", *_FILLED), "flat"), _FILLED)


@query("wn11_days_since", "select calendar_date, days_since_last_measurement from gapped")
def wn11(spark, sf):
    return gapped(spark, sf).select("calendar_date", F.col("days_since_last_measurement").cast("long").alias("days_since_last_measurement"))


@query("wn12_days_to_next", "select calendar_date, round(days_to_next_measurement, 6) as days_to_next_measurement from gapped")
def wn12(spark, sf):
    return gapped(spark, sf).select("calendar_date", F.round("days_to_next_measurement", 6).alias("days_to_next_measurement"))


@query("wn13_gap_severity", "select calendar_date, is_long_gap, gap_severity from gapped")
def wn13(spark, sf):
    return gapped(spark, sf).select("calendar_date", "is_long_gap", "gap_severity")


_TRENDS = [*oracle.trend_columns()]


def _trend_query(name: str, columns: list[str]) -> None:
    @query(name, f"select calendar_date, {', '.join(f'round({oracle.trend_columns()[c]}, 6) as {c}' for c in columns)} from gapped")
    def one(spark, sf):
        return irregular.gap_aware_trends(gapped(spark, sf)).select("calendar_date", *[F.round(c, 6).alias(c) for c in columns])


_trend_query("wn14_absolute_change", [c for c in _TRENDS if c.endswith("_absolute_change")])
_trend_query("wn15_daily_rate", [c for c in _TRENDS if c.endswith("_daily_rate")])
_FREQUENCY = [*oracle.frequency_columns()]


@query("wn16_measurements_last_nd", f"select calendar_date, {', '.join(f'{oracle.frequency_columns()[c]} as {c}' for c in _FREQUENCY[:3])} from gapped")
def wn16(spark, sf):
    return irregular.frequency(gapped(spark, sf)).select("calendar_date", *_FREQUENCY[:3])


@query("wn17_regularity", f"select calendar_date, round({oracle.frequency_columns()['measurement_regularity']}, 6) as measurement_regularity from gapped")
def wn17(spark, sf):
    return irregular.frequency(gapped(spark, sf)).select("calendar_date", F.round("measurement_regularity", 6).alias("measurement_regularity"))


@query("wn18_clean", f"select calendar_date, {', '.join(f'round({oracle.cleaned(c)}, 6) as {c}' for c in _SOME)} from lagged")
def wn18(spark, sf):
    return temporal.clean(lagged(spark, sf).select("calendar_date", *_SOME), _SOME).select("calendar_date", *[F.round(c, 6).alias(c) for c in _SOME])


@query("wn19_next_score", f"select calendar_date, round({_NEXT}, 6) as DQ_SCORE_next from series")
def wn19(spark, sf):
    return forecast.with_next(series(spark, sf)).select("calendar_date", F.round("DQ_SCORE_next", 6).alias("DQ_SCORE_next"))


@query("wn20_measurement_num", "select calendar_date, row_number() over (order by calendar_date)::int as measurement_num from scores")
def wn20(spark, sf):
    return forecast.recent(short(spark, sf), None).select("calendar_date", "measurement_num")


@query("wn21_repair_infinities", f"select calendar_date, {', '.join(f'round(case when isinf({c}) then 1000 else {c} end, 6) as {c}' for c in _CHANGES)} from lagged")
def wn21(spark, sf):
    df = irregular.repair_infinities(lagged(spark, sf).select("calendar_date", "DQ_SCORE", *_CHANGES))
    return df.select("calendar_date", *[F.round(c, 6).alias(c) for c in _CHANGES])


# --- order and limits ------------------------------------------------------------------------------------------


@query("sl1_sorted", f"select calendar_date, {_r('TRUST_SCORE')} from series order by 1")
def sl1(spark, sf):
    return latest_sorted(series(spark, sf)).select("calendar_date", F.round("TRUST_SCORE", 6).alias("TRUST_SCORE"))


@query("sl3_top_variances", f"select * from ({' union all '.join(f'''select '{c}' as \"column\", round(var_samp({c}::double), 6) as variance from flat''' for c in _DESCRIBED)}) order by variance desc limit 3")
def sl3(spark, sf):
    return profile.top_variances(flat(spark, sf), 3, _DESCRIBED)


@query("sl4_trend_data", f"select row_number() over (order by calendar_date)::int as measurement_num, calendar_date, {_r('DQ_SCORE', 'TRUST_SCORE')} from (select * from series order by calendar_date desc limit 10)")
def sl4(spark, sf):
    return forecast.recent(series(spark, sf)).select("measurement_num", "calendar_date", *[F.round(c, 6).alias(c) for c in features.SCORES])


@query("sl5_smallest_gaps", _SMALLEST)
def sl5(spark, sf):
    return irregular.gap_histogram(series(spark, sf))


@query("sl6_latest_row", f"select calendar_date, {_r('DQ_SCORE', 'TRUST_SCORE')} from series order by calendar_date desc limit 1")
def sl6(spark, sf):
    return forecast.as_of(series(spark, sf), None).select("calendar_date", *[F.round(c, 6).alias(c) for c in features.SCORES])


# --- models ----------------------------------------------------------------------------------------------------


@query("ml3_forecast_frame", f"select calendar_date, {_r('DQ_SCORE', 'TRUST_SCORE')} from series order by calendar_date desc limit 1")
def ml3(spark, sf):
    return forecast.latest(series(spark, sf)).select("calendar_date", *[F.round(c, 6).alias(c) for c in features.SCORES])


@query("ml4_naive_walk_forward", _NAIVE.format("scores"))
def ml4_naive(spark, sf):
    df = forecast.naive_folds(short(spark, sf))
    return df.select("date", "fold", *[F.round(c, 6).alias(c) for c in ("actual", "pred_naive", "error_naive")])


@query(
    "ml5_fold_scaler",
    "select fold::int as fold, round(m, 6) as DQ_SCORE_mean, round(case when s = 0 then 1 else s end, 6) as DQ_SCORE_scale from (select row_number() over (order by calendar_date) - 1 as fold, "
    f"avg(DQ_SCORE) over w as m, stddev_pop(DQ_SCORE) over w as s, {_NEXT} as nxt from scores window w as (order by calendar_date rows between unbounded preceding and 1 preceding)) "
    "where nxt is not null and fold >= greatest(8, floor(0.4 * (select count(*) - 1 from scores)))",
)
def ml5(spark, sf):
    return forecast.fold_stats(short(spark, sf), ["DQ_SCORE"])


@query("ml8_naive_serving", "select calendar_date as date, 'Naive(last_value)' as model, round(DQ_SCORE, 6) as predicted from scores order by calendar_date desc limit 1")
def ml8(spark, sf):
    return forecast.predict_as_of(short(spark, sf), None, None).select("date", "model", F.round("predicted", 6).alias("predicted"))


def _codes(target: str, mode: str) -> str:
    return f"case {target}" + "".join(f" when '{n}' then {i}" for n, i in encode.levels(target, mode).items()) + " end"


@query("ml9_ordinal_targets", f"select calendar_date, {_codes('DQ_SCORE_CATEGORY', 'as_coded')} as DQ_SCORE_CATEGORY_encoded, {_codes('TRUST_SCORE_CATEGORY', 'as_coded')} as TRUST_SCORE_CATEGORY_encoded from {_BANDED}")
def ml9(spark, sf):
    df = banded(spark, sf)
    for c in encode.CATEGORIES:
        df = encode.for_classification(df, c)
    return df.select("calendar_date", *[f"{c}_encoded" for c in encode.CATEGORIES])


@query("ml9_ordinal_targets_intended", f"select calendar_date, {_codes('DQ_SCORE_CATEGORY', 'intended')} as DQ_SCORE_CATEGORY_encoded from {_BANDED}")
def ml9_intended(spark, sf):
    return encode.for_classification(banded(spark, sf), mode="intended").select("calendar_date", "DQ_SCORE_CATEGORY_encoded")


@query("ml10_for_regression", f"select calendar_date, {_r('DQ_SCORE', 'TRUST_SCORE')} from series")
def ml10(spark, sf):
    return encode.for_regression(banded(spark, sf)).select("calendar_date", *[F.round(c, 6).alias(c) for c in features.SCORES])


@query("ml12_model_ready", f"select calendar_date, {_r('DQ_SCORE', 'TRUST_SCORE')}, {_codes('TRUST_SCORE_CATEGORY', 'as_coded')} as TRUST_SCORE_CATEGORY_encoded from {_BANDED}")
def ml12(spark, sf):
    df = encode.model_ready(banded(spark, sf), "classification", "TRUST_SCORE_CATEGORY")
    return df.select("calendar_date", *[F.round(c, 6).alias(c) for c in features.SCORES], "TRUST_SCORE_CATEGORY_encoded")


def _model_table(spark, sf):
    """The wide daily table of the derived log, as models see it."""
    return stored(irregular_table(standard(parsed(spark, sf))), "model-table")


def _tree_frame(spark, sf):
    """The long series with its temporal columns, rounded alike in both engines."""
    rounded = [F.coalesce(F.round(c, 6), F.lit(0.0)).alias(c) for c in oracle.TREE_COLUMNS]
    return stored(lagged(spark, sf).select("calendar_date", *rounded), "tree-frame")


def _fitted(frame, model, columns):
    return forecast.fit(forecast.labelled(frame), model, "DQ_SCORE", columns, "DQ_SCORE_next")


@query("ml4_walk_forward")
def ml4(spark, sf):
    return forecast.walk_forward(_model_table(spark, sf))


@query("ml4_walk_forward_series")
def ml4_series(spark, sf):
    """Over the long series: as many folds as it has days beyond the first part."""
    return forecast.walk_forward(_tree_frame(spark, sf))


@query("ml6_sl2_model_rmse")
def ml6(spark, sf):
    return forecast.rmse(forecast.walk_forward(_model_table(spark, sf)))


@query("ml6_forecast")
def ml6_forecast(spark, sf):
    df = _model_table(spark, sf)
    return forecast.forecast(df, forecast.train(df))


@query("ml1_tree_splits", "select node::int as node, feature, round(cut, 6) as threshold, round(gain, 6) as gain, nl::bigint as n_low, nr::bigint as n_high from splits")
def ml1(spark, sf):
    """The splits of the tree over the long series, as its levels find them."""
    frame = _tree_frame(spark, sf)
    rows = forecast.labelled(frame)
    mean = rows.agg(F.avg("DQ_SCORE_next")).first()[0]
    rows = rows.withColumn("y", F.col("DQ_SCORE_next") - mean).withColumn("node", F.lit(1))
    first = trees.best_splits(rows, oracle.TREE_COLUMNS, leaf=2)
    cut = first.select("feature", "at").first()
    side = F.when(F.col(oracle.TREE_COLUMNS[cut["feature"]]) <= cut["at"], 2).otherwise(3)
    both = first.unionByName(trees.best_splits(rows.withColumn("node", side), oracle.TREE_COLUMNS, leaf=2))
    name = F.array(*[F.lit(c) for c in oracle.TREE_COLUMNS])[F.col("feature")]
    return both.select("node", name.alias("feature"), F.round("at", 6).alias("threshold"), F.round("gain", 6).alias("gain"), "n_low", "n_high")


@query("ml13_tree_importances", "select feature, round(sum(gain) / (select sum(gain) from splits), 6) as weight from splits group by feature")
def ml13(spark, sf):
    artifact = _fitted(_tree_frame(spark, sf), forecast.TREE, oracle.TREE_COLUMNS)
    return spark.createDataFrame([(f, round(w, 6)) for f, w in artifact.importances()], "feature string, weight double")


_TREE_SERVED = f"""select calendar_date as date, 'DecisionTree' as model, 0 as missing,
  round((select avg(label) from frame) + case when b.node is null then case when s.node = 2 then r.sl / r.nl else r.sr / r.nr end
    when c.v <= b.cut then b.sl / b.nl else b.sr / b.nr end, 6) as predicted
  from ({oracle._side('served')}) s cross join best1 r left join best2 b on b.node = s.node left join served c using (calendar_date) where coalesce(c.f = b.f, c.f = 0)"""


@query("ml8_tree_serving", _TREE_SERVED)
def ml8_tree(spark, sf):
    """What the tree would have served as of every day, as one expression."""
    frame = _tree_frame(spark, sf)
    served = forecast.predict(frame, _fitted(frame, forecast.TREE, oracle.TREE_COLUMNS))
    return served.select("date", "model", "missing", F.round("predicted", 6).alias("predicted"))


@query(
    "ml8_linear_serving",
    """select calendar_date as date, 'Ridge' as model, 0 as missing, round(my + w1 * (DQ_SCORE - m1) / s1 + w2 * (TRUST_SCORE - m2) / s2, 6) as predicted
      from frame, (select *, (c1 * (n + 5) - c2 * n * r) / d as w1, (c2 * (n + 5) - c1 * n * r) / d as w2 from (
        select *, (n + 5) * (n + 5) - n * r * n * r as d from (
          select count(*) as n, avg(label) as my, avg(DQ_SCORE) as m1, avg(TRUST_SCORE) as m2, stddev_pop(DQ_SCORE) as s1, stddev_pop(TRUST_SCORE) as s2,
            corr(DQ_SCORE, TRUST_SCORE) as r, count(*) * covar_pop(DQ_SCORE, label) / stddev_pop(DQ_SCORE) as c1,
            count(*) * covar_pop(TRUST_SCORE, label) / stddev_pop(TRUST_SCORE) as c2 from frame where label is not null)))""",
)
def ml8_linear(spark, sf):
    """Ridge on the two scores, fitted from sums of products and served as of every day as one expression."""
    frame = _tree_frame(spark, sf)
    served = forecast.predict(frame, _fitted(frame, "Ridge", [*features.SCORES]))
    return served.select("date", "model", "missing", F.round("predicted", 6).alias("predicted"))


# --- sinks -----------------------------------------------------------------------------------------------------


def _published(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """``df`` published and read back by its manifest."""
    folder = shared_path(df.sparkSession, name)
    publish(df, folder, fmt)
    return published(df.sparkSession, folder)


@query("io6_publish_daily", f"select calendar_date, {_r('DQ_SCORE', 'TRUST_SCORE')} from series")
def io6(spark, sf):
    return _published(io5(spark, sf), "daily", "csv")


@query("io7_publish_irregular", "select calendar_date, days_since_last_measurement, round(days_to_next_measurement, 6) as days_to_next_measurement, is_long_gap, gap_severity from gapped")
def io7(spark, sf):
    gaps = irregular.gaps(series(spark, sf)).withColumn("days_to_next_measurement", F.round("days_to_next_measurement", 6))
    return _published(gaps.select("calendar_date", "days_since_last_measurement", "days_to_next_measurement", "is_long_gap", "gap_severity"), "irregular", "csv")


@query(
    "io8_publish_summary",
    "select count(*) as rows, 3 as columns, min(calendar_date)::varchar as first, max(calendar_date)::varchar as last, max(calendar_date) - min(calendar_date) as days, "
    "round(avg(DQ_SCORE), 6) as mean, round(median(TRUST_SCORE), 6) as trust_median from series",
)
def io8(spark, sf):
    folder = shared_path(spark, "summary")
    reports.publish_text(spark, json.dumps(reports.summary(series(spark, sf))), folder)
    fields = "rows bigint, columns int, first string, last string, days bigint, scores struct<DQ_SCORE_mean: double, TRUST_SCORE_median: double>"
    read = published(spark, folder).select(F.from_json("value", fields).alias("s")).select("s.*")
    return read.select("rows", "columns", "first", "last", "days", F.col("scores.DQ_SCORE_mean").alias("mean"), F.col("scores.TRUST_SCORE_median").alias("trust_median"))


@query("io10_io11_artifact", f"select date, model, missing, predicted from ({_TREE_SERVED}) order by date desc limit 1")
def io10(spark, sf):
    """An artifact published, read back as the newest, and served for the latest day."""
    frame, folder = _tree_frame(spark, sf), shared_path(spark, "models")
    reports.publish_artifact(spark, _fitted(frame, forecast.TREE, oracle.TREE_COLUMNS), folder)
    served = forecast.forecast(frame, reports.published_artifact(spark, folder))
    return served.select("date", "model", "missing", F.round("predicted", 6).alias("predicted"))


_EVENT = "event_id, run_ts, status, test_family, test_category, records_processed, violation_severity, source_table, target_database"


@query("io13_publish_events", f"select {_EVENT} from flat")
def io13(spark, sf):
    return _published(flat(spark, sf).select(*_EVENT.split(", ")), "events", "csv")


# --- compositions ----------------------------------------------------------------------------------------------


@query("or4_final_scores", f"select calendar_date, {_r('DQ_SCORE', 'TRUST_SCORE')}, DQ_SCORE_CATEGORY, TRUST_SCORE_CATEGORY from scored")
def or4(spark, sf):
    df = events_to_daily(parsed(spark, sf))
    return df.select("calendar_date", *[F.round(c, 6).alias(c) for c in features.SCORES], *encode.CATEGORIES)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


@query("or1_standard_table", f"select calendar_date, {', '.join(oracle.CATEGORIES)}, {', '.join(f'round({c}, 6) as {c}' for c in oracle.STANDARD)} from standard")
def or1(spark, sf):
    return _rounded(standard(parsed(spark, sf)))


@query("or8_irregular_table", f"select calendar_date, {', '.join(oracle.CATEGORIES)}, {', '.join(f'round({oracle.cleaned(c)}, 6) as {c}' for c in oracle.IRREGULAR)} from irregular")
def or8(spark, sf):
    return _rounded(irregular_table(standard(parsed(spark, sf))))


def _gapped_lags(spark, sf):
    """The long series with lags and gaps, infinite values and all, and a text column with holes."""
    df = irregular.gaps(lagged(spark, sf))
    return stored(df.withColumn("note", F.when(F.dayofmonth("calendar_date") % 3 == 1, F.date_format("calendar_date", "yyyy-MM"))), "gapped-lags")


_GAPS = [*features.SCORES, *_TEMPORAL, "days_since_last_measurement", *oracle.GAPS]
_NOTE = "case when day(calendar_date) % 3 = 1 then strftime(calendar_date, '%Y-%m') end"
_GAP_LAGS = f"(select *, {', '.join(f'{e} as {c}' for c, e in oracle.GAPS.items())}, {_NOTE} as note from (select *, coalesce(calendar_date - lag(calendar_date) over (order by calendar_date), 0) as days_since_last_measurement from lagged))"
_FILLED_NOTE = "coalesce(last_value(note ignore nulls) over (order by calendar_date rows unbounded preceding), first_value(note ignore nulls) over (order by calendar_date rows between current row and unbounded following), '0') as note"


@query("or12_prepared", f"select calendar_date, {_FILLED_NOTE}, {', '.join(f'round({oracle.cleaned(c)}, 6) as {c}' for c in _GAPS)} from {_GAP_LAGS}")
def or12(spark, sf):
    return _rounded(irregular.prepared_with_metadata(_gapped_lags(spark, sf))[0])


@query(
    "or12_metadata",
    f"""select count(*) as n_rows, {len(_GAPS) + 1} as n_columns, {len(_GAPS) - 1} as feature_count, 'DQ_SCORE,TRUST_SCORE' as target_variables, min(calendar_date) as first, max(calendar_date) as last,
      round(avg(days_since_last_measurement), 6) as average_gap_days, {len(_GAPS) - 2} as numeric_features, 1 as categorical_features,
      ({' + '.join(f'count(*) filter (where isinf({c}))' for c in _TEMPORAL)})::bigint as infinite_found, 0 as infinite_remaining,
      ({' + '.join(f'count(*) filter (where isinf({c}))' for c in _TEMPORAL)})::bigint as infinite_fixed from {_GAP_LAGS}""",
)
def or12_metadata(spark, sf):
    row = irregular.prepared_with_metadata(_gapped_lags(spark, sf))[1]
    return row.withColumns({"target_variables": F.array_join("target_variables", ","), "average_gap_days": F.round("average_gap_days", 6)})


@query("dq_daily_scores", f"select calendar_date, {_r('DQ_SCORE', 'TRUST_SCORE')}, cast(total_tests as bigint) as total_tests from (select *, daily_total_tests as n from scored)")
def flagship(spark, sf):
    return short(spark, sf).select("calendar_date", *[F.round(c, 6).alias(c) for c in features.SCORES], "total_tests")


__all__ = ["PARSERS", "QUERIES", "SQL"]
