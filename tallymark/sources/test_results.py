"""Readers of raw test-result logs and the log derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.scan import numbered, unused
from tallymark.schema import RAW

#: Days of the month without measurements, so that the daily series is irregular (fixed values).
SILENT_DAYS = (2, 5, 6, 12, 13, 14, 15, 16, 17, 18, 27)

_NAMES = (
    "UNALLOCATED TEST", "MISALLOCATED TEST", "ALLOCATED TEST", "COMPLETENESS TEST", "DUPLICATES", "REFERENTIAL_INTEGRITY", "PERSON TABLE TEST",
    "SENSITIVE CONDITION", "SCHEMA DRIFT TABLES", "SCHEMA DRIFT COLUMN COUNT", "SCHEMA DRIFT COLUMN NAMES", "SCHEMA DRIFT COLUMN POSITION",
    "SCHEMA DRIFT DATATYPES", "FRESHNESS CHECK",
)


def _s(x: str) -> str:
    return f"cast({x} as string)"


def derived_sql(k: str) -> list[str]:
    """Expressions of the derived log over ``events``, the same in Spark and DuckDB; ``k`` reads the number in props."""
    e, u, k = "event_id", "user_id", f"cast({k} as int)"

    def pick(of: str, *options: str) -> str:
        return "case " + of + "".join(f" when {i} then '{o}'" for i, o in enumerate(options)) + " end"

    name = "case event_id % 14" + "".join(f" when {i} then '{n}'" for i, n in enumerate(_NAMES)) + " end"
    md5 = lambda x: f"md5({_s(x)})"
    results = [
        f"case when {k}%3=0 then null else 'unallocated_records:' || {_s(f'({k}%5)*100')} || ', number_of_medical_units: ' || {_s(f'{k}%10')} "
        f"|| ', org_code:ORG_' || {_s(u)} || 'for table: t' || {_s(f'{k}%7')} end",
        f"case when {k}%3=0 then '0' else 'misallocated records:' || {_s(f'{k}*37')} || ', misallocated org_code:ORG_' || {_s(u)} "
        f"|| ', number_of_medical_units:' || {_s(f'{k}%20')} || ', owner org_code:ORG_' || {_s(f'{u}+1')} end",
        f"'org_code:ORG_' || {_s(u)} || ' curr_alloc_count = ' || {_s(f'{k}*1000+{e}%97')} || ', prev_alloc_count = ' || {_s(f'{k}*1000+{e}%89')}",
        f"case when {k}%4=0 then '1.00' else '0.' || lpad({_s(k)},2,'0') end",
        f"case when {k}%3=0 then '0' when {k}%7=0 then 'n/a' else {_s(k)} || '.0' end",
        _s(f"{k}%4"),
        f"'org_code:ORG_' || {_s(u)} || ': count_person_id: ' || {_s(f'{k}*11')} || ', count_distinct_person_id: ' "
        f"|| case when {k}%6=0 then {_s(f'{k}*11+3')} else {_s(f'{k}*10')} end",
        f"case when {k}%5=0 then 'code S' || {_s(k)} || ' found' else 'No sensitive codes found' end",
        f"'curr_tbl_count=' || {_s(f'4+{k}%2')} || ' hash=' || {md5(f'{k}%2')} || '; prev_tbl_count=4 hash=' || md5('0')",
        f"'curr_col_count=' || {_s(f'22+{k}%3')} || ' hash=' || {md5(f'{k}%3')} || '; prev_col_count=23 hash=' || md5('1')",
        f"'curr_col_names=ID:1, ' || {pick(f'{k}%4', 'NAME:2', 'name:2', 'NAME:2, AGE:3', 'NAME:3')} || ' hash=' || {md5(f'{k}%4')} "
        "|| '; prev_col_names=ID:1, NAME:2 hash=' || md5('0')",
        f"'curr_col_pos=A:1, ' || {pick(f'{k}%3', 'B:2', 'B:3', 'X:2')} || ' hash=' || {md5(f'{k}%3')} || '; prev_col_pos=A:1, B:2 hash=' || md5('0')",
        f"'curr_col_datatypes=A:int, B:' || {pick(f'{k}%3', 'varchar', 'text', 'varchar, C:date')} || ' hash=' || {md5(f'{k}%3')} "
        "|| '; prev_col_datatypes=A:int, B:varchar hash=' || md5('0')",
        "'n/a'",
    ]
    return [
        f"{e} as EVENT_ID",
        f"'RUN_' || {_s(f'{e}%500')} as TEST_RUN_ID",
        f"{name} as NAME_OF_TEST",
        f"'DB_' || {_s(f'{u}%5')} as SOURCE_DATABASE",
        f"'SCH_' || {_s(f'{u}%3')} as SOURCE_SCHEMA",
        f"'T_' || {_s(f'{k}%7')} as SOURCE_TABLE",
        f"case when {e}%3=0 then null else 'C_' || {_s(f'{k}%9')} end as SOURCE_COLUMN",
        f"case when {u}%4=0 then null else 'DW_' || {_s(f'{u}%2')} end as TARGET_DATABASE",
        "cast(null as string) as TARGET_SCHEMA",
        "cast(null as string) as TARGET_TABLE",
        "cast(null as string) as TARGET_COLUMN",
        "case event_id % 14" + "".join(f" when {i} then {r}" for i, r in enumerate(results)) + " end as TEST_RESULT",
        "cast(null as string) as STATUS",
        "cast(null as string) as DETAILS",
        f"case when {e}%56<14 then 'HIGH SEVERITY' when {e}%56<28 then 'MEDIUM SEVERITY' when {e}%56<42 then 'LOW SEVERITY' end as SEVERITY_LEVEL",
        "date_trunc('hour', ts) as RUN_TIMESTAMP",
        f"case when {e}%2=0 then 1 else 0 end as IS_LATEST",
    ]


def derived_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log derived from ``events`` (the tables hold no test results), with EVENT_ID as row order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    silent = ",".join(map(str, SILENT_DAYS))
    rows = events.where(f"day(ts) not in ({silent})").selectExpr(*derived_sql("get_json_object(props, '$.k')"))
    return rows.withColumn("RUN_TIMESTAMP", F.col("RUN_TIMESTAMP").cast("timestamp_ntz"))


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A raw CSV log with a declared schema; timestamps stay text until they are loaded."""
    return spark.read.schema(RAW).option("header", True).csv(path)


def load_events(df: DataFrame, order: str | list[str] = "EVENT_ID") -> DataFrame:
    """Rows with time features; rows without a readable time are dropped.

    Without RUN_TIMESTAMP, a ``date`` column is read; without that too, rows get days from
    2024-01-01 on, one each, in the order of ``order`` (a column or several): rows are dealt into
    ranges of it, and each range numbers its rows from the count of those before.
    """
    if "RUN_TIMESTAMP" in df.columns:
        ts = F.col("RUN_TIMESTAMP")
        if dict(df.dtypes)["RUN_TIMESTAMP"] == "string":
            ts = F.expr("try_cast(RUN_TIMESTAMP as timestamp_ntz)")
        df = df.withColumn("RUN_TIMESTAMP", ts).where("RUN_TIMESTAMP is not null")
        return df.select("*", *time_features(F.col("RUN_TIMESTAMP")))
    if "date" in df.columns:
        return df.withColumn("date", F.expr("try_cast(date as date)")).where("date is not null")
    place = unused(df, "place")
    rows = numbered(df, [F.col(c) for c in ([order] if isinstance(order, str) else order)], place)
    return rows.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col(place).cast("int"))).drop(place)


def time_features(ts: Column) -> list[Column]:
    """Hour, minute, second, weekday (Monday 0), cyclic hour, time of day in hours, parts of the day and the date."""
    hour, weekday = F.hour(ts), F.weekday(ts)
    turn = 2 * F.pi() * hour / 24
    between = lambda a, b: ((hour >= a) & (hour < b)).cast("int")
    return [
        hour.alias("hour"),
        F.minute(ts).alias("minute"),
        F.second(ts).alias("second"),
        weekday.alias("day_of_week"),
        F.sin(turn).alias("hour_sin"),
        F.cos(turn).alias("hour_cos"),
        (hour + F.minute(ts) / 60 + F.second(ts) / 3600).alias("time_of_day"),
        between(6, 12).alias("is_morning"),
        between(12, 18).alias("is_afternoon"),
        between(18, 22).alias("is_evening"),
        ((hour >= 22) | (hour < 6)).cast("int").alias("is_night"),
        ((hour >= 9) & (hour < 17) & (weekday < 5)).cast("int").alias("is_business_hours"),
        F.to_date(ts).alias("date"),
    ]


def latest_sorted(df: DataFrame, key: str = "calendar_date") -> DataFrame:
    """A daily table in the order of its date."""
    return df.orderBy(key)
