"""Documented examples of each parser, and how missing results read."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions import classify
from tallymark.functions.parse import parse_events
from tallymark.schema import RAW

H = "0" * 32
CASES = [
    ("UNALLOCATED", "unallocated_records:644256, number_of_medical_units: 9, org_code:ORG_400for table: PATIENT_ADDRESS", "fail", {"unallocated_records": 644256, "number_of_medical_units": 9}),
    ("UNALLOCATED", None, "pass", {}),
    ("UNALLOCATED", "unallocated_records: many", "unknown", {}),
    ("MISALLOCATED", "0", "pass", {}),
    ("MISALLOCATED", "0.0", "pass", {}),
    ("MISALLOCATED", "misallocated records:0", "pass", {}),
    ("MISALLOCATED", None, "unknown", {}),
    ("MISALLOCATED", "misallocated records:4509049, misallocated org_code:ORG_768, number_of_medical_units:149, owner org_code:ORG_400", "fail", {"misallocated_records": 4509049, "number_of_medical_units": 149}),
    ("ALLOCATED", "org_code:ORG_400 curr_alloc_count = 3581153815, prev_alloc_count = 29015390961", "fail", {"alloc_diff": -25434237146}),
    ("ALLOCATED", "org_code:ORG_511 curr_alloc_count = 40_000_000_000, prev_alloc_count = 39_800_000_000", "pass", {"curr_alloc_count": 40, "prev_alloc_count": 39}),
    ("COMPLETENESS", "1.00", "pass", {"completeness_ratio": 1.0, "is_complete": 1}),
    ("COMPLETENESS", "0.47", "fail", {"completeness_ratio": 0.47, "is_complete": 0}),
    ("COMPLETENESS", "98%", "pass", {"completeness_ratio": 98.0}),
    ("COMPLETENESS", "-0.5", "fail", {"completeness_ratio": 0.5}),
    ("COMPLETENESS", None, "unknown", {}),
    ("DUPLICATES", "0", "pass", {"duplicate_count": 0, "has_duplicates": 0}),
    ("DUPLICATES", "12", "fail", {"duplicate_count": 12, "has_duplicates": 1}),
    ("DUPLICATES", "0.5", "pass", {"duplicate_count": 0}),
    ("DUPLICATES", "-3", "fail", {"duplicate_count": -3, "has_duplicates": 0}),
    ("DUPLICATES", "inf", "unknown", {}),
    ("DUPLICATES", None, "unknown", {}),
    ("REFERENTIAL", "0", "pass", {"broken_fk_count": 0}),
    ("REFERENTIAL", "12", "fail", {"broken_fk_count": 12}),
    ("PERSON TABLE TEST", "org_code:ORG_768: count_person_id: 1994142, count_distinct_person_id: 1993333", "pass", {"count_person_id": 1994142}),
    ("PERSON TABLE TEST", "ORG_459: count_person_id: 1, count_distinct_person_id: 4", "fail", {"violation_amount": 3}),
    ("SENSITIVE", "No sensitive codes FOUND", "pass", {"sensitive_flag": 0}),
    ("SENSITIVE", "code S1 found", "fail", {"sensitive_flag": 1}),
    ("SENSITIVE", None, "fail", {"sensitive_flag": 1}),
    ("SCHEMA DRIFT COLUMN COUNT", "curr_col_count=22 hash=fb3f229b; prev_col_count=23 hash=0b7b8b", "fail", {"column_diff": -1, "columns_removed_n": 1, "hash_mismatch": 1}),
    ("SCHEMA DRIFT COLUMN COUNT", "curr_col_count=24 hash=af67e55e; prev_col_count=24 hash=af67e55e", "pass", {"column_diff": 0}),
    ("SCHEMA DRIFT COLUMN COUNT", None, "pass", {}),
    ("SCHEMA DRIFT COLUMN NAMES", "curr_col_names=NAME:1, AGE:2 hash=aaa; prev_col_names=name:1, age:2 hash=aaa", "fail", {"columns_added": ["AGE", "NAME"], "columns_removed": ["age", "name"]}),
    ("SCHEMA DRIFT COLUMN NAMES", "curr_col_names=A:1, B:2, C:3 hash=xxx; prev_col_names=A:1, B:2 hash=yyy", "fail", {"columns_added": ["C"], "columns_removed": []}),
    ("SCHEMA DRIFT COLUMN POSITION", "curr_col_pos=A:1, B:2 hash=abcd; prev_col_pos=A:1, X:2 hash=ef99", "fail", {"columns_added": ["B"], "columns_removed": ["X"], "count_added": 1}),
    ("SCHEMA DRIFT TABLES", "curr_tbl_count=4 hash=626a; prev_tbl_count=5 hash=c295", "fail", {"count_diff": 1, "curr_hash": None, "hash_mismatch": 0}),
    ("SCHEMA DRIFT TABLES", None, "pass", {}),
    ("SCHEMA DRIFT DATATYPES", f"curr_col_datatypes=A:int, B:decimal(10,2) hash={H}; prev_col_datatypes=A:text hash={H}", "fail", {"columns_added": ["B"], "columns_removed": []}),
    ("SCHEMA DRIFT DATATYPES", "nothing", "unknown", {}),
    ("FRESHNESS CHECK", "n/a", None, {}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [{"TEST_RUN_ID": str(i), "NAME_OF_TEST": n, "TEST_RESULT": r} for i, (n, r, _, _) in enumerate(CASES)]
    done = parse_events(spark.createDataFrame(rows, RAW)).select("TEST_RUN_ID", "STATUS", "DQ_EVENT").collect()
    return {int(r.TEST_RUN_ID): r for r in done}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_documented_example(parsed, i):
    _, _, status, metrics = CASES[i]
    row = parsed[i]
    assert row.STATUS == status
    assert {k: row.DQ_EVENT.metrics[k] for k in metrics} == metrics


def test_org_codes_are_cut_as_coded_and_whole_as_intended(spark):
    rows = spark.createDataFrame([{"NAME_OF_TEST": "ALLOCATED", "TEST_RESULT": "org_code:ORG_400 curr_alloc_count = 4_0, prev_alloc_count = 3"}], RAW)
    coded, meant = (parse_events(rows, mode).select("DQ_EVENT.entities.org_code", "DQ_EVENT.metrics.curr_alloc_count").first() for mode in ("as_coded", "intended"))
    assert tuple(coded) == ("OR", 4) and tuple(meant) == ("ORG_400", 40)


def test_missing_results_are_unknown_as_intended(spark):
    rows = spark.createDataFrame([{"NAME_OF_TEST": n} for n in ("UNALLOCATED", "SENSITIVE", "SCHEMA DRIFT TABLES", "SCHEMA DRIFT COLUMN NAMES")], RAW)
    assert {r.STATUS for r in parse_events(rows, "intended").collect()} == {"unknown"}


def test_unknown_mode_raises(spark):
    with pytest.raises(ValueError):
        parse_events(spark.createDataFrame([], RAW), "other")


def test_families_and_categories_differ_where_coded(spark):
    names = ["ALLOCATION", "my duplicate check", "Schema check", "person check", "x SCHEMA DRIFT y"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(classify.family(F.col("n")), classify.category(F.col("n")))
    assert [tuple(r) for r in df.collect()] == [
        ("OTHER", "OTHER"), ("UNIQUENESS", "OTHER"), ("SCHEMA", "OTHER"), ("PERSON", "OTHER"), ("SCHEMA", "SCHEMA_DRIFT"),
    ]


def test_context_levels(spark):
    df = spark.createDataFrame([("D", "S", "T", None), ("D", "S", "T", ""), ("D", "", "nan", "")], "d string, s string, t string, c string")
    cols = [F.col(c) for c in "dstc"]
    coded = [tuple(r.c)[4:] for r in df.select(classify.context(*cols).alias("c")).collect()]
    meant = [tuple(r.c)[4:] for r in df.select(classify.context(*cols, mode="intended").alias("c")).collect()]
    assert coded == [("column", "D.S.T"), ("table", "D.S.T"), ("table", "D")]
    assert meant == [("table", "D.S.T"), ("table", "D.S.T"), ("database", "D")]


def test_column_names_that_match_several_by_case_keep_the_last(spark):
    text = "curr_col_names=NAME:1 hash=a1; prev_col_names=name:1, Name:2 hash=a1"
    row = parse_events(spark.createDataFrame([{"NAME_OF_TEST": "SCHEMA DRIFT COLUMN NAMES", "TEST_RESULT": text}], RAW)).select("DQ_EVENT.metrics.*").first()
    assert row.case_mismatches == {"NAME": "name"} and row.columns_added == ["NAME"]


@pytest.mark.parametrize("mode", ["as_coded", "intended"])
def test_each_pattern_is_matched_once(spark, mode, tmp_path):
    spark.createDataFrame([{"NAME_OF_TEST": "SENSITIVE"}], RAW).write.parquet(str(tmp_path / "log"))
    rows = parse_events(spark.read.parquet(str(tmp_path / "log")), mode).select("STATUS", "DQ_EVENT", "COLUMN_POSITION_CHANGES", "CASE_MISMATCHES")
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    try:
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("regexp_extract(") == 34 and plan.count("array_distinct(") == 6  # patterns of all parsers; lists of two sides in three
