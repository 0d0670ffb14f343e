"""Names, types and settings of the data-quality model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Families that classification gives, in the order of their columns (fixed values).
FAMILIES = ("ALLOCATION", "COMPLETENESS", "UNIQUENESS", "REFERENTIAL_INTEGRITY", "PERSON", "SCHEMA", "PRIVACY", "OTHER")
STATUSES = ("pass", "fail", "error", "skipped")
NOT_APPLICABLE, NO_VIOLATIONS = "NOT_APPLICABLE", "NO_VIOLATIONS"
SEVERITIES = ("HIGH SEVERITY", "MEDIUM SEVERITY", "LOW SEVERITY")

#: Numeric metrics of a parsed result and their types.
NUMERIC_METRICS: dict[str, str] = {
    "unallocated_records": "bigint",
    "number_of_medical_units": "bigint",
    "misallocated_records": "bigint",
    "curr_alloc_count": "bigint",
    "prev_alloc_count": "bigint",
    "alloc_diff": "bigint",
    "completeness_ratio": "double",
    "is_complete": "int",
    "duplicate_count": "bigint",
    "has_duplicates": "int",
    "broken_fk_count": "bigint",
    "count_person_id": "bigint",
    "count_distinct_person_id": "bigint",
    "violation_amount": "bigint",
    "sensitive_flag": "int",
    "curr_tbl_count": "bigint",
    "prev_tbl_count": "bigint",
    "count_diff": "bigint",
    "hash_mismatch": "int",
    "curr_col_count": "bigint",
    "prev_col_count": "bigint",
    "column_diff": "bigint",
    "count_added": "int",
    "count_removed": "int",
    "count_moved": "int",
}
#: Other metrics; columns_added and columns_removed are numbers in one parser and lists in three.
OTHER_METRICS: dict[str, str] = {
    "columns_added_n": "bigint",
    "columns_removed_n": "bigint",
    "columns_added": "array<string>",
    "columns_removed": "array<string>",
    "columns_moved": "array<string>",
    "changed_positions": "map<string,struct<prev:int,curr:int>>",
    "case_mismatches": "map<string,string>",
    "changed_datatypes": "map<string,struct<prev:string,curr:string>>",
    "curr_hash": "string",
    "prev_hash": "string",
}

_TEXT = (
    "TEST_RUN_ID NAME_OF_TEST SOURCE_DATABASE SOURCE_SCHEMA SOURCE_TABLE SOURCE_COLUMN "
    "TARGET_DATABASE TARGET_SCHEMA TARGET_TABLE TARGET_COLUMN TEST_RESULT STATUS DETAILS SEVERITY_LEVEL"
).split()
#: A raw log of test results: 16 columns.
RAW = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT] + [T.StructField("RUN_TIMESTAMP", T.StringType()), T.StructField("IS_LATEST", T.IntegerType())]
)


@dataclass(frozen=True)
class Settings:
    """Weights, bands, lags and windows of the scores."""

    severity_weights: dict[str, int] = field(default_factory=lambda: {"HIGH SEVERITY": 3, "MEDIUM SEVERITY": 2, "LOW SEVERITY": 1})
    dq_bands: tuple[tuple[float, str], ...] = ((0.98, "CLINICAL_EXCELLENCE"), (0.92, "HIGH_QUALITY"), (0.80, "ACCEPTABLE"), (0.60, "NEEDS_ATTENTION"))
    dq_lowest: str = "UNACCEPTABLE"
    trust_bands: tuple[tuple[float, str], ...] = ((0.90, "EXCELLENT_TRUST"), (0.75, "GOOD_TRUST"), (0.50, "MODERATE_TRUST"), (0.25, "POOR_TRUST"))
    trust_lowest: str = "CRITICAL_RISK"
    lags: tuple[int, ...] = (1, 3, 7, 14, 30)
    windows: tuple[int, ...] = (7, 14, 30)
    horizons: tuple[int, ...] = (30, 60, 90)
    long_gap: int = 7


SETTINGS = Settings()


def check_mode(mode: str) -> bool:
    """True for the intended reading, False for the as-coded one."""
    if mode not in ("as_coded", "intended"):
        raise ValueError(f"mode must be as_coded or intended, not {mode!r}")
    return mode == "intended"
