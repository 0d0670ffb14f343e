"""Family, category and object context of a test, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.schema import check_mode


def _first(name: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    low, out = F.lower(name), None
    for part, value in rules:
        hit = F.contains(low, F.lit(part))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


#: Parts of a test's name and what they mean; the first that fits counts (fixed values).
CATEGORY_RULES = [
    ("unallocated", "ALLOCATION_UNALLOCATED"),
    ("misallocated", "ALLOCATION_MISALLOCATED"),
    ("allocated", "ALLOCATION_ALLOCATED"),
    ("schema drift", "SCHEMA_DRIFT"),
    ("completeness", "COMPLETENESS"),
    ("duplicates", "UNIQUENESS"),
    ("referential", "STRUCTURAL_INTEGRITY"),
    ("person table test", "STRUCTURAL_INTEGRITY"),
    ("sensitive", "SENSITIVE_DATA"),
]
FAMILY_RULES = [
    ("allocated", "ALLOCATION"),
    ("completeness", "COMPLETENESS"),
    ("duplicate", "UNIQUENESS"),
    ("referential", "REFERENTIAL_INTEGRITY"),
    ("person", "PERSON"),
    ("schema", "SCHEMA"),
    ("sensitive", "PRIVACY"),
]


def category(name: Column) -> Column:
    return _first(name, CATEGORY_RULES, "OTHER")


def family(name: Column) -> Column:
    return _first(name, FAMILY_RULES, "OTHER")


#: What a name must hold, in upper case, for each parser of its family; in order.
ROUTES = {
    "SCHEMA": [
        ("SCHEMA DRIFT TABLES", "table_count"),
        ("SCHEMA DRIFT COLUMN COUNT", "column_count"),
        ("SCHEMA DRIFT COLUMN NAME", "column_names"),
        ("SCHEMA DRIFT COLUMN POSITION", "column_position"),
        ("SCHEMA DRIFT DATATYPE", "datatypes"),
    ],
    "COMPLETENESS": [("", "completeness")],
    "UNIQUENESS": [("", "duplicates")],
    "PRIVACY": [("", "sensitive")],
    "PERSON": [("", "person")],
    "ALLOCATION": [("UNALLOCATED", "unallocated"), ("MISALLOCATED", "misallocated"), ("ALLOCATED", "allocated")],
    "REFERENTIAL_INTEGRITY": [("", "referential")],
}


def route(family: Column, name: Column) -> Column:
    """The parser of a test, or null where none fits."""
    upper, out = F.trim(F.upper(name)), F.when(F.lit(False), F.lit(""))
    for f, rules in ROUTES.items():
        for part, parser in rules:
            out = out.when((family == f) & F.contains(upper, F.lit(part)), parser)
    return out


def context(database: Column, schema: Column, table: Column, column: Column, mode: str = "as_coded") -> Column:
    """Source or target of a test.

    As coded, a missing column still counts as one, so the level is "column" unless the column is an empty text.
    """
    given = lambda x: x.isNotNull() & (F.trim(x) != "") & (x != "nan")
    if check_mode(mode):
        truthy = lambda x: F.coalesce(given(x), F.lit(False))
    else:
        truthy = lambda x: x.isNull() | (x != "")
    parts = [F.when(given(x), x) for x in (database, schema, table)]
    return F.struct(
        database.alias("database"),
        schema.alias("schema"),
        table.alias("table"),
        column.alias("column"),
        F.when(truthy(column), "column").when(truthy(table), "table").when(truthy(schema), "schema").otherwise("database").alias("object_level"),
        F.nullif(F.concat_ws(".", *parts), F.lit("")).alias("fully_qualified_name"),
    )
