"""Parsers of result texts: each gives status, metrics and entities as column expressions, without UDFs.

Texts are matched by Java patterns; ``(?i)`` marks the parsers that ignore case.  A missing
result reads as the text ``nan``, as it does in a log that went through CSV.

A parser is a row of steps, each a function of the text ``r``, of what the steps before it
found (``x``) and of the mode; the last one gives the fields of the event.  What a step finds
is a column of the rows (``PARSED_...``), shared by the parsers that use its name, so that
each pattern is matched once, and for the rows of its own parser only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import classify
from tallymark.functions.classify import context
from tallymark.schema import NUMERIC_METRICS, OTHER_METRICS, check_mode

Parsed = dict[str, Column]
_ENTITIES = ("org_code", "misallocated_org_code", "owner_org_code")


class Found:
    """What earlier steps found, by name."""

    def __getitem__(self, name: str) -> Column:
        return F.col(f"PARSED_{name}")

    def text(self, name: str) -> Column:
        """The text that a pattern found, or null."""
        return F.when(self[name] != "", self[name])

    def number(self, name: str) -> Column:
        return self.text(name).try_cast("bigint")


Step = Callable[[Column, Found, bool], Parsed]


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or an empty text; no pattern here has a group that matters when it is empty."""
    return F.regexp_extract(text, pattern, group)


def _flat(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit("\n"), F.lit(" "))


def _unglued(t: Column) -> Column:
    return F.regexp_replace(t, r"(?i)(org_code\s*:\s*[A-Z0-9_]+)(?=[A-Za-z])", "$1 ")


_UNITS = r"(?i)number_of_medical_units\s*:\s*(\d+)"


def unallocated() -> list[Step]:
    def text(r: Column, x: Found, intended: bool) -> Parsed:
        code = r"(?i)(org_code\s*:\s*[A-Z0-9_]+" + ("?" if intended else "") + r")\s*for\s+table\s*:"
        return {"text": F.regexp_replace(_flat(r), code, "$1 for table:")}

    def parts(r: Column, x: Found, intended: bool) -> Parsed:
        return {
            "n": first(x["text"], r"(?i)unallocated_records\s*:\s*(\d+)"),
            "units": first(x["text"], _UNITS),
            "code": first(x["text"], r"(?i)org_code\s*:\s*([A-Z0-9_]+)"),
            "table": first(x["text"], r"(?i)for\s+table\s*:\s*([A-Za-z0-9_]+)"),
            "flag": F.contains(F.lower(r), F.lit("unallocated_records")),
        }

    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        n, signal = x.number("n"), x["flag"]
        missing = r.isin("nan", "") if intended else F.lit(False)
        return {
            "status": F.when(missing, "unknown").when(~signal, "pass").when(n > 0, "fail").when(n == 0, "pass").otherwise("unknown"),
            "unallocated_records": F.when(signal, n),
            "number_of_medical_units": F.when(signal, x.number("units")),
            "org_code": F.when(signal, x.text("code")),
            "object_table": F.when(signal, F.upper(x.text("table"))),
        }

    return [text, parts, fields]


def misallocated() -> list[Step]:
    def text(r: Column, x: Found, intended: bool) -> Parsed:
        low = F.lower(_flat(r))
        zero = low.isin("0", "0.0", "none", "") | F.regexp_like(low, F.lit(r"misallocated\s+records\s*:\s*0\b"))
        return {"text": _flat(r) if intended else _unglued(_flat(r)), "zero": zero}

    def parts(r: Column, x: Found, intended: bool) -> Parsed:
        code = r"ORG_\d+" if intended else r"[A-Z0-9_]+"
        return {
            "n": first(x["text"], r"(?i)misallocated\s+records\s*:\s*(\d+)"),
            "units": first(x["text"], _UNITS),
            "code": first(x["text"], rf"(?i)misallocated\s+org_code\s*:\s*({code})"),
            "owner": first(x["text"], rf"(?i)owner\s+org_code\s*:\s*({code})"),
        }

    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        n, rest = x.number("n"), lambda c: F.when(~x["zero"], c)
        return {
            "status": F.when(x["zero"], "pass").when(n > 0, "fail").when(n == 0, "pass").otherwise("unknown"),
            "misallocated_records": rest(n),
            "number_of_medical_units": rest(x.number("units")),
            "misallocated_org_code": rest(x.text("code")),
            "owner_org_code": rest(x.text("owner")),
        }

    return [text, parts, fields]


def allocated() -> list[Step]:
    def text(r: Column, x: Found, intended: bool) -> Parsed:
        return {"text": _flat(r) if intended else _unglued(_flat(r))}

    def parts(r: Column, x: Found, intended: bool) -> Parsed:
        digits = r"([\d_]+)" if intended else r"(\d+)"
        count = lambda name: F.replace(first(x["text"], rf"(?i){name}\s*=\s*{digits}"), F.lit("_"), F.lit(""))
        return {
            "curr": count("curr_alloc_count"),
            "prev": count("prev_alloc_count"),
            "code": first(x["text"], r"(?i)org_code\s*:\s*" + (r"(ORG_\d+)" if intended else r"([A-Z0-9_]+)")),
        }

    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        curr, prev = x.number("curr"), x.number("prev")
        return {
            "status": F.when(curr.isNull() | prev.isNull(), "unknown").when(curr >= prev, "pass").otherwise("fail"),
            "curr_alloc_count": curr,
            "prev_alloc_count": prev,
            "alloc_diff": curr - prev,
            "org_code": x.text("code"),
        }

    return [text, parts, fields]


def completeness() -> list[Step]:
    def parts(r: Column, x: Found, intended: bool) -> Parsed:
        return {"n": first(F.trim(r), r"(-?[0-9]*\.?[0-9]+)" if intended else r"([0-9]*\.?[0-9]+)")}

    def ratio(r: Column, x: Found, intended: bool) -> Parsed:
        n = x.text("n").try_cast("double")
        return {"ratio": F.when((n >= 0) & (n <= 1), n) if intended else n}

    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        return {
            "status": F.when(x["ratio"].isNull(), "unknown").when(x["ratio"] >= 1.0, "pass").otherwise("fail"),
            "completeness_ratio": x["ratio"],
            "is_complete": (x["ratio"] >= 1.0).cast("int"),
        }

    return [parts, ratio, fields]


def duplicates() -> list[Step]:
    def number(r: Column, x: Found, intended: bool) -> Parsed:
        return {"ratio": F.trim(r).try_cast("double")}

    def count(r: Column, x: Found, intended: bool) -> Parsed:
        n = x["ratio"]
        return {"count": F.when(~F.isnan(n) & (F.abs(n) < 9.2e18), n).cast("bigint")}  # cuts towards zero

    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        n = x["count"]
        return {
            "status": F.when(n.isNull(), "unknown").when(n == 0, "pass").otherwise("fail"),
            "duplicate_count": n,
            "has_duplicates": (n > 0).cast("int"),
            "no_objects": n.isNull(),
        }

    return [number, count, fields]


def referential() -> list[Step]:
    def parts(r: Column, x: Found, intended: bool) -> Parsed:
        return {"n": first(r, r"(\d+)")}

    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        n = x.number("n")
        return {"status": F.when(n.isNull(), "unknown").when(n == 0, "pass").otherwise("fail"), "broken_fk_count": n}

    return [parts, fields]


def person() -> list[Step]:
    def parts(r: Column, x: Found, intended: bool) -> Parsed:
        t = F.trim(r)
        return {
            "curr": first(t, r"(?i)count_person_id\s*:\s*(\d+)"),
            "prev": first(t, r"(?i)count_distinct_person_id\s*:\s*(\d+)"),
            "code": first(t, r"(?i)(?:org_code:)?(ORG_[0-9]+)"),
        }

    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        count, distinct = x.number("curr"), x.number("prev")
        return {
            "status": F.when(count.isNull() | distinct.isNull(), "unknown").when(count >= distinct, "pass").otherwise("fail"),
            "org_code": F.upper(x.text("code")),
            "count_person_id": count,
            "count_distinct_person_id": distinct,
            "violation_amount": F.when(count < distinct, distinct - count),
        }

    return [parts, fields]


def sensitive() -> list[Step]:
    def parts(r: Column, x: Found, intended: bool) -> Parsed:
        return {"flag": F.lower(F.trim(r)) == "no sensitive codes found"}

    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        missing, clean = r.isin("nan", "") if intended else r == "", x["flag"]
        return {
            "status": F.when(missing, "unknown").when(clean, "pass").otherwise("fail"),
            "sensitive_flag": F.when(missing, F.lit(None)).when(clean, 0).otherwise(1),
            "reported_sensitive_content": F.when(~missing & ~clean, r),
        }

    return [parts, fields]


def _mismatch(a: Column, b: Column) -> Column:
    return F.coalesce((a != b).cast("int"), F.lit(0))


def _schema_missing(r: Column, status: Column, intended: bool) -> Column:
    return F.when(r == "", "unknown").when(r == "nan", "unknown").otherwise(status) if intended else F.when(r == "", "unknown").otherwise(status)


def _counts(what: str, glued: Callable[[bool], bool]) -> Step:
    """Counts and hashes of both sides; the hash follows the count (``glued``) or has a name of its own."""

    def parts(r: Column, x: Found, intended: bool) -> Parsed:
        out = {side: first(r, rf"{side}_{what}_count\s*=\s*(\d+)") for side in ("curr", "prev")}
        hashed = rf"_{what}_count\s*=\s*\d+\s+hash=([A-Za-z0-9]+)" if glued(intended) else r"_hash\s*=\s*([A-Za-z0-9]+)"
        return out | {f"{side}_hash": first(r, side + hashed) for side in ("curr", "prev")}

    return parts


def _hashes(x: Found) -> Parsed:
    return {"curr_hash": x.text("curr_hash"), "prev_hash": x.text("prev_hash")}


def table_count() -> list[Step]:
    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        curr, prev, (ch, ph) = x.number("curr"), x.number("prev"), _hashes(x).values()
        same = curr.eqNullSafe(prev) & ch.eqNullSafe(ph)
        return {
            "status": _schema_missing(r, F.when(same, "pass").otherwise("fail"), intended),
            "curr_tbl_count": curr,
            "prev_tbl_count": prev,
            "count_diff": F.abs(curr - prev),
            "hash_mismatch": _mismatch(ch, ph),
        } | _hashes(x)

    return [_counts("tbl", lambda intended: intended), fields]


def column_count() -> list[Step]:
    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        curr, prev, (ch, ph) = x.number("curr"), x.number("prev"), _hashes(x).values()
        diff = curr - prev
        same = curr.eqNullSafe(prev) & ch.eqNullSafe(ph)
        clipped = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0).cast("bigint")))
        return {
            "status": _schema_missing(r, F.when(same, "pass").otherwise("fail"), intended),
            "curr_col_count": curr,
            "prev_col_count": prev,
            "column_diff": diff,
            "columns_added_n": clipped(diff),
            "columns_removed_n": clipped(-diff),
            "hash_mismatch": _mismatch(ch, ph),
        } | _hashes(x)

    return [_counts("col", lambda intended: True), fields]


def entries(raw: Column, upper: bool = False) -> Column:
    """name and value of a list such as ``NAME:1, AGE:2``; of repeated names, the last value at the first place."""
    parts = F.filter(F.split(F.coalesce(raw, F.lit("")), ","), lambda p: F.contains(p, F.lit(":")))
    shape = (lambda x: F.upper(F.trim(x))) if upper else F.trim
    cut = lambda p: F.struct(shape(F.substring_index(p, ":", 1)).alias("k"), shape(F.regexp_replace(p, r"^[^:]*:", "")).alias("v"))
    rows = F.transform(parts, cut)
    names = F.array_distinct(F.transform(rows, lambda x: x["k"]))
    last = lambda k: F.element_at(F.filter(rows, lambda x: x["k"] == k), -1)["v"]
    return F.transform(names, lambda k: F.struct(k.alias("k"), last(k).alias("v")))


def _positions(raw: Column, strict: bool) -> Column:
    """name -> position; entries without a number are left out (strict: they keep a null)."""
    rows = F.transform(entries(raw), lambda e: F.struct(e["k"].alias("k"), F.trim(e["v"]).try_cast("int").alias("v")))
    return F.map_from_entries(rows if strict else F.filter(rows, lambda e: e["v"].isNotNull()))


def _changed(curr: Column, prev: Column) -> Column:
    """Names on both sides with different values, as name -> (prev, curr)."""
    both = F.filter(F.map_keys(curr), lambda k: F.array_contains(F.map_keys(prev), k) & ~F.element_at(prev, k).eqNullSafe(F.element_at(curr, k)))
    pair = lambda k: F.struct(k.alias("k"), F.struct(F.element_at(prev, k).alias("prev"), F.element_at(curr, k).alias("curr")).alias("v"))
    return F.map_from_entries(F.transform(both, pair))


def _minus(a: Column, b: Column) -> Column:
    return F.array_except(F.map_keys(a), F.map_keys(b))


def _compared(r: Column, x: Found, intended: bool) -> Parsed:
    """The names that come, go and change between the positions of both sides."""
    curr, prev = x["positions"], x["positions_before"]
    return {"added": _minus(curr, prev), "removed": _minus(prev, curr), "moved": _changed(curr, prev)}


def column_names() -> list[Step]:
    def parts(r: Column, x: Found, intended: bool) -> Parsed:
        out = {side: first(r, rf"(?i){side}_col_names\s*=\s*(.*?)\s*hash=") for side in ("curr", "prev")}
        return out | {f"{side}_hash": first(r, rf"(?i){side}_col_names.*?hash\s*=\s*([A-Za-z0-9]+)") for side in ("curr", "prev")}

    def positions(r: Column, x: Found, intended: bool) -> Parsed:
        return {"positions": _positions(x["curr"], True), "positions_before": _positions(x["prev"], True)}

    def changes(r: Column, x: Found, intended: bool) -> Parsed:
        curr, prev = x["positions"], x["positions_before"]
        alike = lambda c: F.filter(F.map_keys(prev), lambda p: (F.lower(p) == F.lower(c)) & (p != c))
        # one name may match several by case: the last in order stands for them
        unlike = F.filter(F.map_keys(curr), lambda c: F.size(alike(c)) > 0)
        cases = F.map_from_entries(F.transform(unlike, lambda c: F.struct(c.alias("k"), F.array_max(alike(c)).alias("v"))))
        out = _compared(r, x, intended)
        added, removed = F.array_sort(out["added"]), F.array_sort(out["removed"])
        if intended:  # a change of case alone is no change
            fold = lambda names, others: F.filter(names, lambda n: ~F.exists(F.map_keys(others), lambda o: F.lower(o) == F.lower(n)))
            added, removed = fold(added, prev), fold(removed, curr)
        return out | {"added": added, "removed": removed, "cases": cases}

    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        ch, ph = _hashes(x).values()
        same = ch.eqNullSafe(ph) & (F.size(x["added"]) == 0) & (F.size(x["removed"]) == 0) & (F.size(x["moved"]) == 0)
        return {
            "status": _schema_missing(r, F.when(same, "pass").otherwise("fail"), intended),
            "columns_added": x["added"],
            "columns_removed": x["removed"],
            "changed_positions": x["moved"],
            "case_mismatches": x["cases"],
            "curr_columns": x["positions"],
            "prev_columns": x["positions_before"],
        } | _hashes(x)

    return [parts, positions, changes, fields]


def datatypes() -> list[Step]:
    start, end, width = "_col_datatypes=", "hash=", 32

    def parts(r: Column, x: Found, intended: bool) -> Parsed:
        return {side: first(r, rf"(?is){side}{start}.+?{end}[0-9a-f]{{{width}}}", 0) for side in ("curr", "prev")}

    def types(r: Column, x: Found, intended: bool) -> Parsed:
        before, after = len("curr" + start), len(end) + width
        inner = lambda c: c.substr(F.lit(before + 1), F.length(c) - before - after)
        of = lambda c: F.map_from_entries(entries(inner(c), upper=True))
        last = lambda c: F.right(c, F.lit(width))
        known = (x["curr"] != "") & (x["prev"] != "")
        return {
            "types": of(x["curr"]),
            "types_before": of(x["prev"]),
            "curr_hash": last(x["curr"]),
            "prev_hash": last(x["prev"]),
            "flag": known,
        }

    def changes(r: Column, x: Found, intended: bool) -> Parsed:
        curr, prev = x["types"], x["types_before"]
        return {"added": _minus(curr, prev), "removed": _minus(prev, curr), "retyped": _changed(curr, prev)}

    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        known = lambda c: F.when(x["flag"], c)
        same = (F.size(x["added"]) == 0) & (F.size(x["removed"]) == 0) & (F.size(x["retyped"]) == 0)
        return {
            "status": F.when(~x["flag"], "unknown").when(same, "pass").otherwise("fail"),
            "columns_added": known(x["added"]),
            "columns_removed": known(x["removed"]),
            "changed_datatypes": known(x["retyped"]),
            "curr_hash": known(x["curr_hash"]),
            "prev_hash": known(x["prev_hash"]),
            "curr_types": known(x["types"]),
            "prev_types": known(x["types_before"]),
            "no_objects": ~x["flag"],
        }

    return [parts, types, changes, fields]


def column_position() -> list[Step]:
    def parts(r: Column, x: Found, intended: bool) -> Parsed:
        out = {side: first(r, rf"{side}_col_pos\s*=\s*(.*?)\s*hash=") for side in ("curr", "prev")}
        return out | {f"{side}_hash": first(r, rf"{side}_col_pos=.*?hash=([A-Za-z0-9]+)") for side in ("curr", "prev")}

    def positions(r: Column, x: Found, intended: bool) -> Parsed:
        return {"positions": _positions(x["curr"], False), "positions_before": _positions(x["prev"], False)}

    def fields(r: Column, x: Found, intended: bool) -> Parsed:
        (ch, ph), given = _hashes(x).values(), lambda c: F.when(r != "", c)
        moved = F.map_keys(x["moved"])
        return {
            "status": _schema_missing(r, F.when(ch.eqNullSafe(ph), "pass").otherwise("fail"), intended),
            "columns_added": given(x["added"]),
            "columns_removed": given(x["removed"]),
            "columns_moved": given(moved),
            "count_added": given(F.size(x["added"])),
            "count_removed": given(F.size(x["removed"])),
            "count_moved": given(F.size(moved)),
            "hash_mismatch": given(_mismatch(ch, ph)),
            "curr_positions": x["positions"],
            "prev_positions": x["positions_before"],
        } | _hashes(x)

    return [parts, positions, _compared, fields]


#: The steps of each parser, by the name that routes have for it.
PARSERS: dict[str, list[Step]] = {
    f.__name__: f()
    for f in (unallocated, misallocated, allocated, completeness, duplicates, referential, person, sensitive, table_count, column_count, column_names, datatypes, column_position)
}


def _result() -> Column:
    return F.coalesce(F.col("TEST_RESULT"), F.lit("nan"))


def _chosen(parsers: tuple[str, ...] | None) -> dict[str, list[Step]]:
    return {name: steps for name, steps in PARSERS.items() if parsers is None or name in parsers}


def _by_route(parsed: dict[str, Parsed], name: str) -> Column | None:
    out = None
    for parser, columns in parsed.items():
        if name in columns:
            out = (F if out is None else out).when(F.col("TEST_ROUTE") == parser, columns[name])
    return out


def routed(raw: DataFrame, mode: str = "as_coded", parsers: tuple[str, ...] | None = None) -> DataFrame:
    """Raw rows with TEST_FAMILY, TEST_CATEGORY, TEST_ROUTE and what the steps of the row's parser found.

    ``parsers`` keeps only the rows of these, before anything is matched.  A name means one type
    whichever parser it comes from.  What a query does not use is pruned.
    """
    intended, name, x = check_mode(mode), F.col("NAME_OF_TEST"), Found()
    rows = raw.withColumns({"TEST_FAMILY": classify.family(name), "TEST_CATEGORY": classify.category(name)})
    rows = rows.withColumn("TEST_ROUTE", classify.route(F.col("TEST_FAMILY"), name))
    if parsers is not None:
        rows = rows.where(F.col("TEST_ROUTE").isin(*parsers))
    chosen, known = _chosen(parsers), set()
    for i in range(max(len(steps) for steps in PARSERS.values()) - 1):
        parsed = {p: steps[i](_result(), x, intended) for p, steps in chosen.items() if i < len(steps) - 1}
        names = dict.fromkeys(n for columns in parsed.values() for n in columns)
        rows = rows.withColumns({f"PARSED_{n}": _by_route(parsed, n).otherwise(x[n] if n in known else F.lit(None)) for n in names})
        known |= set(names)
    return rows


#: Fields of the structure part, with their types.
STRUCTURE = {
    "curr_columns": "map<string,int>",
    "prev_columns": "map<string,int>",
    "curr_types": "map<string,string>",
    "prev_types": "map<string,string>",
    "curr_positions": "map<string,int>",
    "prev_positions": "map<string,int>",
    "reported_sensitive_content": "string",
}


def _fields(mode: str, parsers: tuple[str, ...] | None) -> dict[str, Parsed]:
    return {name: steps[-1](_result(), Found(), check_mode(mode)) for name, steps in _chosen(parsers).items()}


def dq_event(mode: str = "as_coded", parsers: tuple[str, ...] | None = None) -> Column:
    """The nested event of a row of ``routed``, with the same parsers; unmatched tests give an empty one."""
    to, parsed = F.col("TEST_ROUTE"), _fields(mode, parsers)

    def field(name: str, kind: str) -> Column:
        out = _by_route(parsed, name)
        return (F.lit(None) if out is None else out).cast(kind).alias(name)

    sides = {
        side: context(*[F.col(f"{side.upper()}_{c}") for c in ("DATABASE", "SCHEMA", "TABLE", "COLUMN")], mode=mode) for side in ("source", "target")
    }
    known = to.isin(*parsed) & ~F.coalesce(field("no_objects", "boolean"), F.lit(False)) if parsed else F.lit(False)
    return F.struct(
        F.col("TEST_FAMILY").alias("test_family"),
        F.when(to.isNotNull(), F.col("TEST_CATEGORY")).alias("test_category"),
        field("status", "string"),
        F.struct(*[field(n, k) for n, k in (NUMERIC_METRICS | OTHER_METRICS).items()]).alias("metrics"),
        F.struct(*[field(n, k) for n, k in STRUCTURE.items()]).alias("structure"),
        F.struct(*[field(n, "string") for n in _ENTITIES]).alias("entities"),
        F.struct(*[F.when(known, s).alias(n) for n, s in sides.items()], field("object_table", "string").alias("table")).alias("objects"),
        F.struct(F.when(to.isNotNull(), _result()).alias("original_test")).alias("raw"),
    )


def status(mode: str = "as_coded") -> Column:
    """The status alone of a row of ``routed``, for what needs no more."""
    return _by_route(_fields(mode, None), "status")


def parse_events(raw: DataFrame, mode: str = "as_coded", parsers: tuple[str, ...] | None = None) -> DataFrame:
    """Raw rows with TEST_FAMILY, TEST_CATEGORY, DQ_EVENT, the parsed STATUS and the counts of schema changes.

    ``parsers`` keeps only the rows of these parsers; filter by it rather than by the status, which Catalyst would parse twice.
    As coded, the counts of added and removed columns look under names that no parser writes and are 0.
    """
    rows = routed(raw, mode, parsers).withColumn("DQ_EVENT", dq_event(mode, parsers))
    m = F.col("DQ_EVENT.metrics")
    count = lambda x: F.coalesce(F.when(x.isNotNull(), F.size(x)), F.lit(0))
    lists = {"ADDED_COLUMNS": "columns_added", "REMOVED_COLUMNS": "columns_removed"}
    made = {"STATUS": F.col("DQ_EVENT.status")}
    made |= {c: count(m[f]) if check_mode(mode) else F.lit(0) for c, f in lists.items()}
    made |= {"COLUMN_POSITION_CHANGES": count(m["changed_positions"]), "CASE_MISMATCHES": count(m["case_mismatches"])}
    rows = rows.withColumns(made)
    return rows.drop("TEST_ROUTE", *[c for c in rows.columns if c.startswith("PARSED_")])
