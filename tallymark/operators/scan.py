"""Prefix scans over all rows of a table in one order, without a window that holds them all.

Rows are dealt into ranges of the order.  Each range gives a summary (a count, sums, last values); the summaries are
scanned in blocks of ``FAN``, the blocks' summaries in blocks again, and so on: every window is partitioned and holds at
most ``FAN`` rows, however many ranges there are.  What each range starts from is then joined to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.stored import stored

#: Summaries in one window of a scan.
FAN = 512


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def carry(summaries: DataFrame, part: str, sums: tuple[str, ...] = (), lasts: tuple[str, ...] = ()) -> DataFrame:
    """What comes before each part: the sums of ``sums`` and the newest values of ``lasts`` that are not null.

    ``summaries`` has a row for each part, numbered by integers with any gaps; nothing before gives a sum of 0 and null
    as value.  It is read once for each level, so store it.  Each level is ``FAN`` times smaller than the one below.
    """
    low, top = summaries.agg(F.min(part), F.max(part)).first()
    level = summaries.select((F.col(part) - (low or 0)).alias(part), *sums, *lasts)
    done = _carry(level, part, sums, lasts, (top or 0) - (low or 0))
    return done.withColumn(part, F.col(part) + (low or 0))


def _carry(level: DataFrame, part: str, sums: tuple[str, ...], lasts: tuple[str, ...], top: int) -> DataFrame:
    block = unused(level, "block")
    level = level.withColumn(block, F.floor(F.col(part) / FAN).cast("long"))
    before = Window.partitionBy(block).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    inside = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums} | {c: F.last(c, ignorenulls=True).over(before) for c in lasts}
    if top < FAN:
        return level.select(part, *[x.alias(c) for c, x in inside.items()])
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(part))).alias(c) for c in lasts]
    above = level.groupBy(block).agg(*[F.sum(c).alias(c) for c in sums], *newest)
    above = _carry(above, block, sums, lasts, top // FAN).select(block, *[F.col(c).alias(f"above_{c}") for c in (*sums, *lasts)])
    both = level.select(part, block, *[x.alias(c) for c, x in inside.items()]).join(above, block)
    total = [(F.col(c) + F.col(f"above_{c}")).alias(c) for c in sums]
    return both.select(part, *total, *[F.coalesce(c, f"above_{c}").alias(c) for c in lasts])


def dealt(df: DataFrame, order: list[Column], at: str, name: str = "ranges") -> DataFrame:
    """``df`` in ranges of ``order``, stored, with ``at``: the number of the range in the upper bits, the row's place in the lower 33.

    One shuffle, by split points that Spark draws from the data; rows that are equal in ``order`` share a range, so a
    hot value needs further columns behind it.
    """
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), name)


def numbered(df: DataFrame, order: list[Column], out: str = "number", first: int = 0) -> DataFrame:
    """Add the place of each row in ``order``, counted from ``first``; which of two equal rows comes first is open."""
    at, part, start = (unused(df, n) for n in ("scan_at", "scan_part", "scan_start"))
    rows = dealt(df, order, at).withColumn(part, F.shiftright(at, 33))
    counts = stored(rows.groupBy(part).agg(F.count("*").alias(start)), "range-counts")
    starts = carry(counts, part, sums=(start,))
    # one row for each range that the shuffle made, so this side is as small as the number of its tasks
    place = F.col(start) + F.col(at).bitwiseAND((1 << 33) - 1) + first
    return rows.join(F.broadcast(starts), part).withColumn(out, place.cast("long")).drop(at, part, start)


def newest(summaries: DataFrame, part: str, columns: list[str], at: str) -> DataFrame:
    """For each part the last value of each column that is not null, by ``at``."""
    return summaries.groupBy(part).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in columns])


def carried_forward(rows: DataFrame, columns: list[str], part: str, at: str) -> DataFrame:
    """``rows`` with the newest value of each column that is not null, up to each row, over all parts.

    ``part`` numbers ranges of the order and ``at`` the rows within one.  ``rows`` are read twice.
    """
    prefix = "carried_"
    while any(f"{prefix}{c}".lower() in {x.lower() for x in rows.columns} for c in columns):
        prefix += "_"
    before = carry(stored(newest(rows, part, columns, at), "last-values"), part, lasts=tuple(columns))
    before = before.select(part, *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    own = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    values = {c: F.coalesce(F.last(c, ignorenulls=True).over(own), F.col(f"{prefix}{c}")) for c in columns}
    return rows.join(before, part).withColumns(values).drop(*[f"{prefix}{c}" for c in columns])
