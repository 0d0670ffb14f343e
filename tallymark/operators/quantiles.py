"""Exact quantiles in bounded memory, by repeated histograms.

An aggregate that keeps all distinct values of a column needs room for them in one buffer.  Here each pass counts the
values of every open interval in ``BUCKETS`` buckets, with the least and greatest value of each, and goes on with the
bucket that holds the wanted rank.  An interval shrinks to a few thousandths of its values at each pass, and once at
most ``LISTED`` are left, they are counted one by one.  All columns and ranks share the passes, which take the rows
as they lie; only bucket counts are shuffled, and what reaches the driver is a row for each rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of an interval in one pass, and values of an interval that are few enough to be counted one by one.
BUCKETS, LISTED = 2048, 4096
INF = float("inf")


def exact_quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], buckets: int = BUCKETS, listed: int = LISTED) -> dict[str, list[float | None]]:
    """For each named column its quantiles at ``shares``, with linear interpolation between neighbours; None without values.

    Nulls and NaN do not count.  ``df`` is read three times or more: store it where it is dear.
    """
    names = list(columns)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), columns[c].cast("double").alias("v")) for i, c in enumerate(names)])
    long = df.select(F.explode(cells).alias("cell")).select("cell.i", "cell.v").where("v is not null and not isnan(v)")
    finite = F.abs("v") < INF
    first = long.groupBy("i").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("v") == -INF).alias("below"),
        F.count_if(finite).alias("finite"),
        F.min(F.when(finite, F.col("v"))).alias("low"),
        F.max(F.when(finite, F.col("v"))).alias("high"),
    )
    stats = {r.i: r for r in first.collect()}
    wanted: dict[tuple[int, int], float | None] = {}
    #: (column, rank) -> least and greatest value of its interval, values below it, values in it
    open_: dict[tuple[int, int], tuple[float, float, int, int]] = {}
    for i, s in stats.items():
        for share in shares:
            for k in {int(share * (s.n - 1)), -int(-share * (s.n - 1) // 1)}:
                if k < s.below:
                    wanted[i, k] = -INF
                elif k >= s.below + s.finite:
                    wanted[i, k] = INF
                else:
                    open_[i, k] = (s.low, s.high, s.below, s.finite)
    long = long.where(finite)
    while open_:
        for key, (low, high, _, _) in [*open_.items()]:
            if low == high:
                wanted[key] = low
                del open_[key]
        many = {key: x for key, x in open_.items() if x[3] > listed}
        few = {key: x for key, x in open_.items() if x[3] <= listed}
        for r in _ranked(long, few) if few else []:
            wanted[r.i, r.k] = r.v
        open_ = {}
        for r in _narrowed(long, many, buckets) if many else []:
            open_[r.i, r.k] = (r.low, r.high, r.below, r.n)

    def quantile(i: int, share: float) -> float | None:
        if i not in stats:
            return None
        at = share * (stats[i].n - 1)
        k = int(at)
        low, high = wanted[i, k], wanted[i, -int(-at // 1)]
        return low if low == high else (k + 1 - at) * low + (at - k) * high

    return {c: [quantile(i, s) for s in shares] for i, c in enumerate(names)}


def _within(long: DataFrame, intervals: dict[tuple[int, int], tuple[float, float, int, int]], bucket) -> DataFrame:
    """i, k, the bucket and the value for every value in the interval of a column's rank."""
    of_column: dict[int, list[Column]] = {}
    for (i, k), (low, high, below, _) in intervals.items():
        inside = F.col("v").between(low, high)
        of_column.setdefault(i, []).append(F.when(inside, F.struct(F.lit(k).cast("long").alias("k"), bucket(low, high).alias("b"), F.lit(below).cast("long").alias("below"))))
    # the columns' lists differ in length, so the choice is made before they are exploded
    chosen = F.lit(None)
    for i, structs in of_column.items():
        chosen = F.when(F.col("i") == i, F.array_compact(F.array(*structs))).otherwise(chosen)
    return long.select("i", "v", F.explode(chosen).alias("x")).select("i", "v", "x.k", "x.b", "x.below")


def _upto(rows: DataFrame) -> DataFrame:
    """The bucket of each (i, k) whose values reach over its rank, with the number of values below it."""
    before = Window.partitionBy("i", "k").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.col("below") + F.sum("n").over(before))
    return rows.where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))


def _narrowed(long: DataFrame, intervals, buckets: int) -> list:
    def bucket(low: float, high: float) -> Column:
        wide = abs(high - low) == INF  # the width of an interval over all doubles is itself beyond them
        share = (F.col("v") / 2 - low / 2) / (high / 2 - low / 2) if wide else (F.col("v") - low) / (high - low)
        return F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("long")

    counts = _within(long, intervals, bucket).groupBy("i", "k", "b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("below").alias("below"))
    return _upto(counts).select("i", "k", "n", "low", "high", (F.col("upto") - F.col("n")).alias("below")).collect()


def _ranked(long: DataFrame, intervals) -> list:
    counts = _within(long, intervals, lambda low, high: F.col("v")).groupBy("i", "k", "b").agg(F.count("*").alias("n"), F.first("below").alias("below"))
    return _upto(counts).select("i", "k", F.col("b").alias("v")).collect()
