"""A regression tree grown from sums by node, column and value: one pass over the rows for each level.

Each pass counts rows and sums the label by (node, column, value), in each task first; cumulative sums by value then
give what every split removes of the squared error, and the best split of each node comes to the driver: a row for each
open node.  Rows never do.  Missing values read as 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A split that removes less is none; gains are compared after rounding, so that equal splits tie in any order of summing.
LEAST_GAIN, DIGITS = 1e-12, 9


@dataclass(frozen=True)
class Node:
    value: float
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None
    #: Squared error that the split removes.
    gain: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.at, self.low.predict(x), self.high.predict(x))

    def splits(self) -> list[tuple[int, float]]:
        """(feature, gain) of this node and all below, from the top."""
        return [] if self.low is None else [(self.feature, self.gain), *self.low.splits(), *self.high.splits()]

    def column(self, columns: list[Column]) -> Column:
        """The prediction as an expression of the columns."""
        if self.low is None:
            return F.lit(self.value)
        return F.when(columns[self.feature] <= self.at, self.low.column(columns)).otherwise(self.high.column(columns))


def best_splits(rows: DataFrame, columns: list[str], leaf: int) -> DataFrame:
    """The best split of each node of ``rows`` (node, y and the columns); of equal ones, the first column and lowest value.

    ``node``, ``feature`` (its place), ``at``, ``gain``, and ``n_low``, ``sum_low``, ``n_high`` and ``sum_high`` of y.
    """
    cells = F.array(*[F.struct(F.lit(j).alias("feature"), F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias("value")) for j, c in enumerate(columns)])
    long = rows.select("node", "y", F.explode(cells).alias("cell")).select("node", "y", "cell.feature", "cell.value")
    sums = long.groupBy("node", "feature", "value").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    of_column = Window.partitionBy("node", "feature")
    upto = of_column.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(
        "node",
        "feature",
        "value",
        F.lead("value").over(of_column.orderBy("value")).alias("next"),
        F.sum("n").over(upto).alias("n_low"),
        F.sum("s").over(upto).alias("sum_low"),
        F.sum("n").over(of_column).alias("n"),
        F.sum("s").over(of_column).alias("s"),
    )
    sums = sums.where("next is not null").withColumns({"n_high": F.col("n") - F.col("n_low"), "sum_high": F.col("s") - F.col("sum_low")})
    removed = F.expr("sum_low * sum_low / n_low + sum_high * sum_high / n_high - s * s / n")
    sums = sums.where(f"n_low >= {leaf} and n_high >= {leaf}").withColumn("gain", removed).where(f"gain > {LEAST_GAIN}")
    found = F.struct("feature", ((F.col("value") + F.col("next")) / 2).alias("at"), "gain", "n_low", "sum_low", "n_high", "sum_high")
    first = F.struct(F.round("gain", DIGITS), -F.col("feature"), -F.col("value"))
    return sums.groupBy("node").agg(F.max_by(found, first).alias("best")).select("node", "best.*")


def grow(rows: DataFrame, label: str, columns: list[str], depth: int = 2, leaf: int = 2) -> Node:
    """A tree of ``depth`` levels of splits with ``leaf`` rows or more in each leaf.

    Rows without a label do not count; without any, the tree is one leaf of value 0.
    """
    rows = rows.where(F.col(label).isNotNull())
    mean = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    # sums of what is left after the mean do not cancel
    rows = rows.select(*columns, (F.col(label).cast("double") - mean).alias("y"))
    splits: dict[int, dict] = {}
    nodes = F.lit(1)  # a node's children have twice its number, and that plus 1
    for _ in range(depth):
        found = {r.node: r.asDict() for r in best_splits(rows.withColumn("node", nodes).where("node is not null"), columns, leaf).collect()}
        if not found:
            break
        splits |= found
        nodes = _node_of(1, splits, columns)

    def build(node: int, value: float) -> Node:
        s = splits.get(node)
        if s is None:
            return Node(value)
        low, high = mean + s["sum_low"] / s["n_low"], mean + s["sum_high"] / s["n_high"]
        return Node(value, s["feature"], s["at"], build(2 * node, low), build(2 * node + 1, high), s["gain"])

    return build(1, mean)


def _node_of(node: int, splits: dict[int, dict], columns: list[str]) -> Column:
    """The number of the open node that a row is in; null where its node cannot be split further."""
    s = splits.get(node)
    if s is None:
        return F.lit(node) if node // 2 in splits else F.lit(None).cast("int")
    value = F.coalesce(F.col(f"`{columns[s['feature']]}`").cast("double"), F.lit(0.0))
    return F.when(value <= s["at"], _node_of(2 * node, splits, columns)).otherwise(_node_of(2 * node + 1, splits, columns))


def tree(x: np.ndarray, y: np.ndarray, depth: int = 2, leaf: int = 2) -> Node:
    """The same tree of rows in memory."""
    value = float(y.mean())
    if depth == 0 or len(y) < 2 * leaf or np.ptp(y) == 0:
        return Node(value)
    best = (LEAST_GAIN, -1, 0.0)
    order = np.argsort(x, axis=0, kind="stable")
    left = y - value
    for j in range(x.shape[1]):
        xs, ys = x[order[:, j], j], left[order[:, j]]
        n = np.arange(1, len(ys))
        low = np.cumsum(ys)[:-1]
        gain = low**2 / n + (ys.sum() - low) ** 2 / (len(ys) - n)
        fine = (xs[1:] > xs[:-1]) & (n >= leaf) & (len(ys) - n >= leaf)
        if fine.any():
            k = int(np.where(fine, np.round(gain, DIGITS), -1.0).argmax())
            if np.round(gain[k], DIGITS) > np.round(best[0], DIGITS):
                best = (float(gain[k]), j, float((xs[k] + xs[k + 1]) / 2))
    if best[1] < 0:
        return Node(value)
    side = x[:, best[1]] <= best[2]
    return Node(value, best[1], best[2], tree(x[side], y[side], depth - 1, leaf), tree(x[~side], y[~side], depth - 1, leaf), best[0])
