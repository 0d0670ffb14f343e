"""Forecasts of the next score: labels, walk-forward validation, choice and refit of the best model.

Linear models are fitted from sums of products, trees from sums by column and value, and both are served as one
expression of their columns; the folds of the validation are dealt over the cluster in blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators import gram, trees
from tallymark.operators.gram import Linear
from tallymark.operators.scan import carried_forward, dealt, numbered
from tallymark.operators.stored import stored
from tallymark.operators.temporal import numeric_columns
from tallymark.operators.trees import Node, tree

NAIVE = "Naive(last_value)"


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 5.0) -> Linear:
    return gram.fit(gram.ridge, x, y, alpha=alpha)


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float = 0.1, l1: float = 0.5, rounds: int = 10_000, tolerance: float = 1e-4) -> Linear:
    return gram.fit(gram.elastic_net, x, y, alpha=alpha, l1=l1, rounds=rounds, tolerance=tolerance)


def bayesian_ridge(x: np.ndarray, y: np.ndarray, rounds: int = 300, tolerance: float = 1e-3, prior: float = 1e-6) -> Linear:
    return gram.fit(gram.bayesian_ridge, x, y, rounds=rounds, tolerance=tolerance, prior=prior)


TREE = "DecisionTree"
#: Linear candidates, from the moments of standardised columns.
LINEAR: dict[str, Callable[[gram.Centred], np.ndarray]] = {"ElasticNet": gram.elastic_net, "BayesianRidge": gram.bayesian_ridge, "Ridge": gram.ridge}
#: Rows, and folds, of one task of the walk-forward validation.
BLOCK = 128


def without_future(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "to_next" in c])


def for_mode(df: DataFrame, mode: str = "post_run") -> DataFrame:
    """pre_run leaves out what is known only after the day's run."""
    if mode not in ("post_run", "pre_run"):
        raise ValueError(f"mode must be post_run or pre_run, not {mode!r}")
    if mode == "post_run":
        return df
    late = ("violations", "failed", "error", "skipped")
    return df.drop(*[c for c in df.columns if c.startswith("daily_") or any(w in c for w in late)])


def with_next(df: DataFrame, target: str = "DQ_SCORE", index: str = "calendar_date") -> DataFrame:
    """Adds {target}_next; the latest row has none."""
    for c in (index, target):
        if c not in df.columns:
            raise ValueError(f"{c} is not a column")
    return without_future(df).withColumn(f"{target}_next", F.lead(target).over(Window.orderBy(index)))


def labelled(df: DataFrame, target: str = "DQ_SCORE") -> DataFrame:
    return with_next(df, target).where(F.col(f"{target}_next").isNotNull())


def latest(df: DataFrame, target: str = "DQ_SCORE", index: str = "calendar_date") -> DataFrame:
    return with_next(df, target, index).orderBy(F.desc(index)).limit(1)


def first_fold(n: int, min_train: int | None = None) -> int:
    if n < 10:
        raise ValueError(f"{n} labelled rows are too few for walk-forward validation")
    first = max(8, int(n * 0.4)) if min_train is None else min_train
    if first >= n:
        raise ValueError(f"min_train ({first}) must be below the number of rows ({n})")
    return first


def naive_folds(df: DataFrame, target: str = "DQ_SCORE", min_train: int | None = None, index: str = "calendar_date") -> DataFrame:
    """The last value as forecast, for each fold: a window, without a model."""
    rows = labelled(df, target)
    first = first_fold(rows.count(), min_train)
    numbered = rows.withColumn("fold", F.row_number().over(Window.orderBy(index)) - 1).where(F.col("fold") >= first)
    error = F.col(target) - F.col(f"{target}_next")
    return numbered.select(F.col(index).alias("date"), "fold", F.col(f"{target}_next").alias("actual"), F.col(target).alias("pred_naive"), error.alias("error_naive"))


def naive_rmse(df: DataFrame, **how) -> DataFrame:
    return naive_folds(df, **how).agg(F.lit(NAIVE).alias("model"), F.round(F.sqrt(F.avg(F.pow("error_naive", 2))), 6).alias("RMSE"))


def fold_stats(df: DataFrame, columns: list[str], min_train: int | None = None, index: str = "calendar_date") -> DataFrame:
    """Mean and population deviation (1 where constant) of columns over the training rows of each fold."""
    rows = labelled(df)
    first = first_fold(rows.count(), min_train)
    before = Window.orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    number = F.row_number().over(Window.orderBy(index)) - 1
    out = {"fold": number}
    for c in columns:
        spread = F.stddev_pop(c).over(before)
        out |= {f"{c}_mean": F.round(F.avg(c).over(before), 6), f"{c}_scale": F.round(F.when(spread == 0, 1.0).otherwise(spread), 6)}
    return rows.select(*[x.alias(n) for n, x in out.items()]).where(F.col("fold") >= first)


def _arrays(rows: DataFrame, columns: list[str], label: str, *more: Column) -> DataFrame:
    """The label as y and the columns as one array x, missing ones as 0."""
    return rows.select(*more, F.col(label).cast("double").alias("y"), F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]).alias("x"))


def walk_forward(df: DataFrame, target: str = "DQ_SCORE", min_train: int | None = None, index: str = "calendar_date", block: int = BLOCK) -> DataFrame:
    """fold, date, actual, model and pred of every candidate and the naive forecast.

    Fold t trains on the rows before t.  The table is stored once with its rows numbered.  For the linear models, each
    block of rows gives its moments, a prefix sum over blocks gives what lies before each, and the block's task adds its
    rows one by one and fits from the sums: no row goes to a second task.  A tree needs its rows, so a block's folds
    share one group with the rows up to the block's end: each row goes once to every later block, not to every fold.
    """
    label = f"{target}_next"
    rows = labelled(df, target)
    columns = numeric_columns(rows, label)
    naive = F.coalesce(F.col(target).cast("double"), F.lag(label).over(Window.orderBy(index))).alias("naive")
    x = numbered(stored(_arrays(rows, columns, label, F.col(index).cast("date").alias("date"), naive), "labelled"), [F.col("date")], "t")
    x = x.withColumn("block", F.floor(F.col("t") / block).cast("long"))
    n = x.count()
    first, top = first_fold(n, min_train), (n - 1) // block
    shift = gram.shift_of(x)
    before = gram.before_blocks(gram.block_moments(x, shift), top)
    schema = "fold int, date date, actual double, model string, pred double"

    def lines(t: int, date, y: float, pred: dict[str, float]) -> list[tuple]:
        return [(t, date, y, m, float(p)) for m, p in pred.items()]

    def linear(own: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        sums = gram.Moments.from_bytes(earlier["moments"].iloc[0]) if len(earlier) else gram.Moments(len(shift[0]))
        out: list[tuple] = []
        for r in own.sort_values("t").itertuples():
            here = (np.asarray(r.x) - shift[0]) / shift[1]
            if r.t >= first:
                c = sums.centred()
                z = (here - c.mean) / c.scale
                out += lines(r.t, r.date, r.y, {NAIVE: r.naive} | {m: c.label + z @ solve(c) for m, solve in LINEAR.items()})
            sums.add(here, r.y)
        return pd.DataFrame(out, columns=["fold", "date", "actual", "model", "pred"])

    def trees_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        a, y, out = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(float), []
        for t in range(max(first, int(pdf["to"].iloc[0]) * block), len(pdf)):
            fitted = trees.tree(a[:t], y[:t])
            out += lines(t, pdf["date"].iloc[t], y[t], {TREE: fitted.predict(a[t : t + 1])[0]})
        return pd.DataFrame(out, columns=["fold", "date", "actual", "model", "pred"])

    tested = x.where(F.col("block") >= first // block)
    by_sums = tested.groupBy("block").cogroup(before.where(f"block <= {top}").groupBy("block")).applyInPandas(linear, schema)
    later = F.explode(F.sequence(F.greatest("block", F.lit(first // block)), F.lit(top)))
    by_rows = x.select("t", "date", "y", "x", later.alias("to")).groupBy("to").applyInPandas(trees_of, schema)
    return by_sums.unionByName(by_rows)


def rmse(folds: DataFrame) -> DataFrame:
    return folds.groupBy("model").agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("actual"), 2))).alias("RMSE")).orderBy("RMSE", "model")


@dataclass
class Artifact:
    """A fitted forecaster: enough to serve without its training data."""

    model: str
    target: str
    features: list[str]
    mode: str
    rmse: dict[str, float]
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    fitted: object = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.model == NAIVE:
            return x[:, self.features.index(self.target)]
        return self.fitted.predict((x - np.array(self.mean)) / np.array(self.scale) if self.model in LINEAR else x)

    def column(self, x: list[Column]) -> Column:
        """The forecast as one expression of the features' columns, in their order: no Python at run time.

        The terms of a linear model are added in pairs, then pairs of pairs, so that the expression is flat.
        """
        if self.model == NAIVE:
            return x[self.features.index(self.target)]
        if self.model not in LINEAR:
            return self.fitted.column(x)
        terms = [(c - float(m)) / float(s) * float(w) for c, m, s, w in zip(x, self.mean, self.scale, self.fitted.weights) if w != 0]
        terms.append(F.lit(float(self.fitted.bias)))
        while len(terms) > 1:
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return terms[0]

    def importances(self) -> list[tuple[str, float]]:
        """Weights of a linear model, or the share of a tree's removed error that is each column's, largest first."""
        if isinstance(self.fitted, Linear):
            pairs = [(f, float(w)) for f, w in zip(self.features, self.fitted.weights) if abs(w) > 0]
        else:
            gains: dict[int, float] = {}
            for j, gain in self.fitted.splits() if self.fitted else []:
                gains[j] = gains.get(j, 0.0) + gain
            pairs = [(self.features[j], gain / sum(gains.values())) for j, gain in gains.items()]
        return sorted(pairs, key=lambda p: (-abs(p[1]), p[0]))

    def to_json(self) -> str:
        fitted = {"weights": self.fitted.weights.tolist(), "bias": self.fitted.bias} if isinstance(self.fitted, Linear) else _to_dict(self.fitted)
        return json.dumps(self.__dict__ | {"fitted": fitted})

    @classmethod
    def from_json(cls, text: str) -> Artifact:
        d = json.loads(text)
        f = d["fitted"]
        d["fitted"] = None if f is None else Linear(np.array(f["weights"]), f["bias"]) if "weights" in f else _from_dict(f)
        return cls(**d)


def _to_dict(node: Node | None) -> dict | None:
    return None if node is None else node.__dict__ | {"low": _to_dict(node.low), "high": _to_dict(node.high)}


def _from_dict(d: dict | None) -> Node | None:
    return None if d is None else Node(**d | {"low": _from_dict(d["low"]), "high": _from_dict(d["high"])})


def fit(rows: DataFrame, model: str, target: str, columns: list[str], label: str, mode: str = "post_run", scores: dict[str, float] | None = None) -> Artifact:
    """One candidate fitted to all rows with a label: a linear one from their moments, a tree level by level.

    Only sums come to the driver: as many as pairs of columns, or a row for each node of the tree.
    """
    artifact = Artifact(model, target, columns, mode, scores or {})
    if model == TREE:
        artifact.fitted = trees.grow(rows, label, columns)
    elif model != NAIVE:
        x = _arrays(rows.where(F.col(f"`{label}`").isNotNull()), columns, label)
        shift = gram.shift_of(x)
        c = gram.total(x, shift).centred()
        artifact.mean, artifact.scale = (shift[0] + c.mean * shift[1]).tolist(), (c.scale * shift[1]).tolist()
        artifact.fitted = Linear(LINEAR[model](c), c.label)
    return artifact


def train(df: DataFrame, target: str = "DQ_SCORE", mode: str = "post_run", min_train: int | None = None, index: str = "calendar_date", only: str | None = None) -> Artifact:
    """Validate, take the model with the least error (the naive one included) or ``only``, and fit it to all labelled rows."""
    df = stored(for_mode(df, mode), "model-table")
    scores = {r.model: r.RMSE for r in rmse(walk_forward(df, target, min_train, index)).collect()}
    rows = labelled(df, target)
    columns = numeric_columns(rows, f"{target}_next")
    return fit(rows, only or min(scores, key=lambda m: (scores[m], m)), target, columns, f"{target}_next", mode, scores)


def forecast(df: DataFrame, artifact: Artifact, index: str = "calendar_date") -> DataFrame:
    """The forecast after the latest row."""
    return predict_as_of(df, artifact, None, index)


def as_of(df: DataFrame, date: str | None, index: str = "calendar_date") -> DataFrame:
    """The newest row not after a date."""
    rows = df if date is None else df.where(F.col(index) <= F.lit(date).cast("date"))
    return rows.orderBy(F.desc(index)).limit(1)


def predict(df: DataFrame, artifact: Artifact | None, index: str = "calendar_date") -> DataFrame:
    """date, model, predicted and missing for every row: what would have been served as of its date.

    ``missing`` counts the model's columns that the table lacks or the row has no finite value for; they read as 0.
    Without an artifact, or where the table has no column of it or the model gives no finite number, the last value
    is the forecast and the model's name says so.  The model is one expression of its columns.
    """
    target = artifact.target if artifact else "DQ_SCORE"
    date, last = F.col(index).alias("date"), F.col(target).cast("double")
    have = {c.lower() for c in df.columns}
    if artifact is None or not {f.lower() for f in artifact.features} & have:
        missing = F.lit(len(artifact.features) if artifact else 0).alias("missing")
        return df.select(date, F.lit(NAIVE if artifact is None else f"{NAIVE} (fallback)").alias("model"), last.alias("predicted"), missing)

    def finite(c: str) -> Column:
        value = F.col(f"`{c}`").cast("double")
        return F.when(F.abs(value) < float("inf"), value)  # NaN is above infinity

    served = {c: finite(c) for c in artifact.features if c.lower() in have}
    missing = F.array_size(F.filter(F.array(*served.values()), lambda v: v.isNull())) + (len(artifact.features) - len(served))
    got = artifact.column([F.coalesce(served[c], F.lit(0.0)) if c in served else F.lit(0.0) for c in artifact.features])
    rows = df.select(date, last.alias("last"), got.cast("double").alias("got"), missing.cast("int").alias("missing"))
    fine = F.coalesce(F.abs("got") < float("inf"), F.lit(False))
    return rows.select(
        "date",
        F.when(fine, artifact.model).otherwise(f"{NAIVE} (fallback)").alias("model"),
        F.when(fine, F.col("got")).otherwise(F.col("last")).alias("predicted"),
        "missing",
    )


def predict_as_of(df: DataFrame, artifact: Artifact | None, date: str | None, index: str = "calendar_date") -> DataFrame:
    """``predict`` for the newest row not after a date."""
    return predict(as_of(df, date, index), artifact, index)


def as_of_each(days: DataFrame, df: DataFrame, index: str = "calendar_date") -> DataFrame:
    """For each row of ``days`` (day), the newest date not after it and its score.

    Both sides are dealt into ranges of days, by split points drawn from the data, and the last measurement of the
    ranges before is carried into each: no pair is made, and no task holds more than its range.  A day asked for very
    often is spread over ranges by a number of its rows.  A null day has no measurement.
    """
    score = dict(df.dtypes)["DQ_SCORE"]
    asked = days.select(F.col("day").alias("at"), F.lit(None).cast(f"struct<date:date,DQ_SCORE:{score}>").alias("m"), F.xxhash64(F.monotonically_increasing_id()).alias("spread"))
    known = df.where(F.col(index).isNotNull()).select(F.col(index).cast("date").alias("at"), F.struct(F.col(index).cast("date").alias("date"), "DQ_SCORE").alias("m"), F.lit(0).cast("long").alias("spread"))
    rows = dealt(known.unionByName(asked), [F.col("at"), F.col("m").isNull(), F.col("spread")], "place", "as-of")
    rows = rows.select("at", "m", F.col("m").isNull().alias("asked"), "place", F.shiftright("place", 33).alias("part"))
    filled = carried_forward(rows, ["m"], "part", "place").where("asked")
    return filled.select(F.col("at").alias("day"), F.col("m.date").alias("date"), F.col("m.DQ_SCORE").alias("DQ_SCORE"))


def recent(df: DataFrame, k: int | None = 10, index: str = "calendar_date") -> DataFrame:
    """The last k measurements (all, if None), numbered from 1."""
    tail = df if k is None else df.orderBy(F.desc(index)).limit(k)
    return tail.select(F.row_number().over(Window.orderBy(index)).alias("measurement_num"), index, "DQ_SCORE", "TRUST_SCORE")
