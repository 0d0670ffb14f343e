"""Linear models from sums of products, which add up over any split of the rows.

``Moments`` holds the number of rows, the sums of columns and label, and the sums of their products.  Ridge, elastic
net and Bayesian ridge need nothing else of their training rows, so one pass gives a fit, and the moments before each
range of an ordered table give every fold of a walk-forward validation: no row is sent to more than one task.

Columns are first shifted by their means over the whole table and divided by their deviations.  That changes no result,
as folds standardise again, but keeps the products from cancelling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.stored import stored

#: A column that varies by less than this share of its variance over the whole table is constant.
FLAT = 1e-12


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


@dataclass
class Centred:
    """Products of standardised columns and the centred label, and how they were standardised."""

    n: int
    zz: np.ndarray
    zy: np.ndarray
    yy: float
    mean: np.ndarray
    scale: np.ndarray
    label: float


class Moments:
    """n, sums and sums of products of the columns with the label as last one."""

    def __init__(self, width: int, n: int = 0, sums: np.ndarray | None = None, products: np.ndarray | None = None):
        self.n = n
        self.sums = np.zeros(width + 1) if sums is None else sums
        self.products = np.zeros((width + 1, width + 1)) if products is None else products

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Moments:
        rows = np.column_stack([x, y])
        return cls(x.shape[1], len(rows), rows.sum(0), rows.T @ rows)

    def add(self, x: np.ndarray, y: float) -> None:
        row = np.append(x, y)
        self.n += 1
        self.sums += row
        self.products += np.outer(row, row)

    def __add__(self, other: Moments) -> Moments:
        return Moments(len(self.sums) - 1, self.n + other.n, self.sums + other.sums, self.products + other.products)

    def to_bytes(self) -> bytes:
        return np.concatenate([[float(self.n)], self.sums, self.products.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Moments:
        flat = np.frombuffer(data)
        k = round(((4 * len(flat) - 3) ** 0.5 - 1) / 2)  # 1 + k + k^2 numbers
        return cls(k - 1, int(flat[0]), flat[1 : k + 1].copy(), flat[k + 1 :].reshape(k, k).copy())

    def centred(self, scaled: bool = True) -> Centred:
        means = self.sums / self.n
        products = self.products - np.outer(means, self.sums)
        spread = np.diag(products)[:-1] / self.n
        flat = spread <= FLAT
        scale = np.where(flat | (not scaled), 1.0, np.sqrt(np.where(flat, 1.0, spread)))
        zz, zy = products[:-1, :-1] / np.outer(scale, scale), products[:-1, -1] / scale
        zz[flat], zz[:, flat], zy[flat] = 0.0, 0.0, 0.0
        return Centred(self.n, zz, zy, float(products[-1, -1]), means[:-1], scale, float(means[-1]))


def ridge(c: Centred, alpha: float = 5.0) -> np.ndarray:
    """Least squares with a squared penalty."""
    return np.linalg.solve(c.zz + alpha * np.eye(len(c.zz)), c.zy)


def elastic_net(c: Centred, alpha: float = 0.1, l1: float = 0.5, rounds: int = 10_000, tolerance: float = 1e-4) -> np.ndarray:
    """Coordinate descent on (1/2n)|y - Zw|^2 + alpha l1 |w|_1 + alpha (1 - l1) / 2 |w|^2, on products alone."""
    size = np.diag(c.zz).copy()
    w, fitted = np.zeros(len(size)), np.zeros(len(size))  # fitted: Z'Zw
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(size):
            old = w[j]
            rho = c.zy[j] - fitted[j] + size[j] * old
            w[j] = np.sign(rho) * max(abs(rho) - c.n * alpha * l1, 0.0) / (size[j] + c.n * alpha * (1 - l1))
            if w[j] != old:
                fitted += c.zz[:, j] * (w[j] - old)
                most = max(most, abs(w[j] - old))
        if most <= tolerance * max(np.abs(w).max(initial=0.0), 1e-12):
            break
    return w


def bayesian_ridge(c: Centred, rounds: int = 300, tolerance: float = 1e-3, prior: float = 1e-6) -> np.ndarray:
    """Evidence maximisation of noise and weight precision with weak gamma priors, in the basis of eigenvectors."""
    eigen, basis = np.linalg.eigh(c.zz)
    real = eigen > 1e-10 * max(eigen.max(initial=0.0), 1e-300)
    eigen, basis = eigen[real], basis[:, real]
    along = basis.T @ c.zy
    beyond = max(c.yy - float((along**2 / eigen).sum()), 0.0)  # what no weights explain
    noise, weight = 1.0 / (c.yy / c.n + 1e-15), 1.0
    w = np.zeros(len(c.zz))
    for _ in range(rounds):
        old, ratio = w, weight / noise
        w = basis @ (along / (eigen + ratio))
        gamma = float((noise * eigen / (weight + noise * eigen)).sum())
        weight = (gamma + 2 * prior) / (float(w @ w) + 2 * prior)
        left = beyond + float((along**2 / eigen * (ratio / (eigen + ratio)) ** 2).sum())
        noise = (c.n - gamma + 2 * prior) / (left + 2 * prior)
        if np.abs(w - old).sum() < tolerance:
            break
    return w


def fit(solve, x: np.ndarray, y: np.ndarray, **how) -> Linear:
    """A model of rows in memory; columns are centred but not scaled."""
    mean, unit = x.mean(0), x.std(0)
    unit = np.where(unit == 0, 1.0, unit)
    c = Moments.of((x - mean) / unit, y).centred(scaled=False)
    c.zz, c.zy = c.zz * np.outer(unit, unit), c.zy * unit
    w = solve(c, **how)
    return Linear(w, float(y.mean() - mean @ w))


# --- over a DataFrame with an array of columns ``x`` and a label ``y`` ---


def shift_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations (1 where constant) of all columns: a row for each column comes to the driver."""
    stats = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    found = sorted((r.i, r.m, r.s) for r in stats.collect())
    spread = np.array([s for _, _, s in found])
    mean = np.array([m for _, m, _ in found])
    return mean, np.where(spread <= 1e-13 * np.abs(mean), 1.0, spread)


def _matrix(pdf: pd.DataFrame, shift: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (np.stack(pdf["x"].to_numpy()) - shift[0]) / shift[1]


def block_moments(rows: DataFrame, shift: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """block and the moments of its rows; a block's rows must fit a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = Moments.of(_matrix(pdf, shift), pdf["y"].to_numpy(float))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "moments": [m.to_bytes()]})

    return rows.select("block", "y", "x").groupBy("block").applyInPandas(one, "block long, moments binary")


def total(rows: DataFrame, shift: tuple[np.ndarray, np.ndarray], fan: int = 64) -> Moments:
    """The moments of all rows: each task sums its own, and those are summed ``fan`` at a time until one is left."""

    def own(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Moments(len(shift[0]))
        for pdf in parts:
            if len(pdf):
                m = m + Moments.of(_matrix(pdf, shift), pdf["y"].to_numpy(float))
        yield pd.DataFrame({"moments": [m.to_bytes()]})

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Moments(len(shift[0]))
        for pdf in parts:
            for data in pdf["moments"]:
                m = m + Moments.from_bytes(data)
        yield pd.DataFrame({"moments": [m.to_bytes()]})

    sums = rows.select("y", "x").mapInPandas(own, "moments binary")
    parts = sums.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan)
        sums = sums.coalesce(parts) if parts > fan else sums.repartition(parts)
        sums = sums.mapInPandas(join, "moments binary")
    return Moments.from_bytes(bytes(sums.first()[0]))


def before_blocks(blocks: DataFrame, top: int) -> DataFrame:
    """block and the moments of all blocks before it, for blocks 0 to ``top``; none for the first.

    Sums over 1, 2, 4, ... blocks are joined to the blocks that far on, so the number of rounds grows with the
    logarithm of the number of blocks, and no task holds more than two moments.
    """

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            both = [(Moments.from_bytes(a) + Moments.from_bytes(b)).to_bytes() if b is not None else a for a, b in zip(pdf["moments"], pdf["earlier"])]
            yield pd.DataFrame({"block": pdf["block"], "moments": both})

    sums, reach = stored(blocks, "moments"), 1
    while reach <= top:
        earlier = sums.select((F.col("block") + reach).alias("block"), F.col("moments").alias("earlier"))
        sums = stored(sums.join(earlier, "block", "left").mapInPandas(add, "block long, moments binary"), "moments")
        reach *= 2
    return sums.select((F.col("block") + 1).alias("block"), "moments")
