"""Exact top-k inner products by aggregation without random access.

Candidates are dealt into blocks and queries into blocks; each pair of blocks is
one task.  In a block, every dimension is a list of the candidates, sorted by
their part of the score (which end comes first depends on the sign of the
query's component).  The lists are read from the top by cursors that advance in
rounds; a round adds up what the cursors have met of the candidates still in play, for all
queries at once as products of matrices.  Each
candidate's score is bounded from below with the least entry of the lists in
which it was not met, from above with the entries at the cursors.  A candidate
whose upper bound is under the k-th lower bound of a query is out for it, and is
no longer read when it is out for all; when few are left, or the lists are read
through, the final scores are resolved.  Queries first meet one block of
candidates; the k-th score found there bounds them in all other blocks from the
start.  The blocks' winners then meet in one ranking for each query.

Defined results: vectors that are null or hold null or non-finite components
take no part, neither do empty ones; only vectors as long as the query's are
candidates; a query's own id is never its result; ties go to the smaller id;
repeated rows are candidates each; fewer than k candidates are all returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import written

#: Candidates and queries of one task at most, on average.
CANDIDATES, QUERIES = 4096, 512
#: Depth of each round as a part of the lists.
ROUNDS = (0.1, 0.2, 0.35, 0.55, 1.0)


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))


def quantised(vector: str, scale: int = 1024) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def block_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query row, candidate row, score) of each query's k best in a block, ties to the smaller id.

    ``floor`` is a score for each query below which nothing is wanted.
    """
    n, d = x.shape
    order = np.argsort(x, axis=0, kind="stable")
    sorted_x = np.take_along_axis(x, order, axis=0).astype(float)
    up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    active, here = np.arange(len(q)), np.arange(n)
    place = np.empty((n, d), np.int32)  # of each candidate in the list of each dimension
    np.put_along_axis(place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    out = []
    for part in ROUNDS:
        depth = min(n, max(k, int(np.ceil(n * part))))
        a, b = up[active].T, down[active].T
        mine, own_x = place[here], x[here].astype(float)
        high, low = mine >= n - depth, mine < depth  # met by the cursors from the high and the low end
        # not met: at most the entry at the cursor, at least the last of the list
        most = np.where(high, own_x, sorted_x[n - depth]) @ a + np.where(low, own_x, sorted_x[depth - 1]) @ b
        least = np.where(high, own_x, sorted_x[0]) @ a + np.where(low, own_x, sorted_x[-1]) @ b
        own = ids[here, None] == query_ids[active][None, :]
        lower = np.where(own, -np.inf, least)
        upper = np.where(own, -np.inf, most)
        kth = np.partition(lower, len(here) - k, axis=0)[len(here) - k] if len(here) > k else np.full(len(active), -np.inf)
        left = (upper >= np.maximum(kth, floor[active])) & ~own
        few = left.sum(0) <= 4 * k if depth < n else np.ones(len(active), bool)
        for j in np.flatnonzero(few):
            rows = here[left[:, j]]
            scores = x[rows] @ q[active[j]]
            best = np.lexsort((ids[rows], -scores))[:k]
            out.append((np.full(len(best), active[j]), rows[best], scores[best]))
        active = active[~few]
        if not len(active):
            break
        here = here[left[:, ~few].any(1)]
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query."""
    rows = vectors.where(F.col(key).isNotNull() & usable(vector)).select(
        F.col(key).cast("long").alias("id"), quantised(vector, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, query_blocks = max(1, -(-n // candidates)), max(1, -(-n_queries // queries))
    dealt = lambda parts, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dim = F.size("v").alias("dim")
    left = rows.where("q").select("id", "v", dim, dealt(query_blocks, 1).alias("qb"))
    right = rows.select("id", "v", dim, dealt(blocks, 2).alias("cb"), every(query_blocks).alias("qb"))

    def run(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        query_ids, ids = qs["id"].to_numpy(), cs["id"].to_numpy()
        floor = qs["floor"].to_numpy(float, na_value=-np.inf)
        i, j, s = block_top(ids, np.stack(cs["v"]).astype(np.int64), query_ids, np.stack(qs["v"]).astype(np.int64), k, floor)
        return pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[j], "score": s})

    keys = ("dim", "cb", "qb")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731 (both sides come from the same rows)
    meet = lambda qs, cs: fresh(qs).groupBy(*keys).cogroup(cs.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")
    found = meet(left.select("*", F.lit(0).alias("cb"), F.lit(None).cast("long").alias("floor")), right.where("cb = 0"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if blocks > 1:
        found = written(found, "top-first")
        floors = found.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
        bounded = left.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", "dim", "qb", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))).alias("cb"), "floor")
        found = found.unionByName(meet(bounded, right.where("cb > 0")))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
