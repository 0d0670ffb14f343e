"""Connected components of a link table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) for every node of a link.

    Each round, every node points to the least of itself and its neighbours, and the links
    between the nodes pointed to, each once, are what the next round reads: no link is read
    again once it lies inside a group.  The first round takes the least node, so that stars
    around it are done at once; later ones the least in an order of the round's own, so that
    chains shrink by a share in every round, however they are numbered.  Then the pointers are
    followed back, from the few of the last round to all nodes, and each group is named by its
    least node.  Pointers and links are written to the shared folder; nothing but the test for
    links that are left comes to the driver.  An empty link table gives an empty result.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = both.where("x is not null and y is not null and x <> y")
    both = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    rounds: list[DataFrame] = []
    while not rounds or not both.isEmpty():
        order = lambda c, k=len(rounds): F.struct((F.xxhash64(c, F.lit(k)) if k else F.col(c)).alias("at"), F.col(c).alias("node"))
        least = F.least(order("x"), F.min(order("y")))["node"]
        to = written(both.groupBy("x").agg(least.alias("to")).withColumnRenamed("x", "node"), "pointers")
        rounds.append(to)
        ends = both.join(to.select(F.col("node").alias("x"), F.col("to").alias("tx")), "x").join(to.select(F.col("node").alias("y"), F.col("to").alias("ty")), "y")
        both = written(ends.where("tx <> ty").select(F.col("tx").alias("x"), F.col("ty").alias("y")).distinct(), "links")
    found = rounds.pop().withColumnRenamed("to", "root")
    for to in reversed(rounds):
        beyond = found.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
        found = written(to.join(beyond, "to", "left").select("node", F.coalesce("beyond", "to").alias("root")), "pointers")
    named = found.groupBy("root").agg(F.min("node").alias("component"))
    return written(found.join(named, "root").select("node", "component"), "labels")
