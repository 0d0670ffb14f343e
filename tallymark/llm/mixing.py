"""Mixing sources to target weights by Poisson replication.

A document of a source with target weight w and n documents is wanted
w * total / n times on average.  Its number of copies is that Poisson
distribution inverted at a point made from a hash of seed and document, so it
does not depend on partitioning and a lost task makes the same copies again.
Rates above ``RATE`` are split into equal parts drawn one by one, as sums of
Poisson variables are Poisson.  Copies are put in a global order by a hash.

Only counts by source meet in a shuffle before the copies are dealt.  They are
counted first: up to ``FEW`` sources are broadcast; more are joined back with
both sides salted, as one source may hold a third of the documents.

Defined results: a null source is a source of its own; documents without
doc_id are told apart by their text; repeated rows are drawn alike; sources
without a target weight (or with a weight that is null or not positive) get no
copies; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import sheltered, without

#: Largest rate that is inverted in one piece.
RATE = 16.0
#: Terms of the inverted distribution; the rest has a probability under 1e-17 at RATE.
TERMS = 64
#: Sources whose rates may be broadcast (well under a MB).
FEW = 10_000
#: Parts that a source's documents are dealt into when there are more.
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts, with 48 bits."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 48)


def poisson(rate: Column, u: Column) -> Column:
    """The Poisson distribution with this rate (at most RATE), inverted at u."""
    # rate and u travel with the sums, so that the hash behind u is not made anew for each term
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("n"), rate.alias("rate"), u.alias("u"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * s["rate"] / k
        more = F.struct(p.alias("p"), (s["c"] + p).alias("c"), k.cast("int").alias("n"), s["rate"].alias("rate"), s["u"].alias("u"))
        return F.when(s["c"] >= s["u"], s).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["n"])


def copies(rate: Column, *key: Column) -> Column:
    parts = F.greatest(F.lit(1), F.ceil(rate / RATE)).cast("int")
    draw = lambda i: poisson(rate / parts, uniform(*key, i))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), parts), draw), F.lit(0), lambda a, n: a + n)
    return F.when(rate > 0, total).otherwise(F.lit(0))


def rates(docs: DataFrame, weights: dict[str, float] | None, temper: float = 0.7) -> DataFrame:
    """source, n and rate; without weights, the targets are the sources' shares to the power ``temper``."""
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temper)))
    elif weights:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, weight double")
        n = n.join(given, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    else:
        n = n.withColumn("weight", F.lit(None).cast("double"))
    n = n.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0))
    total = n.agg(F.sum("n").alias("total"), F.sum("weight").alias("weights"))  # one row
    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(0.0)
    return n.crossJoin(F.broadcast(total)).select("source", "n", (share * F.col("total") / F.col("n")).alias("rate"))


@sheltered
def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 17, temper: float = 0.7, shuffle: bool = True
) -> DataFrame:
    """Documents repeated to the target weights, with copy (from 1) and mix_key, in a global random order."""
    docs = without(docs, "copy", "mix_key", "mix_source", "mix_rate")
    rate = rates(docs, weights, temper).select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.col("text").cast("binary"), 256))
    same = F.col("source").eqNullSafe(F.col("mix_source"))
    if docs.select("source").distinct().count() <= FEW:
        joined = docs.join(F.broadcast(rate), same)
    else:
        salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
        spread = rate.withColumn("mix_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.join(spread, same & (salt == F.col("mix_part"))).drop("mix_part")
    n = copies(F.col("mix_rate"), F.lit(seed), key)
    out = joined.withColumn("copy", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)))).drop("mix_source", "mix_rate")
    out = out.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), key, F.col("copy")).cast("binary")))
    return out.orderBy("mix_key") if shuffle else out


MIX_SQL = """
with n as (select source, count(*) as n from documents group by source),
t as (select source, n, pow(n::double, 0.7) as weight from n),
r as (select source, weight / sum(weight) over () * sum(n) over () / n as rate from t),
d as (
  select doc_id, source, rate, greatest(1, ceil(rate / 16.0))::int as parts
  from documents join r using (source)),
p as (
  select doc_id, source, rate / parts as rate,
    (('0x' || substr(md5('17|' || doc_id || '|' || part), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u, part
  from d, range(1, 65) as x(part) where part <= parts),
k as (
  select doc_id, source, part, u, k,
    sum(exp(-rate) * pow(rate, k) / gamma(k + 1)) over (partition by doc_id, part order by k) as cdf
  from p, range(0, 65) as y(k)),
c as (select doc_id, source, part, count(*) filter (where cdf < u) as n from k group by all),
m as (select doc_id, source, sum(n)::int as n from c group by all)
select doc_id, source, i::int as copy, md5('17|' || doc_id || '|' || i) as mix_key, sha256(text) as text_sha256
from m join documents using (doc_id, source), range(1, 4097) as z(i) where i <= n
"""
