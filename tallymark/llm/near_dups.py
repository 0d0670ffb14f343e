"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full sets.

A document's set holds its distinct shingles of ``words`` words (the whole
sequence where it has fewer), as 64-bit hashes.  ``COLLECTIONS`` small groups of
``HASHES`` minhashes are taken from it.  Instead of fresh hashes for every table,
a table's key joins two of the groups: 16 groups of 3 hashes make 120 tables of
6 hashes each, from 48 minhashes instead of 720.  Two documents with similarity
0.8 miss all tables with a probability of 2 in 10,000, and under 1 in 100,000 from
0.85 on.

Equal sets are one entry from the start.  Under a key, every entry is first paired with
the least one; pairs are dropped before confirmation if their set sizes rule the
similarity out or if the 48 minhashes agree in so few places (``LEAST``) that it is
below one in a million.  The confirmed ones make components.  Under each key that still
holds several components, all pairs between them then pass the same filters: as rows in
keys of up to ``SMALL`` entries, in blocks of ``BLOCK`` against ``BLOCK`` in larger ones,
where a block returns only pairs that join components.  All pairs left make regions of
like entries, so every pair of a key is ruled out, in one component or in one region.  A
region with more than one component is then compared across them: entries outside its largest component meet all its entries, in blocks of
``BLOCK`` against ``BLOCK``, and a block returns only links that join components.  So no
pair inside the largest component is made, and no row is made for a pair.

Defined results: a document without words, or null, has an empty set, is linked
with nothing and is kept; rows without doc_id take no part (their component is
null and they are kept); repeated rows get equal results; texts are read whole.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window  # noqa: I001
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.bpe import _Memo
from tallymark.llm.common import add_columns, texts_of, without, written
from tallymark.llm.graph import components

COLLECTIONS, HASHES = 16, 3
#: Minhashes of 48 that must agree: similarity 0.8 gives 38 on average, fewer than 24 in about 2 of a million pairs.
LEAST = 24
#: Entries of one side of a task that compares across components, on average.
BLOCK = 2048
#: Shingles of one side of such a task, on average: some 12 MB of text and 8 MB of hashes.
SETS = 1_000_000
#: Entries of a key up to which its pairs are rows.
SMALL = 8
#: Ids that may be broadcast (8 bytes each) to pick their texts without shuffling all texts.
FEW = 1_000_000

_RNG = np.random.default_rng(20240229)
#: Odd multipliers of the minhashes.
MULTIPLIERS = (_RNG.integers(1, 1 << 62, COLLECTIONS * HASHES, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_IDS = _Memo(lambda word: xxhash.xxh3_64_intdigest(word))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_IDS.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(ids) - words + 1)
    h = np.full(n, len(tokens[:words]), np.uint64)
    for k in range(min(words, len(ids))):
        h = _mixed(h * _ODD[0] + ids[k : k + n] * _ODD[1] + np.uint64(k))
    return np.unique(h)


def minhashes(found: np.ndarray) -> np.ndarray:
    """48 minhashes of 32 bits."""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max)
    for i in range(0, len(found), 512):
        part = found[None, i : i + 512]
        least = np.minimum(least, _SPUN(part).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _SPUN(part: np.ndarray) -> np.ndarray:
    x = part * MULTIPLIERS
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x


def sketch(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """Add n_shingles, the set's fingerprint (null where empty) and its minhashes."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [shingles(t, words) for t in texts_of(batch, text)]
        marks = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        mins = [minhashes(s).view(np.int32) if len(s) else np.empty(0, np.int32) for s in sets]
        ends = np.cumsum([0, *map(len, mins)], dtype=np.int32)
        flat = np.concatenate(mins) if mins else np.empty(0, np.int32)
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

    fields = [
        T.StructField("n_shingles", T.LongType(), False),
        T.StructField("mark", T.BinaryType(), True),
        T.StructField("mins", T.ArrayType(T.IntegerType()), False),
    ]
    return add_columns(docs, fields, make, drop=(text,))


def table_keys(mins: Column) -> Column:
    """The keys of all tables: pairs of collections, hashed with the table's number."""
    one = [F.xxhash64(*[F.element_at(mins, c * HASHES + h + 1) for h in range(HASHES)]) for c in range(COLLECTIONS)]
    hashed = F.array(*one)
    tables = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j")) for i, j in combinations(range(COLLECTIONS), 2)])
    return F.transform(tables, lambda t: F.xxhash64(t["i"], t["j"], F.element_at(hashed, t["i"]), F.element_at(hashed, t["j"])))


def _possible(pairs: DataFrame, entries: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) that sizes and minhashes do not rule out."""
    a = entries.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("mins").alias("ma"))
    b = entries.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("mins").alias("mb"))
    both = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    agree = F.size(F.filter(F.zip_with("ma", "mb", lambda x, y: x == y), lambda x: x))
    return both.where(agree >= LEAST).select("a", "b")


def _texts(ids: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """id and text (t) of some documents, one row for each id."""
    ids = written(ids, "near-ids")
    ids = F.broadcast(ids) if ids.count() <= FEW else ids
    return docs.select(F.col("doc_id").alias("id"), F.col(text).alias("t")).join(ids, "id", "left_semi").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, threshold: int, text: str) -> DataFrame:
    """Pairs whose full sets have the similarity."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = written(_texts(ids, docs, text).withColumnRenamed("t", text), "near-texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col(text).alias("x")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col(text).alias("y")), "b")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        got = []
        for x, y in zip(texts_of(batch, "x"), texts_of(batch, "y")):
            s, t = shingles(x, words), shingles(y, words)
            common = len(np.intersect1d(s, t, assume_unique=True))
            got.append(100 * common >= threshold * (len(s) + len(t) - common))
        return [pa.array(got, pa.bool_())]

    linked = add_columns(both, [T.StructField("linked", T.BooleanType(), False)], make, drop=("x", "y"))
    return written(linked, "near-links").where("linked").select("a", "b")


def _pairs_across(ids: np.ndarray, sides: np.ndarray, comps: np.ndarray, sizes: np.ndarray, mins: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Possible pairs between components of two blocks, just enough of them to join what any of them joins."""
    left, right = (np.flatnonzero(sides[:, k]) for k in (0, 1))
    label = np.unique(comps, return_inverse=True)[1]
    out = []
    for i in left:
        some = right[label[right] != label[i]]
        some = some[100 * np.minimum(sizes[some], sizes[i]) >= threshold * np.maximum(sizes[some], sizes[i])]
        some = some[(mins[some] == mins[i]).sum(1) >= LEAST]
        for at in np.unique(label[some], return_index=True)[1]:
            j = some[at]
            out.append((int(ids[i]), int(ids[j])))
            label[label == label[j]] = label[i]
    return out


def _within_keys(met: DataFrame, entries: DataFrame, groups: DataFrame, threshold: int) -> DataFrame:
    """Possible pairs (a, b) between the components under each key, of which there may be any number."""
    marks = [F.bit_xor(F.xxhash64("id", F.lit(k))) for k in (0, 1)]
    rows = met.where("n > 2").join(groups, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    rows = written(rows, "near-keys")
    parts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"), *[m.alias(f"m{k}") for k, m in enumerate(marks)])
    # keys with the same entries are one
    open_keys = parts.where("c0 <> c1").groupBy("n", "m0", "m1").agg(F.min("key").alias("key")).select("key", "n")
    rows = written(rows.join(open_keys, "key"), "near-open")
    few = rows.where(F.col("n") <= SMALL)
    x, y = few.select("key", F.col("id").alias("a"), F.col("c").alias("ca")), few.select("key", F.col("id").alias("b"), F.col("c").alias("cb"))
    pairs = x.join(y, "key").where("a < b and ca <> cb").select("a", "b").distinct()
    many = rows.where(F.col("n") > SMALL).withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("place", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")))
    many = many.join(entries.select("id", "n_shingles", "mins"), "id")
    many = many.select("key", "id", "c", "n_shingles", "mins", "place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    many = many.withColumn("lo", F.least("place", "other")).withColumn("hi", F.greatest("place", "other"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(block: pa.Table) -> pa.Table:
        ids, c, sizes, place, lo, hi = (block.column(x).to_numpy() for x in ("id", "c", "n_shingles", "place", "lo", "hi"))
        mins = block.column("mins").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        found = _pairs_across(ids, np.stack([place == lo, place == hi], axis=1), c, sizes, mins, threshold)
        return pa.Table.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    large = many.groupBy("key", "lo", "hi").applyInArrow(compare, "a bigint, b bigint")
    return _possible(pairs, entries, threshold).unionByName(large.distinct())


def _links_across(ids: list[int], sides: list[tuple[bool, bool]], comps: list[int], texts: list[str], mins: np.ndarray, words: int, threshold: int) -> list[tuple[int, int]]:
    """Links between components of two blocks, at most one for each pair of components that it joins."""
    sets = [shingles(t or "", words) for t in texts]
    sizes, comp = np.array([len(s) for s in sets]), np.array(comps)
    left, right = ([i for i, s in enumerate(sides) if s[k]] for k in (0, 1))
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    out = []
    right_at = np.array(right)
    for i in left:
        near = (mins[right_at] == mins[i]).sum(1) >= LEAST
        near &= 100 * np.minimum(sizes[right_at], sizes[i]) >= threshold * np.maximum(sizes[right_at], sizes[i])
        near &= comp[right_at] != comp[i]
        some = right_at[near]
        if not len(some):
            continue
        flat = np.concatenate([sets[j] for j in some])
        place = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
        common = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
        linked = 100 * common >= threshold * (sizes[i] + sizes[some] - common)
        for j in some[linked]:
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a != b:
                joined[max(a, b)] = min(a, b)
                out.append((ids[i], ids[int(j)]))
    return out


def _across(tried: DataFrame, entries: DataFrame, groups: DataFrame, docs: DataFrame, words: int, threshold: int, text: str) -> DataFrame:
    """Links (a, b) between the components of each region, in blocks bounded in entries and in shingles."""
    regions = components(tried).withColumnRenamed("component", "region")
    named = regions.join(groups, "node", "left").select(F.col("node").alias("id"), "region", F.coalesce("component", "node").alias("c"))
    named = written(named.join(entries.select("id", "n_shingles", "mins"), "id"), "near-regions")
    sizes = named.groupBy("region", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    largest = F.max_by(F.struct("c", "n", "s"), F.struct("n", "c")).alias("most")
    mixed = sizes.groupBy("region").agg(largest, F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / SETS))
    most = F.col("most")
    mixed = mixed.select("region", most["c"].alias("largest"), blocks(most["n"], most["s"]).alias("b_in"), blocks(F.col("n") - most["n"], F.col("s") - most["s"]).alias("b_out"))
    rows = named.join(mixed, "region")
    inside = F.col("c") == F.col("largest")
    place = F.when(inside, F.col("b_out") + F.pmod(F.xxhash64("id"), F.col("b_in"))).otherwise(F.pmod(F.xxhash64("id"), F.col("b_out")))
    others = F.when(inside, F.sequence(F.lit(0), F.col("b_out") - 1)).otherwise(F.sequence(F.lit(0), F.col("b_out") + F.col("b_in") - 1))
    rows = rows.withColumn("place", place).withColumn("others", others).drop("n_shingles")
    rows = written(rows, "near-across")
    met = _texts(rows.select("id"), docs, text).join(rows, "id").select("id", "region", "c", "t", "mins", "place", F.explode("others").alias("other"))
    met = met.withColumn("lo", F.least("place", "other")).withColumn("hi", F.greatest("place", "other"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(block: pa.Table) -> pa.Table:
        place, lo, hi = (block.column(c).to_pylist() for c in ("place", "lo", "hi"))
        sides = [(p == x, p == y) for p, x, y in zip(place, lo, hi)]
        found = []
        if any(a for a, _ in sides) and any(b for _, b in sides):
            mins = block.column("mins").combine_chunks().flatten().to_numpy().reshape(block.num_rows, -1)
            found = _links_across(*(block.column(c).to_pylist() if c != "place" else sides for c in ("id", "place", "c", "t")), mins, words, threshold)
        return pa.Table.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return met.groupBy("region", "lo", "hi").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80, text: str = "text") -> DataFrame:
    """Every row with n_shingles, component_id (smallest doc_id reachable) and kept; ``threshold`` is in hundredths."""
    docs = without(docs, "n_shingles", "mark", "mins", "component_id", "kept")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text))
    drawn = written(sketch(plain, words, text), "near-sketch")
    fit = drawn.where("mark is not null and doc_id is not null")
    entries = fit.groupBy("mark").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("mins").alias("mins"))
    entries = written(entries, "near-entries")
    of_key = Window.partitionBy("key")
    # the entries lie in few files; making 120 keys of each is work for all tasks
    dealt = entries.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    met = dealt.select("id", F.explode(table_keys(F.col("mins"))).alias("key"))
    met = met.withColumn("first", F.min("id").over(of_key)).withColumn("n", F.count("*").over(of_key))
    met = written(met.where("n > 1"), "near-met")
    pairs = met.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    tried = written(_possible(pairs, entries, threshold), "near-pairs")
    links = _confirmed(tried, plain, words, threshold, text)
    joined = components(links)
    tried = tried.unionByName(written(_within_keys(met, entries, joined, threshold), "near-pairs"))
    more = written(_across(tried, entries, joined, plain, words, threshold, text), "near-across")
    groups = components(links.unionByName(more))
    named = entries.select("mark", "id").join(groups, F.col("id") == F.col("node"), "left").select("mark", F.coalesce("component", "id").alias("component_id"))
    known = drawn.where("mark is not null and doc_id is not null").join(named, "mark")
    alone = drawn.where("mark is null or doc_id is null").withColumn("component_id", F.col("doc_id"))
    out = known.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
