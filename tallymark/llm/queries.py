"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import bpe, importance, license_scan, line_dedup, lm_score, media, mixing, near_dups, periodic_runs, quality, token_counts, topk, toxicity
from tallymark.llm.common import documents

BPE_PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES_PATH = public_tokenizers.path("piece_bpe_32k.model")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    both = bpe.round_trip(docs, BPE_PATH, public_tokenizers.PATTERN, memo=500_000, drop=("text",))
    return both.select("doc_id", *bpe.digests())


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = lm_score.score(docs, lm_score.learn(docs.where(lm_score.is_training())))
    held_out = (~lm_score.is_training()).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(documents(spark, sf_dir), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') as w
  from documents),
s as (
  select doc_id, case len(w) when 0 then [] when 1 then w
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
e as (select doc_id, unnest(s) as g from s),
n as (select doc_id, len(s)::bigint as n from s),
p as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from e x join e y on x.g = y.g and x.doc_id < y.doc_id group by all),
l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
u as (select a, b from l union select b, a from l),
r(a, b) as (select doc_id, doc_id from n union select r.a, u.b from r join u on r.b = u.a),
m as (select a as doc_id, min(b) as component_id from r group by a)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from n join m using (doc_id)
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(documents(spark, sf_dir).select("doc_id", "text"), PIECES_PATH)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies with their texts, which go through the global shuffle; the digest is taken after it."""
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "copy", "mix_key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    tagged = toxicity.tag(docs, model)
    return tagged.select(
        "doc_id",
        F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source and the language are their directories."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id"))
    files = documents(spark, sf_dir).select("doc_id", path.alias("path"), "text")
    return license_scan.scan_licenses(files).select("doc_id", "path", "own_license", "cosine", "license", "inherited_from")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    stored = media.wrap_texts(docs).drop("text")
    read = media.read_back(media.media_columns(stored))
    first = F.element_at("tracks", 1)
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), first["codec"]),
        F.concat(F.lit("kind="), first["kind"]),
        F.concat(F.lit("ms="), F.round(first["duration_s"] * 1000).cast("long")),
        F.concat(F.lit("samples="), first["n_samples"]),
        F.concat(F.lit("keyframes="), F.transform(first["keyframes"], lambda r: F.concat(r["start"], F.lit("+"), r["length"])).cast("string")),
    )
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text", "lang"), keep_text=False)
    base = [f.name for f in quality.BASE]
    return judged.select("doc_id", *base, "base_failed", "kept", F.round("class_distance", 4).alias("class_distance"), F.round("word_distance", 4).alias("word_distance"))


def _tail_repeated(words: str, doc_id: str) -> Column:
    """One document in ten, by a checksum of its id: from a word on, the words repeat with a period."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g, n = F.floor(h / 10).cast("long"), F.size(words).cast("long")
    start = g % n
    period = 1 + F.floor((n - start) / (3 + g % 8)).cast("long")
    tail = F.transform(words, lambda w, i: F.when(i < start, w).otherwise(F.get(words, (start + (i - start) % period).cast("int"))))
    return F.when((h % 10 == 0) & (n > 0), tail).otherwise(F.col(words))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", periodic_runs.words_of("text").alias("words"))
    texts = docs.select("doc_id", F.array_join(_tail_repeated("words", "doc_id"), " ").alias("text"))
    found = periodic_runs.periodic_runs(texts).drop("text").withColumn("best", periodic_runs.greatest("runs"))
    exponent = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        exponent.alias("exponent_milli"),
        periodic_runs.runs_digest("runs").alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    drawn = importance.resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_lm_score": op2_lm_score,
    "op3_top_k": op3_top_k,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_token_counts": op5_token_counts,
    "op6_mix_sources": op6_mix_sources,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_media_columns": op10_media_columns,
    "op11_quality_rules": op11_quality_rules,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_importance_resample": op13_importance_resample,
}

ORACLE_SQL: dict[str, str] = {"op3_top_k": OP3_SQL, "op4_near_duplicates": OP4_SQL, "op6_mix_sources": mixing.MIX_SQL}
