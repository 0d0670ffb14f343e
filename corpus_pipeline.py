"""The corpus pipeline: five stages over ``documents``, each over all that the stage before kept.

A document with a text that toxicity tagging rejects goes; lines seen before go,
and documents of which no word is left with them; one document of each group of
near-duplicates stays; sources are mixed to tempered weights by replication; and
texts are encoded.  Every stage but the last returns the columns of ``documents``.

Defined results: a null or empty text is clean, keeps its one blank line, resembles
nothing and has no tokens, so its document stays; a null doc_id or source is a value like
others; repeated rows are rows of one document and stay together, but for near_dedup, which
drops all rows of a document that is not kept; other columns are carried through, and where
they have the name of a column made here (ids, n_tokens, round_trip), the new one stands;
empty tables give an empty result.  doc_id is taken to name one text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import bpe, line_dedup, mixing, near_dups, toxicity
from tallymark.llm.common import documents, written
from tallymark.llm.queries import BPE_PATH


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    tagged = toxicity.tag(docs, model, score="toxicity", spans="toxic_spans")
    return tagged.where("toxicity < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return done.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(docs, words=5, threshold=80)
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, n_tokens and whether the ids decode to the text's bytes."""
    both = bpe.round_trip(docs, BPE_PATH, public_tokenizers.PATTERN, memo=300_000)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.withColumn("round_trip", same).withColumn("n_tokens", F.size("ids").cast("long")).drop("decoded")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The first and the last stage (a trained field, a tokenizer) are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
