"""The corpus pipeline on a small table: each stage against brute force on what the stage before kept."""

import random

import tiktoken
import public_tokenizers as P
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from tallymark.llm import line_dedup, mixing, toxicity
from tallymark.llm.queries import BPE_PATH

from test_llm_operators import brute_components, changed_lines, edit_alike

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def corpus(spark, folder):
    rng = random.Random(6)
    lines = changed_lines(rng, 20, 1, (20, 40))
    texts = [None, "", "  \n", "of.", "of.", "Ünïcode WÖRDS 日本語"]
    for i in range(60):
        own = [" ".join(f"u{i}-{k}-{n}" for n in range(rng.randint(6, 20))) for k in range(rng.randint(1, 4))]
        texts.append("\n".join([*own, rng.choice(lines)]))
    texts += texts[10:20] + [t.replace("-0-3 ", "-x ") for t in texts[20:30]]
    toxic = {i for i in range(6, len(texts)) if i % 7 == 0}
    texts = [t + "\nzapfoo you zapfool number " + str(i) if i in toxic else t for i, t in enumerate(texts)]
    rows = [(i, t, "en", "web" if i % 3 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    rows.append((None, "a text without an id", None, "web", None, None))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(len(texts))], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "near_dedup", "mixing", "byte_bpe"]

    model = toxicity.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    clean = stage["toxicity"](spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, clean)) == sorted(str(r) for r in docs.collect() if model.document(r.text or "")[0] < 0.5)
    assert 0 < len(rows) - len(clean) < len(rows) / 2 and not any("zapfoo" in (r.text or "") for r in clean)

    ids = [r.doc_id for r in clean]
    for name in ("line_dedup",):
        once = stage[name](spark, spark.createDataFrame(clean, SCHEMA), str(tmp_path)).collect()
        before, after = {r.doc_id: r.text for r in clean}, {r.doc_id: r.text for r in once}
        kept = [x for t in after.values() for x in (t or "").split("\n") if x.split()]
        every = [x for t in before.values() for x in (t or "").split("\n") if x.split()]
        assert len(set(map(str.lower, kept))) == len(kept)
        assert all(any(x.lower() == y.lower() or (len(x.split()) > 4 and edit_alike(x, y)) for y in kept) for x in every)
        assert set(after) <= set(ids) and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in once if r.doc_id != 0)
        assert after[0] is None and after[1] == "" and after[2] == "  \n"

    ordered = sorted((r for r in once if r.doc_id is not None), key=lambda r: r.doc_id)
    single = stage["near_dedup"](spark, spark.createDataFrame(clean, SCHEMA), str(tmp_path)).collect()
    named = sorted((r for r in clean if r.doc_id is not None), key=lambda r: r.doc_id)
    _, label = brute_components([r.text for r in named], 5, 80)
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == [r.doc_id for i, r in enumerate(named) if label[i] == i]
    assert sum(r.doc_id is None for r in single) == 1 and len(single) < len(clean) and len(ordered) <= len(named)

    mixed = stage["mixing"](spark, spark.createDataFrame(single, SCHEMA), str(tmp_path)).collect()
    rate = {r.source: r.rate for r in mixing.rates(spark.createDataFrame(single, SCHEMA), None).collect()}
    frame = spark.createDataFrame(single, SCHEMA).withColumn("rate", F.coalesce(*[F.when(F.col("source").eqNullSafe(k), v) for k, v in rate.items()]))
    key = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.col("text").cast("binary"), 256))
    want = {r.doc_id: r.n for r in frame.select("doc_id", mixing.copies(F.col("rate"), F.lit(17), key).alias("n")).collect()}
    assert {i: sum(r.doc_id == i for r in mixed) for i in want} == want

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(BPE_PATH), special_tokens={})
    for r in stage["byte_bpe"](spark, spark.createDataFrame(mixed, SCHEMA), str(tmp_path)).collect():
        assert r.ids == library.encode_ordinary(r.text or "") and r.round_trip and r.n_tokens == len(r.ids)


def test_run_is_its_stages_and_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "ids", "round_trip", "n_tokens"]
    assert line_dedup.FEW > 0
