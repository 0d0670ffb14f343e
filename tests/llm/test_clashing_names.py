"""Tables whose further columns have the names that operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import license_scan, line_dedup, lm_score, mixing

NAMES = (
    "line_key clashes kept_id kept_h kept_places kept_lines n_lines id key line lines block codes share scan_row scan_dir from_dir own_license mix_rate mix_source mix_part "
    "copy lm_row n_tokens score base_score train_tokens n_known row words bucket flush n entry a b x y component label region"
).split()
TEXTS = ["the cat sat on the mat today", "the cat sat on the mat today", "MIT License", None, "", "one two three four five six\nthe cat sat on the mat today"] * 3


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return plain, plain.withColumns({n: F.concat(F.lit(f"{n}-"), "doc_id") for n in NAMES})


OPERATORS = {
    "lm_score": lambda d: lm_score.score(d, lm_score.learn(d.select("doc_id", "text"))),
    "mix": lambda d: mixing.mix(d, {"s0": 1.0, "s1": 2.0, "s2": 1.0}),
    "line_dedup": line_dedup.dedup_lines,
    "license_scan": lambda d: license_scan.scan_licenses(d.withColumn("path", F.concat(F.col("source"), F.lit("/"), "doc_id"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_column_is_lost_or_changed(tables, name):
    plain, clash = (OPERATORS[name](t) for t in tables)
    made = set(plain.columns)
    want = sorted((tuple(r) for r in plain.collect()), key=str)
    rows = clash.collect()
    assert set(clash.columns) == made | set(NAMES)
    got = sorted((tuple(r[c] for c in plain.columns) for r in rows), key=str)
    for g, w in zip(got, want, strict=True):
        assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(g, w))
    assert all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in NAMES if n not in made)


def test_pipeline_stages_keep_them(spark, tables):
    docs = tables[1]
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns
        own = {"n_lines", "copy"}  # made by an operator, whose column stands
        assert all(r[n] == f"{n}-{r.doc_id}" for r in out.collect() for n in NAMES if n not in own)
