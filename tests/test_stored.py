"""Published versions: what is committed, what readers see, and what is removed."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymark.operators import forecast, stored
from tallymark.plans import reports


def table(spark, n, plus=0):
    return spark.range(n).select("id", (F.col("id") + plus).cast("string").alias("s"), F.lit(None).cast("string").alias("nothing"), F.lit("").alias("empty"), (F.col("id") / 3).alias("x"))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_a_version_reads_back_as_it_was_written(spark, tmp_path, fmt):
    folder = str(tmp_path / fmt)
    assert stored.published(spark, folder) is None
    stored.publish(table(spark, 5), folder, fmt)
    assert rows(stored.published(spark, folder)) == rows(table(spark, 5))
    stored.publish(table(spark, 3, plus=7), folder, fmt)
    assert rows(stored.published(spark, folder)) == rows(table(spark, 3, plus=7))


def test_what_does_not_read_back_is_not_committed(spark, tmp_path):
    df = spark.createDataFrame([("a\nb",)], "s string")
    with pytest.raises(ValueError, match="read back"):
        stored.publish(df, str(tmp_path), "csv")
    assert stored.versions(spark, str(tmp_path)) == [] and stored.published(spark, str(tmp_path)) is None
    quoted = spark.createDataFrame([('a "b", \\N',), ("\\",), (None,)], "s string")
    stored.publish(quoted, str(tmp_path), "csv")
    assert rows(stored.published(spark, str(tmp_path)).na.fill("-")) == rows(quoted.na.fill("-"))


def test_readers_pass_over_what_is_broken_or_not_committed(spark, tmp_path):
    folder = str(tmp_path)
    first = stored.publish(table(spark, 5), folder)
    second = stored.publish(table(spark, 6), folder)
    third = stored.publish(table(spark, 7), folder)
    table(spark, 9).write.parquet(f"{folder}/data/9{first}")  # a writer that never came to its commit
    assert stored.published(spark, folder).count() == 7
    next(p for p in Path(folder, "data", third).glob("part-*") if p.stat().st_size).unlink()  # rows are lost
    assert stored.published(spark, folder).count() == 6
    assert stored.published(spark, folder, verify=False).count() < 7
    Path(folder, "committed", f"{second}.json").write_text("{")
    for p in Path(folder, "committed").glob(".*.crc"):
        p.unlink()
    assert stored.published(spark, folder).count() == 5
    assert json.loads(Path(folder, "committed", f"{first}.json").read_text())["rows"] == 5


def test_old_versions_and_leftovers_are_removed(spark, tmp_path):
    folder = str(tmp_path)
    table(spark, 1).write.parquet(f"{folder}/data/00000000000000000001-left")
    names = [stored.publish(table(spark, n), folder, keep=2) for n in range(1, 5)]
    assert stored.versions(spark, folder) == names[-2:]
    assert sorted(p.name for p in Path(folder, "data").iterdir() if not p.name.startswith(".")) == names[-2:]


def test_the_digest_does_not_depend_on_order_and_sees_every_cell(spark):
    df = table(spark, 50)
    assert stored.digest(df) == stored.digest(df.repartition(7).orderBy(F.desc("id")))
    assert stored.digest(df) != stored.digest(df.withColumn("x", F.when(F.col("id") == 3, 0.0).otherwise(F.col("x"))))
    assert stored.digest(df.where("id < 0"))["rows"] == 0
    assert stored.digest(df.withColumn("m", F.create_map("s", "x")))["rows"] == 50


def test_artifacts_by_manifest(spark, tmp_path):
    folder = str(tmp_path)
    assert reports.published_artifact(spark, folder) is None
    for name in ("a", "b"):
        reports.publish_artifact(spark, forecast.Artifact(forecast.NAIVE, name, [name], "post_run", {}), folder)
    assert reports.published_artifact(spark, folder).target == "b"
    reports.publish_text(spark, "not an artifact", f"{folder}/dq_score_next_forecaster")
    assert reports.published_artifact(spark, folder) is None


def test_release_removes_intermediate_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "shared_folder", lambda spark: str(tmp_path / "application"))
    assert stored.stored(spark.range(4), "four").count() == 4
    assert list(tmp_path.rglob("four-*"))
    stored.release(spark)
    assert not list(tmp_path.rglob("four-*"))


def test_shuffle_files_go_as_soon_as_a_table_is_written(spark, tmp_path):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    before, asked = files(), spark.conf.get(stored.CLEAN_UP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    df.write.parquet(str(tmp_path / "plain"))
    assert files() - before  # as Spark has it by itself
    before = files()
    out = stored.stored(df, "grouped")
    for _ in range(100):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(stored.CLEAN_UP, None) == asked
    assert rows(out) == rows(df)
