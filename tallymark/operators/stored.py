"""Tables written to the folder that the driver and all executors share: intermediate ones, and published ones with manifests.

An intermediate table lies in a folder of its application, which ``release`` removes.  A published table has versions:
its files are written aside, read back and counted, and only then committed by renaming a manifest into place.  Readers
see committed versions alone, and pass over one whose files no longer agree with its manifest.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Spark's setting that removes the shuffle files of a query at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``.

    A local session without that setting uses its warehouse; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path there."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back.

    Unlike a cached table it survives lost executors, and each reader reads its columns only.  Nothing goes back to the
    shuffles behind it, so their files are removed as soon as it is written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for df in tables:
        for folder in {_path(df.sparkSession, f).getParent() for f in df.inputFiles()}:
            _store(df.sparkSession, folder).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results built on them must have been consumed."""
    folder = _path(spark, shared_folder(spark))
    _store(spark, folder).delete(folder, True)


# --- published tables ---


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path):
    """The file system of a path, whatever it is: versions are renamed and removed through it."""
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = _path(spark, folder)
    store = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []


def _sums(df: DataFrame) -> list[Column]:
    """Number of rows and two sums over their hashes, which do not depend on the order of rows or files."""
    values = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    h = F.xxhash64(*values)
    return [F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(20,0)")).alias("sum")]


def _digest(row: dict) -> dict:
    return {"rows": row["rows"], "xor": str(row["xor"]), "sum": str(row["sum"])}


def digest(df: DataFrame) -> dict:
    return _digest(df.agg(*_sums(df)).first().asDict())


def _load(spark: SparkSession, folder: str, version: str, manifest: dict) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    return spark.read.schema(schema).options(**manifest["options"]).format(manifest["format"]).load(f"{folder}/data/{version}")


def publish(df: DataFrame, folder: str, fmt: str = "parquet", keep: int = 3) -> str:
    """Write a version, check that it reads back as it was, commit it, and remove all but the last ``keep``.

    Rows are counted as they are written, so ``df`` is computed once.  A version that does not read back alike is an
    error and stays unseen: a CSV with line breaks inside texts, say.  CSV has a header, and tells nulls from empty
    texts.  Versions sort by their time of writing.
    """
    spark = df.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    options = {"header": "true", "nullValue": "\\N", "escape": '"'} if fmt == "csv" else {}
    seen = Observation()
    df.observe(seen, *_sums(df)).write.options(**options).format(fmt).save(f"{folder}/data/{version}")
    manifest = {"schema": df.schema.json(), "format": fmt, "options": options} | _digest(seen.get)
    if digest(_load(spark, folder, version, manifest)) != _digest(seen.get):
        raise ValueError(f"what was written to {folder}/data/{version} does not read back as it was")
    aside, place = (_path(spark, f"{folder}/{where}/{version}.json") for where in ("staged", "committed"))
    store = _store(spark, aside)
    out = store.create(aside, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    store.mkdirs(place.getParent())
    if not store.rename(aside, place):
        raise OSError(f"the manifest of {version} could not be committed")
    expire(spark, folder, keep)
    return version


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Committed versions, the newest last."""
    return [n.removesuffix(".json") for n in _names(spark, f"{folder}/committed") if n.endswith(".json")]


def published(spark: SparkSession, folder: str, verify: bool = True) -> DataFrame | None:
    """The newest committed version whose files agree with its manifest; None where there is none.

    ``verify`` reads it once to count it; without it, a version counts as good if its manifest can be read.
    """
    for version in reversed(versions(spark, folder)):
        try:
            text = spark.read.option("wholetext", True).text(f"{folder}/committed/{version}.json").first()[0]
            manifest = json.loads(text)
            df = _load(spark, folder, version, manifest)
            if not verify or digest(df) == {k: manifest[k] for k in ("rows", "xor", "sum")}:
                return df
        except (PySparkException, ValueError, KeyError, TypeError):
            continue
    return None


def expire(spark: SparkSession, folder: str, keep: int = 3) -> None:
    """Remove versions before the last ``keep`` committed ones, their manifests first, and leftovers as old as they."""
    committed = versions(spark, folder)
    for version in committed[:-keep]:
        path = _path(spark, f"{folder}/committed/{version}.json")
        _store(spark, path).delete(path, False)
    oldest = committed[-keep:][0] if committed else ""
    for where in ("data", "staged"):
        for name in _names(spark, f"{folder}/{where}"):
            if name.removesuffix(".json") < oldest:
                path = _path(spark, f"{folder}/{where}/{name}")
                _store(spark, path).delete(path, True)
