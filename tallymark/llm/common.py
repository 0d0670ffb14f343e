"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* a null text is handled as the empty text unless the operator says otherwise;
* columns of the input that an operator does not use are carried through; where
  an input column has the name of an output column, the output column wins;
* an empty table gives an empty result with the full schema.
"""

from __future__ import annotations

import functools
import inspect
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.stored import stored

#: White space that separates words: the six ASCII characters of ``bytes.split()``.
BLANKS = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one Arrow batch; texts of a few MB each then still fit a worker.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add."""
    clash = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


#: The columns of ``documents``, whose names operators do not give to anything else.
DOCUMENT = frozenset({"doc_id", "text", "lang", "source", "n_chars"})


def sheltered(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator on a table whose other columns have names of their own while it works.

    Columns of ``documents``, and those named by the operator's arguments, keep their names; all others are renamed and
    get their names back at the end, but for one that the operator adds itself.
    """
    signature = inspect.signature(operator)

    @functools.wraps(operator)
    def run(*args, **how) -> DataFrame:
        bound = signature.bind(*args, **how)
        bound.apply_defaults()
        table, df = next(iter(bound.arguments.items()))
        used = DOCUMENT | {v.lower() for v in bound.arguments.values() if isinstance(v, str)}
        own = {c: f"sheltered_{i}_{uuid.uuid4().hex[:8]}" for i, c in enumerate(df.columns) if c.lower() not in used}
        if not own:
            return operator(*args, **how)
        bound.arguments[table] = df.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in df.columns])
        out = operator(*bound.args, **bound.kwargs)
        back = {v: k for k, v in own.items()}
        made = {c.lower() for c in out.columns if c not in back}
        return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns if c not in back or back[c].lower() not in made])

    return run


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[pa.RecordBatch], list[pa.Array]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Append columns computed by ``make`` from Arrow batches, leaving out those in ``drop``.

    ``make`` sees the whole input batch and gives one array for each field.
    """
    names = [f.name for f in fields]
    gone = {n.lower() for n in (*names, *drop)}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in gone]
    schema = T.StructType([df.schema.fields[i] for i in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            made = make(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + made,
                names=[batch.schema.names[i] for i in kept] + names,
            )

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's values as strings, nulls as empty strings."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    return stored(df, name)
