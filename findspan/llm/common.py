"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findspan.session import small_batches, work_dir  # noqa: F401 - small_batches is for the modules here

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later stages re-read it if executors are lost."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, a missing text as an empty one."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def fold(key: str, parts: int) -> F.Column:
    """The remainder of the CRC-32 of a key written as text; a missing key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def lowered(column: F.Column) -> F.Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(column, LETTERS.upper(), LETTERS)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row-for-row function of a batch as the argument of ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                yield fn(batch.slice(start, 1000))

    return run


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, element by element; the order of the two matters."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def free_name(docs: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def labelled(labels: DataFrame, column: str, rows: int, where: F.Column | None = None) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, label): the same ones each time, whatever the order of the table."""
    usable = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    usable = usable if where is None else usable.filter(where)
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
