"""From raw documents to packed training sequences, in five stages that each keep to the next.

Every stage takes the documents its predecessor kept and returns documents with the same columns; the last
returns pieces of packed sequences. Between stages the documents are written to the shared folder and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from findspan.llm import contamination, importance, nearcopies, packing, toxicity
from findspan.llm.common import small_batches, table
from findspan.session import delete_work, work_dir, work_so_far


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance-resampling classifier selects."""
    small_batches(spark)
    return importance.keep_selected(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 for toxicity."""
    small_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return nearcopies.one_of_each(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not in an edited form either."""
    small_batches(spark)
    return contamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens, with their ids."""
    small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]
#: SQL has neither the trained models nor the fingerprints: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents. What a stage has written on its way is deleted when its documents are there."""
    docs, mark = table(spark, sf_dir, "documents"), work_so_far()
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = work_dir(spark, name)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            delete_work(spark, mark, keep=[path])
    return docs
