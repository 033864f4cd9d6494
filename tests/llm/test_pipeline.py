"""The pipeline as a whole: what each stage keeps, and that its rows equal those of its stages."""

import corpus_pipeline
from pyspark.sql import functions as F

from findspan.llm.common import saved, table

FOLDER = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_only_take_away(spark):
    docs = table(spark, FOLDER, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "decontamination", "packing"]
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9, None, None, None, None), (None, "", "x", "y", 0)], docs.schema)
    current = docs.unionByName(odd).withColumn("label", F.lit("extra"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = saved(stage(spark, current, FOLDER), "stage")
        assert kept.columns == current.columns
        assert kept.select("doc_id", "text").exceptAll(current.select("doc_id", "text")).count() == 0
        assert 0 < kept.count() <= current.count()
        current = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, current, FOLDER)
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("want")).filter("n <> want")
    assert whole.count() == 0 and pieces.select("doc_id").distinct().count() == current.select("doc_id").distinct().count()


def test_run_gives_the_rows_of_its_stages(spark):
    one = corpus_pipeline.run(spark, FOLDER).drop("ids")
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, FOLDER), "again")
    assert one.exceptAll(docs.drop("ids")).count() == 0 and one.count() == docs.count()


def test_empty_documents(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
