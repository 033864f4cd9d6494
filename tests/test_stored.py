"""Tables kept between runs: what a second run reads, computes and writes."""

import os
from pathlib import Path

from pyspark.sql import functions as F

import findspan as fs
from findspan.sources.files import RUN_LOG_SCHEMA
from findspan.sources.stored import Stored, append_batch


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def _runs(spark, first, last):
    return spark.range(first, last).select(
        F.concat(F.lit("f"), F.lpad("id", 5, "0")).alias("file_path"), (F.col("id") % 2 == 0).alias("success"), F.lit(3).alias("total_steps"),
        F.array(F.lit("s")).alias("executed_steps"), F.col("id").alias("duration_ms"), F.col("id").alias("issues_found"),
        F.lit(None).cast("string").alias("ai_strategy"), F.timestamp_seconds("id").alias("at"))


def test_run_log_counts_a_batch_once_and_drops_whole_files(spark, tmp_path):
    log = Stored(spark, str(tmp_path / "log"))
    for number in range(8):
        append_batch(log, _runs(spark, 10 * number, 10 * number + 10), number, keep_last=25)
    append_batch(log, _runs(spark, 70, 80), 7, keep_last=25)  # handed over once more
    schema = spark.createDataFrame([], RUN_LOG_SCHEMA).schema
    got = fs.read_stored_log(spark, log.folder, schema, keep_last=25)
    assert rows(got, "duration_ms") == sorted([(i,) for i in range(55, 80)], key=repr)
    assert sorted(e["batch"] for e in log.entries()) == [5, 6, 7]
    # Batches that no list of the last versions names are gone.
    names = {p.name.rsplit("-", 1)[0] for p in Path(log.folder).iterdir() if p.name.startswith("batch")}
    assert "batch-0" not in names and {"batch-5", "batch-6", "batch-7"} <= names
    append_batch(log, _runs(spark, 0, 0), 9, keep_last=25)
    append_batch(log, _runs(spark, 0, 3).withColumn("at", F.lit(None).cast("timestamp")), 10, keep_last=25)
    assert fs.read_stored_log(spark, log.folder, schema, keep_last=25).agg(F.min("duration_ms")).first()[0] == 55


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, schema = tmp_path / "in", spark.createDataFrame([], RUN_LOG_SCHEMA).schema
    for first in (0, 40):
        _runs(spark, first, first + 40).coalesce(1).write.mode("append").json(str(folder))
        stream = spark.readStream.schema(schema).json(str(folder))
        fs.stream_to_run_log(stream, str(tmp_path / "log"), str(tmp_path / "state"), keep_last=50).awaitTermination()
    assert rows(fs.read_stored_log(spark, str(tmp_path / "log"), schema, 50), "duration_ms") == sorted([(i,) for i in range(30, 80)], key=repr)


def test_a_second_run_computes_only_new_contents(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def length(text):
        computed.add(1)
        return len(text)

    count = F.udf(length, "int")
    op = lambda df: df.select("content_id", count("text").alias("size"))
    docs = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(20)] + [(20, None)], "id int, text string")
    want = [(i, i % 5) for i in range(20)] + [(20, None)]
    first = fs.reuse_results(docs.filter("id < 3"), "text", op, str(tmp_path / "s"), "v1")
    assert rows(first, "id", "size") == sorted(want[:3], key=repr) and computed.value == 3
    for _ in range(2):  # the rest, then nothing
        assert rows(fs.reuse_results(docs, "text", op, str(tmp_path / "s"), "v1"), "id", "size") == sorted(want, key=repr)
        assert computed.value == 5
    fs.reuse_results(docs, "text", op, str(tmp_path / "s"), "v2").count()
    assert computed.value == 10
    assert fs.reuse_results(docs.limit(0), "text", op, str(tmp_path / "s"), "v3").count() == 0


def test_results_may_be_many_or_none_per_content(spark, tmp_path):
    op = lambda df: df.select("content_id", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "")], "id int, text string")
    for _ in range(2):
        got = fs.reuse_results(docs, "text", op, str(tmp_path / "s"), "v1")
        assert rows(got, "id", "word") == sorted([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, None)], key=repr)


def test_only_changed_rows_come_back(spark, tmp_path):
    files = spark.range(1000).select(F.col("id").alias("path"), F.timestamp_seconds("id").alias("modified"))
    folder = str(tmp_path / "snapshot")
    assert fs.changed_rows(files, folder, ["path"], "modified").count() == 1000
    fs.keep_snapshot(files, folder, ["path"], "modified")
    touched = files.withColumn("modified", F.when(F.col("path") % 100 == 7, F.timestamp_seconds(F.lit(10**6))).otherwise(F.col("modified")))
    more = touched.unionByName(spark.sql("SELECT 5000L AS path, timestamp_seconds(1) AS modified"))
    assert rows(fs.changed_rows(more, folder, ["path"], "modified"), "path") == sorted([(7 + 100 * i,) for i in range(10)] + [(5000,)], key=repr)
    for _ in range(5):
        fs.keep_snapshot(more, folder, ["path"], "modified")
    assert fs.changed_rows(more, folder, ["path"], "modified").count() == 0
    assert len([p for p in Path(folder).iterdir() if p.name.startswith("snapshot")]) == 3


def test_an_update_of_ten_keys_rewrites_at_most_ten_buckets(spark, tmp_path):
    folder = str(tmp_path / "keyed")
    table = spark.range(2000).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("ts"), F.lit("old").alias("v"))
    assert fs.upsert_stored(table, folder, ["k"], "ts", 64) == 64
    before = {e["bucket"]: e["path"] for e in Stored(spark, folder).entries()}
    want = dict.fromkeys(range(2000), "old")
    for turn in range(1, 6):
        keys = range(turn, turn + 10)
        new = spark.createDataFrame([(k, turn if k % 2 else -1, f"new{turn}") for k in keys], "k long, ts long, v string")
        assert fs.upsert_stored(new, folder, ["k"], "ts") <= 10
        want |= {k: f"new{turn}" for k in keys if k % 2}
    after = {e["bucket"]: e["path"] for e in Stored(spark, folder).entries()}
    assert sum(before[b] == after[b] for b in before) >= 40
    assert {r.k: r.v for r in fs.read_stored(spark, folder, table.schema).collect()} == want
    assert all(os.path.isdir(p) for p in after.values())
    assert fs.upsert_stored(table.limit(0), folder, ["k"], "ts") == 0
    tie = spark.createDataFrame([(1999, 0, "tie")], table.schema)
    fs.upsert_stored(tie, folder, ["k"], "ts")
    assert fs.read_stored(spark, folder, table.schema).filter("k = 1999").first().v == "tie"
