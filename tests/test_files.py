"""Files and streams on small fixtures."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import findspan as fs
from findspan.session import work_dir
from findspan.sources.files import RUN_LOG_SCHEMA
from findspan.streaming import streams as T


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_corpus_files(spark, tmp_path):
    for name, size in (("src/a.ts", 3), ("src/b.test.ts", 3), ("node_modules/x.ts", 3), ("big.ts", 2 << 20), ("README.md", 3)):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x" * size)
    found = fs.scan_corpus(spark, str(tmp_path), ["**/*.ts"], ["node_modules/**"])
    assert rows(found, "path", "bytes") == [("big.ts", 2 << 20), ("src/a.ts", 3), ("src/b.test.ts", 3)]
    kept, rejected = fs.size_guard(found, "text", 1024)
    assert rows(kept, "path") == [("src/a.ts",), ("src/b.test.ts",)] and rows(rejected, "path") == [("big.ts",)]
    assert rows(fs.scan_corpus(spark, str(tmp_path), ["**/*.ts"], max_kb=1024), "path") == [
        ("node_modules/x.ts",), ("src/a.ts",), ("src/b.test.ts",)]
    assert fs.scan_corpus(spark, str(tmp_path)).count() == 5


def test_corpus_paths_are_decoded_and_relative_to_the_root(spark, tmp_path):
    root = tmp_path / "corpus"
    names = ["y.ts", "lib/corpus/y.ts", "a b/x.ts", "50%/+c.ts", "é/z.ts", f"deep{tmp_path}/corpus/w.ts"]
    for name in names:
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(name)
    found = fs.scan_corpus(spark, str(root))
    assert rows(found, "path") == sorted([(n,) for n in names], key=repr)
    assert all(r.path == r.text for r in found.collect())
    assert rows(fs.scan_corpus(spark, f"file://{root}/", ["a b/*"]), "path") == [("a b/x.ts",)]


def test_written_folders_are_those_of_sparks_writer(spark, tmp_path):
    odd = ["x", "", None, "a b", "50%", "k=v:[{^}]?*#'\"\\/", "é", "tab\t", "+&~!"]
    given = [(o, i, t) for i, (o, t) in enumerate((o, t) for o in odd for t in ("one", "", None, "two\nlines\r\n"))] + [("x", 0, "again"), ("x", None, "z")]
    df = spark.createDataFrame(given, "kind string, n int, text string").repartition(3, "kind", "n")
    df.write.partitionBy("kind", "n").text(str(tmp_path / "spark"))
    fs.write_folders(df, str(tmp_path / "own"), ["kind", "n"])

    def written(root):
        return sorted((str(f.parent.relative_to(root)), sorted(f.read_bytes().split(b"\n"))) for f in root.rglob("*.txt"))

    assert written(tmp_path / "own") == written(tmp_path / "spark")
    assert not list((tmp_path / "own").rglob("*.crc"))  # no file of Hadoop's writer, which starts a process for each


def test_a_listing_task_takes_many_folders(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.ts").write_text("x")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        found = fs.scan_corpus(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism < 200
    assert found.count() == 200


def test_the_driver_has_no_entry_per_file_of_a_corpus(spark, tmp_path, monkeypatch):
    """Tasks list the folders, in rounds where a task has seen enough, and the plan names no file of the corpus."""
    from findspan.sources import files

    monkeypatch.setattr(files, "_ENTRIES", 20)
    for i in range(150):
        folder = tmp_path / "top" / f"d{i % 10}" / f"e{i}" / "f"
        folder.mkdir(parents=True)
        (folder / "a.ts").write_text(f"text {i}")
    found = fs.scan_corpus(spark, str(tmp_path), ["**/*.ts"])
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]
    assert rows(found, "path", "text") == sorted([(f"top/d{i % 10}/e{i}/f/a.ts", f"text {i}") for i in range(150)], key=repr)


def test_listed_files_are_those_of_sparks_reader(spark, tmp_path):
    root = tmp_path / "corpus"
    names = ["a.ts", "b.js", "empty.ts", ".hidden.ts", "_under.ts", "_k=v.ts", "meta/_metadata", "x._COPYING_", "_SUCCESS", "sp ace/[1]{2}.ts", "_skip/a.ts",
             ".git/a.ts", "_p=1/a.ts", "_metadata/in.ts", "deep/er/_down/a.ts", "deep/er/c;d.ts", "deep/er/q?.ts", "50%/%20+&.ts"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == "empty.ts" else f"{name} \u00e9\r\n".encode())
    (tmp_path / "beside").mkdir()
    (tmp_path / "beside" / "linked.ts").write_text("linked")
    (root / "link").symlink_to(tmp_path / "beside")
    (root / "nowhere").symlink_to(tmp_path / "missing")

    def compared(path, glob=None):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        theirs = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
        own = fs.scan_corpus(spark, path, file_glob=glob)
        assert own.schema.simpleString() == "struct<path:string,bytes:bigint,modified:timestamp,text:string>"
        seen = rows(theirs.select("length", "modificationTime", F.decode("content", "UTF-8").alias("text")), "length", "modificationTime", "text")
        assert rows(own, "bytes", "modified", "text") == seen
        return {r.path for r in own.collect()}

    assert compared(str(root)) == {
        "a.ts", "b.js", "_k=v.ts", "sp ace/[1]{2}.ts", "_p=1/a.ts", "_metadata/in.ts", "deep/er/c;d.ts", "deep/er/q?.ts", "50%/%20+&.ts", "link/linked.ts"}
    assert compared(f"file:{root}", "*[a-c].{js,ts}") == {"a.ts", "b.js", "_p=1/a.ts"}
    assert compared(str(root / "a.ts")) == {""}  # a file, and a pattern, go through Spark's reader
    assert len(compared(f"{tmp_path}/co*/dee[p]")) == 2
    (tmp_path / "none").mkdir()
    assert compared(str(tmp_path / "none")) == set()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        fs.scan_corpus(spark, str(tmp_path / "missing"))


def test_long_files_of_a_corpus_come_in_batches_of_few(spark, tmp_path, monkeypatch):
    from findspan.sources import files

    monkeypatch.setattr(files, "_BATCH_BYTES", 100)
    for i in range(50):
        (tmp_path / f"{i}.ts").write_text(str(i) * 60)
    (tmp_path / "bad.ts").write_text("x")
    spark.range(5000).select(F.repeat(F.lit("z"), 7).alias("text")).coalesce(1).write.text(str(tmp_path / "w"))  # with checksums beside it
    found = fs.scan_corpus(spark, str(tmp_path))
    assert rows(found.filter("bytes BETWEEN 60 AND 120"), "path", "text") == sorted([(f"{i}.ts", str(i) * 60) for i in range(50)], key=repr)
    (written,) = (tmp_path / "w").glob("*.txt")
    assert found.filter("bytes = 40000").first().text == "zzzzzzz\n" * 5000
    written.write_bytes(b"y" + written.read_bytes()[1:])
    with pytest.raises(Exception, match="checksum error"):
        found.filter("bytes = 40000").collect()
    (tmp_path / "bad.ts").unlink()
    assert found.select("path").count() == 52  # no file is opened where its text is not used
    assert "ArrowEvalPython" not in found.select("path", "bytes")._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="bad.ts"):
        found.filter("bytes = 1").collect()


def test_ignore_rules(spark):
    from findspan.sources.files import ignored

    rules = ["# comment", "", "build/", "*.log", "!keep.log", "/top.ts", "docs/*.md", "gen", "!gen/kept.ts", "\\#odd"]
    cases = {
        "a.ts": False, "build/x.ts": True, "src/build/x.ts": True, "build": False, "x.log": True, "a/b/y.log": True, "keep.log": False,
        "a/keep.log": False, "build/keep.log": True, "top.ts": True, "a/top.ts": False, "docs/a.md": True, "docs/a/b.md": False,
        "a/docs/a.md": False, "gen/kept.ts": True, "gen": True, "#odd": True,
    }
    paths = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.out for r in paths.select("path", ignored(F.col("path"), rules).alias("out")).collect()} == cases


def test_later_line_of_a_catalogue_wins(spark, tmp_path):
    rule = lambda name: {"id": "r", "name": name, "severity": "error"}
    lines = [json.dumps({"rulebase": {"static_rules": [rule(f"n{k}")]}}) for k in range(500)]
    (tmp_path / "rules.json").write_text("\n".join(lines))
    assert fs.read_rules(spark, str(tmp_path), one_per_line=True).first().name == "n499"


def test_reports(spark, tmp_path):
    one = [{"filePath": "a.ts", "messages": [
        {"ruleId": "no-eval", "message": "m", "line": 3, "column": 7, "severity": 2, "fix": {"text": "x"}}, {"ruleId": "no-console", "severity": 1}]}]
    two = [{"filePath": "b.ts", "messages": [{"ruleId": "no-console", "severity": "warning"}]}, {"filePath": "b.ts", "messages": [{"ruleId": "x", "severity": "other"}]}]
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "r.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "two" / "r.json").write_text(json.dumps(two))
    a = fs.read_findings(spark, str(tmp_path / "one"), "one")
    b = fs.read_findings(spark, str(tmp_path / "two"), "two", one_per_line=True)
    both = a.unionByName(b)
    metrics = fs.lint_metrics(both).first()
    assert (metrics.findings, metrics.files_processed, metrics.errors, metrics.warnings) == (4, 2, 1, 2)
    assert rows(both, "rule_name", "line", "fix_available", "message", "source")[0] == ("no-console", 0, False, "", "one")
    assert rows(both.filter("fix_available"), "rule_name") == [("no-eval",)]
    assert [r.rule_name for r in fs.sort_findings(both).collect()] == ["no-console", "no-eval", "no-console", "x"]


def test_one_large_report_is_split(spark, tmp_path):
    entries = [{"filePath": f"f{i}.ts", "messages": [
        {"ruleId": f"r{j}", "message": 'says "filePath": and {\\"filePath\\": ], é', "line": i, "column": j, "severity": j % 3, "fix": {"text": "x"} if j else None}
        for j in range(i % 4)], "errorCount": 1} for i in range(9000)]
    path = tmp_path / "report.json"
    path.write_text(json.dumps(entries, separators=(",", ":"), ensure_ascii=False) + "\n")
    (tmp_path / "empty.json").write_text("[]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        split = fs.read_findings(spark, str(tmp_path), "lint", split=True)
        assert split.rdd.getNumPartitions() > 8
        assert rows(split, *split.columns) == rows(fs.read_findings(spark, str(tmp_path), "lint"), *split.columns)
        assert split.count() == sum(i % 4 for i in range(9000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    path.write_text(json.dumps(entries[:3], indent=1))
    with pytest.raises(Exception, match="does not begin"):
        fs.read_findings(spark, str(path), "lint", split=True).collect()


def test_catalogue(spark, tmp_path):
    def rule(ident, category="Style", severity="error", **more):
        return {"id": ident, "name": ident, "description": "", "category": category, "severity": severity, "cost": 1,
                "implementation": {"type": "regex"}, **more}

    catalogue = {"rulebase": {
        "static_rules": [rule("a", "Security", autofix=True), rule("b", "Security", autofix=True)],
        "behavioral_rules": [rule("c", ai_enhanced=True)],
        "hybrid_rules": [rule("d", severity="odd", ai_enhanced=True, autofix=True), rule("a", "Testing", "info", tags=["t"])]}}
    (tmp_path / "rules.json").write_text(json.dumps(catalogue, indent=2))
    rules = fs.read_rules(spark, str(tmp_path))
    assert rows(rules, "id", "kind", "category", "severity", "autofix") == [
        ("a", "hybrid", "Testing", "Info", False), ("b", "static", "Security", "Error", True),
        ("c", "behavioral", "Style", "Error", False), ("d", "hybrid", "Style", "Warning", True)]
    assert fs.rule_stats(rules).agg(F.sum("rules"), F.sum("ai_enhanced_rules"), F.sum("autofix_rules")).first()[:] == (4, 2, 2)


def _runs(spark, first, last):
    return spark.range(first, last).select(
        F.concat(F.lit("f"), "id").alias("file_path"), (F.col("id") % 2 == 0).alias("success"), F.lit(1).alias("total_steps"),
        F.array(F.lit("s")).alias("executed_steps"), F.col("id").alias("duration_ms"), F.lit(2).cast("long").alias("issues_found"),
        F.lit(None).cast("string").alias("ai_strategy"), F.timestamp_seconds(F.col("id") * 60).alias("at"))


def test_run_log_keeps_the_newest(spark):
    folder = work_dir(spark, "log")
    fs.append_run_log(_runs(spark, 0, 8), None, f"{folder}/1", keep_last=6)
    fs.append_run_log(_runs(spark, 8, 10), f"{folder}/1", f"{folder}/2", keep_last=6)
    log = fs.read_run_log(spark, f"{folder}/2")
    assert rows(log, "file_path") == [(f"f{i}",) for i in range(4, 10)]
    assert log.schema.simpleString() == spark.createDataFrame([], RUN_LOG_SCHEMA).schema.simpleString()


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.ts").write_text("eval(1)\nok")
    found = fs.stream_findings(fs.stream_corpus(spark, str(source), "*.ts"), fs.default_rules(spark))
    assert rows(T.drain(found, target), "line", "rule_name") == [(1, "eval-usage")]
    (source / "b.ts").write_text("\n\nconsole.log(2)")
    found = fs.stream_findings(fs.stream_corpus(spark, str(source), "*.ts"), fs.default_rules(spark))
    assert rows(T.drain(found, target), "line", "rule_name") == [(1, "eval-usage"), (3, "console-log")]


def _write_calls(spark, folder, calls):
    spark.createDataFrame(calls, "id int, key string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def _read_calls(spark, folder):
    return spark.readStream.schema("id int, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def _at(second):
    return datetime(2024, 1, 1, 0, second // 60, second % 60)


FAR = 3590


def test_exact_stream_throttle_keeps_its_windows_between_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    calls = [(i, "k", _at(s)) for i, s in enumerate((0, 10, 20, 61, 62, 63))]
    _write_calls(spark, folder, calls[:4])
    first = fs.stream_throttle_exact(_read_calls(spark, folder), ["key"], "ts", "id", 2, 60)
    T.drain(first, str(tmp_path / "out"))
    _write_calls(spark, folder, calls[4:])
    _write_calls(spark, folder, [(99, "clock", _at(FAR))])
    again = fs.stream_throttle_exact(_read_calls(spark, folder), ["key"], "ts", "id", 2, 60)
    got = T.drain(again, str(tmp_path / "out"))
    assert rows(got, "id", "accepted") == [(0, True), (1, True), (2, False), (3, True), (4, True), (5, False)]


def test_exact_stream_throttle_goes_by_time_not_arrival(spark, tmp_path):
    """Two calls a long time apart, the later one first: both are accepted."""
    folder = str(tmp_path / "in")
    _write_calls(spark, folder, [(2, "k", _at(600))])
    _write_calls(spark, folder, [(1, "k", _at(0))])
    _write_calls(spark, folder, [(99, "clock", _at(FAR))])
    exact = fs.stream_throttle_exact(_read_calls(spark, folder), ["key"], "ts", "id", 1, 60, "20 minutes")
    assert rows(T.drain(exact, str(tmp_path / "out")), "id", "accepted") == [(1, True), (2, True)]


def test_shuffled_stream_equals_the_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    rng = random.Random(8)
    calls = [(i, rng.choice("aab"), _at(rng.randrange(1200))) for i in range(150)]
    for part in range(5):
        _write_calls(spark, folder, calls[part::5])
    _write_calls(spark, folder, [(999, "clock", _at(FAR))])
    exact = fs.stream_throttle_exact(_read_calls(spark, folder), ["key"], "ts", "id", 2, 60, "30 minutes")
    batch = fs.throttle(spark.createDataFrame(calls, "id int, key string, ts timestamp"), ["key"], "ts", "id", 2, 60)
    assert rows(T.drain(exact, str(tmp_path / "exact")), "id", "accepted") == rows(batch, "id", "accepted")
    reuse = fs.stream_dedup(_read_calls(spark, folder), ["key"], "ts", "id", 60, "30 minutes")
    fresh, owner = {}, []
    for i, key, at in sorted(calls, key=lambda c: (c[2], c[0])):
        if key not in fresh or (at - fresh[key][1]).total_seconds() >= 60:
            fresh[key] = (i, at)
        owner.append((i, fresh[key][0], fresh[key][0] == i))
    assert rows(T.drain(reuse, str(tmp_path / "reuse")), "id", "answered_by", "fresh") == sorted(owner, key=repr)


def test_streams_of_a_long_table_equal_the_batch(spark, tmp_path):
    """400 days, a key with a third of the calls, files in slices of 20 days and in no order within them."""
    rng = random.Random(9)
    start = datetime(2023, 1, 1)
    calls = [(i, rng.choice(["hot"] * 3 + [f"k{j}" for j in range(6)]), start + timedelta(seconds=rng.randrange(400 * 86_400))) for i in range(6000)]
    calls += [(10_000 + i, "hot", start + timedelta(days=200, seconds=i)) for i in range(500)]
    folder = str(tmp_path / "in")
    for number in range(20):
        some = [c for c in calls if (c[2] - start).days // 20 == number]
        rng.shuffle(some)
        for part in range(2):
            _write_calls(spark, folder, some[part::2])
    _write_calls(spark, folder, [(99_999, "clock", start + timedelta(days=1000))])
    table = spark.createDataFrame(calls, "id int, key string, ts timestamp")
    read = lambda: spark.readStream.schema("id int, key string, ts timestamp").option("maxFilesPerTrigger", 6).parquet(folder)
    exact = fs.stream_throttle_exact(read(), ["key"], "ts", "id", 2, 3 * 86_400, "20 days", 5 * 86_400, 4)
    got = T.drain(exact, str(tmp_path / "exact")).filter("id < 99999")
    assert rows(got, "id", "accepted") == rows(fs.throttle(table, ["key"], "ts", "id", 2, 3 * 86_400), "id", "accepted")
    counted = T.drain(fs.stream_throttle(read(), ["key"], "ts", 2, "1 day", "20 days"), str(tmp_path / "n"), "update")
    assert T.last_state(counted, ["key", "window_start"]).agg(F.sum("calls")).first()[0] == len(calls) + 1


def test_stream_counts_and_late_calls(spark, tmp_path):
    folder = str(tmp_path / "in")
    _write_calls(spark, folder, [(i, "k", _at(i)) for i in range(5)] + [(9, "k", _at(3000))])
    counted = fs.stream_throttle(_read_calls(spark, folder), ["key"], "ts", 2, delay="1 minute")
    T.drain(counted, str(tmp_path / "out"), "update")
    _write_calls(spark, folder, [(10, "k", _at(1)), (11, "k", _at(3001))])
    counted = fs.stream_throttle(_read_calls(spark, folder), ["key"], "ts", 2, delay="1 minute")
    last = T.last_state(T.drain(counted, str(tmp_path / "out"), "update"), ["key", "window_start"])
    assert rows(last, "calls", "accepted", "rejected") == [(2, 2, 0), (5, 2, 3)]


def test_stream_reuses_recent_requests(spark, tmp_path):
    folder = str(tmp_path / "in")
    _write_calls(spark, folder, [(1, "same", _at(0)), (2, "other", _at(1))])
    T.drain(fs.stream_dedup(_read_calls(spark, folder), ["key"], "ts", "id"), str(tmp_path / "out"))
    _write_calls(spark, folder, [(3, "same", _at(60)), (4, "same", _at(300)), (5, "same", _at(599))])
    _write_calls(spark, folder, [(99, "clock", _at(FAR))])
    got = T.drain(fs.stream_dedup(_read_calls(spark, folder), ["key"], "ts", "id"), str(tmp_path / "out"))
    assert rows(got, "id", "answered_by", "fresh") == [(1, 1, True), (2, 2, True), (3, 1, False), (4, 4, True), (5, 4, False)]


def test_stream_statistics_equal_the_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    found = spark.range(60).select(
        F.lit("r").alias("rule_name"), F.concat(F.lit("v "), F.col("id"), F.when(F.col("id") % 4 == 0, " x").otherwise("")).alias("message"),
        F.timestamp_seconds("id").alias("seen_at"), F.lit("f").alias("file_path"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("Info").alias("severity"))
    found.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    written = T.drain(fs.stream_pattern_stats(stream), str(tmp_path / "out"), "update")
    columns = ["pattern_id", "count", "first_seen", "last_seen"]
    assert rows(T.last_state(written, ["pattern_id", "rule_id"]), *columns) == rows(fs.pattern_stats(found), *columns)


def test_stream_run_summary(spark, tmp_path):
    _runs(spark, 0, 120).write.json(str(tmp_path / "log"))
    summary = fs.stream_run_summary(T.stream_run_log(spark, str(tmp_path / "log")))
    last = T.last_state(T.drain(summary, str(tmp_path / "out"), "update"), ["window_start"])
    assert rows(last, "runs", "success_rate", "avg_duration_ms", "issues_found") == [(60, 0.5, 29.5, 120), (60, 0.5, 89.5, 120)]
