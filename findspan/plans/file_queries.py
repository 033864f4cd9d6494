"""Registered queries that go through files and streams.

They write files derived from the tables below the shared folder and read them back the way a
user's corpus, reports, catalogues and logs are read.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from findspan.operators import corpus as X
from findspan.plans.call_queries import EVENT_FINDINGS, TEMPLATED, event_findings
from findspan.plans.registry import query, table
from findspan.plans.text_queries import FINDINGS_SQL, all_rules
from findspan.session import work_dir
from findspan.sources import files as S
from findspan.sources import stored as K
from findspan.streaming import streams as T


@query("scan_corpus", """
SELECT 'lang=' || lang || '/source=' || source || '/doc ' || doc_id AS folder, strlen(text) + 1 AS bytes, md5(text || chr(10)) AS text_md5
FROM documents WHERE lang IN ('en', 'fr') AND source NOT IN ('src3', 'src5')""")
def scan_corpus(spark, sf):
    """A folder per document, by language and source; a glob and ignore rules leave some out."""
    folder = work_dir(spark, "corpus")
    docs = table(spark, sf, "documents").select("lang", "source", F.concat(F.lit("doc "), F.col("doc_id")).alias("doc"), "text")
    S.write_folders(docs, folder, ["lang", "source", "doc"])
    files = S.scan_corpus(
        spark, folder, include=["lang={en,fr}/**/*.txt"], exclude=["**/source=src3/**"], ignore=["# sources", "source=src5/"], max_kb=100_000)
    return files.select(
        F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "doc=", "").alias("folder"), "bytes",
        F.md5(F.col("text").cast("binary")).alias("text_md5"))


REPORTS_SQL = f"""
SELECT rule_name, message, file_path, line, "column", severity, severity = 'Error' AS fix_available, 'engine' AS source FROM {EVENT_FINDINGS}"""


def _reports(spark, sf):
    """Findings written as nested reports, one report per file and severity in textual or numeric form."""
    folder = work_dir(spark, "reports")
    found = event_findings(spark, sf)
    level = F.when(F.col("severity") == "Error", "2").when(F.col("severity") == "Warning", "warning").otherwise("other")
    message = F.struct(
        F.col("rule_name").alias("ruleId"), "message", "line", "column", level.alias("severity"),
        F.when(F.col("severity") == "Error", F.struct(F.lit("x").alias("text"))).alias("fix"),
    )
    # One report per finding: reports of any number may name the same file.
    report = F.array(F.struct(F.col("file_path").alias("filePath"), F.array(message).alias("messages")))
    found.select(F.to_json(report)).write.text(folder)
    return folder


@query("read_findings", REPORTS_SQL)
def read_findings(spark, sf):
    return S.read_findings(spark, _reports(spark, sf), "engine", one_per_line=True)


@query("read_findings_split", REPORTS_SQL)
def read_findings_split(spark, sf):
    """Cut where the entry of a file begins, however long the arrays are."""
    return S.read_findings(spark, _reports(spark, sf), "engine", split=True)


@query("read_rules", f"""
SELECT p_type || '-' || k AS id, p_name AS name, kind, CASE WHEN size < 10 THEN 'Error' WHEN size < 20 THEN 'Warning' ELSE 'Info' END AS severity,
       size AS cost, kind = 'hybrid' AS autofix
FROM (SELECT p_type, p_partkey // 2 AS k, p_name, p_size AS size, CASE WHEN p_size < 10 THEN 'static' WHEN p_size < 30 THEN 'behavioral' ELSE 'hybrid' END AS kind,
             row_number() OVER (PARTITION BY p_type, p_partkey // 2 ORDER BY CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END DESC, p_partkey DESC) AS n FROM part)
WHERE n = 1""")
def read_rules(spark, sf):
    """Parts as rules, a catalogue per part type; two parts may share an id and the later one wins."""
    folder = work_dir(spark, "rules")
    p = table(spark, sf, "part")
    size = F.col("p_size")
    rule = F.struct(
        F.concat_ws("-", F.col("p_type"), F.expr("p_partkey div 2")).alias("id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("description"), F.col("p_brand").alias("category"),
        F.when(size < 10, "error").when(size < 20, "odd").otherwise("info").alias("severity"),
        F.struct(F.lit("regex").alias("type"), F.col("p_name").alias("rule_name")).alias("implementation"),
        size.alias("cost"), (size >= 30).alias("autofix"),
    )
    placed = F.struct(F.col("p_partkey").alias("place"), rule.alias("rule"))

    def rules(condition):
        ordered = F.array_sort(F.collect_list(F.when(condition, placed)))
        return F.transform(ordered, lambda x: x["rule"])

    # A catalogue for every 64 part numbers of a type, so none grows with the table.
    p.groupBy("p_type", F.expr("p_partkey div 64")).agg(F.struct(
        rules(size < 10).alias("static_rules"), rules((size >= 10) & (size < 30)).alias("behavioral_rules"),
        rules(size >= 30).alias("hybrid_rules")).alias("rulebase")).select("rulebase").write.json(folder)
    return S.read_rules(spark, folder, one_per_line=True).select("id", "name", "kind", "severity", "cost", "autofix")


def _runs(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("f"), F.col("event_id")).alias("file_path"), (F.col("event_type") != "error").alias("success"),
        F.lit(3).alias("total_steps"), F.array("event_type").alias("executed_steps"),
        F.floor("value").alias("duration_ms"), F.regexp_extract("props", r"\d+", 0).cast("long").alias("issues_found"),
        F.lit(None).cast("string").alias("ai_strategy"), F.col("ts").cast("timestamp").alias("at"), "value",
    )


@query("append_run_log", """
SELECT 'f' || event_id AS file_path, event_type <> 'error' AS success, floor(value)::BIGINT AS duration_ms
FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000""")
def append_run_log(spark, sf):
    folder = work_dir(spark, "runs")
    runs = _runs(spark, sf)
    runs.filter("value <= 40").drop("value").write.json(f"{folder}/old")
    S.append_run_log(runs.filter("value > 40").drop("value"), f"{folder}/old", f"{folder}/new")
    return S.read_run_log(spark, f"{folder}/new").select("file_path", "success", "duration_ms")


@query("stream_findings", FINDINGS_SQL + """
SELECT source, file_path, line, rule_name, matched, suggested_fix FROM findings""")
def stream_findings(spark, sf):
    """All three tables of texts as streams, all rules."""
    docs = T.stream_table(spark, sf, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("file_path"), F.col("lang").alias("language"), "text")
    pages = T.stream_table(spark, sf, "pages").select(
        F.lit("pages").alias("source"), F.col("page_id").cast("string").alias("file_path"), F.lit("html").alias("language"),
        F.col("html").alias("text"))
    talks = T.stream_table(spark, sf, "conversations").select(
        F.lit("conversations").alias("source"), F.concat_ws("/", "conv_id", "turn").alias("file_path"), F.lit("chat").alias("language"), "text")
    found = T.stream_findings(docs.unionByName(pages).unionByName(talks), all_rules(spark), language="language")
    columns = ("source", "file_path", "line", "rule_name", "matched", "suggested_fix")
    return T.drain(found.select(*columns), work_dir(spark, "stream-findings")).select(*columns)


#: Slices of event time that a table is streamed in.
SLICES = 5


def _in_slices(df, at, write):
    """Write a table in slices of event time, one after another, and return their length.

    The rows of a slice are dealt to all tasks in no order. So no row is older than the newest one before it by more than a slice, whatever time the
    table spans, and the length of a slice is the delay that a watermark needs.
    """
    first, last = df.agg(F.min(at), F.max(at)).first()
    if first is None:
        write(df)
        return timedelta(seconds=1)
    length = max((last - first) / SLICES, timedelta(seconds=1)) + timedelta(milliseconds=1)
    for number in range(SLICES):
        begin = first + number * length
        some = df.filter((F.col(at) >= F.lit(begin)) & (F.col(at) < F.lit(begin + length)))
        write(some.repartition(F.xxhash64(F.col(at), F.lit(number))))
    return length


def _interval(length):
    return f"{int(length.total_seconds() * 1000) + 1} milliseconds"


def _shuffled_events(spark, sf, *columns):
    """Events as a stream of slices, and a last file with an event that lets time pass; also the delay of its watermark."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = work_dir(spark, "events")
    length = _in_slices(events, "ts", lambda part: part.write.mode("append").parquet(folder))
    last = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.lit(10 * length) + F.expr("INTERVAL 1000 DAYS")).alias("ts"))
    clock = last.select(*[F.col(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])
    clock.write.mode("append").parquet(folder)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return T.stream_files(spark, folder, events.schema, files).select(*columns), _interval(length)


@query("stream_pattern_stats", f"""
SELECT pattern_id, rule_name AS rule_id, count(*) AS count, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM {TEMPLATED} GROUP BY 1, 2""")
def stream_pattern_stats(spark, sf):
    e = T.stream_table(spark, sf, "events")
    size = F.when(F.col("value") >= 100, "large").otherwise("small")
    found = e.select(
        F.col("event_type").alias("rule_name"),
        F.concat(F.lit("User 'u"), F.col("user_id"), F.lit("' made a "), size, F.lit(" step "), F.col("event_id"),
                 F.lit(" with "), F.col("props")).alias("message"),
        F.col("ts").alias("seen_at"))
    written = T.drain(T.stream_pattern_stats(found), work_dir(spark, "stream-stats"), "update")
    return T.last_state(written, ["pattern_id", "rule_id"])


@query("stream_throttle", """
SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS calls, least(count(*), 2) AS accepted,
       greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY 1, 2""")
def stream_throttle(spark, sf):
    calls, delay = _shuffled_events(spark, sf, "user_id", F.col("ts").alias("at"))
    counted = T.stream_throttle(calls, ["user_id"], "at", 2, "1 day", delay)
    written = T.drain(counted, work_dir(spark, "stream-throttle"), "update").filter("user_id IS NOT NULL")
    return T.last_state(written, ["user_id", "window_start"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_throttle_exact", """
WITH RECURSIVE opened AS (
    SELECT user_id, min(ts) AS window_start FROM events GROUP BY user_id
    UNION ALL
    SELECT o.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = o.user_id AND e.ts >= o.window_start + INTERVAL 1 DAY)
    FROM opened o WHERE o.window_start IS NOT NULL),
placed AS (SELECT e.event_id, e.user_id, e.ts, max(o.window_start) AS window_start
           FROM events e JOIN opened o ON o.user_id = e.user_id AND o.window_start <= e.ts GROUP BY ALL)
SELECT event_id, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) <= 2 AS accepted FROM placed""")
def stream_throttle_exact(spark, sf):
    calls, delay = _shuffled_events(spark, sf, "event_id", "user_id", "ts")
    admitted = T.stream_throttle_exact(calls, ["user_id"], "ts", "event_id", 2, 86400, delay, int(delay.split()[0]) / 1000)
    return T.drain(admitted, work_dir(spark, "stream-exact")).filter("event_id IS NOT NULL").select("event_id", "accepted")


@query("stream_dedup", """
WITH RECURSIVE answers AS (
    SELECT event_type, props, min(ts) AS opened FROM events GROUP BY event_type, props
    UNION ALL
    SELECT a.event_type, a.props, (SELECT min(e.ts) FROM events e
           WHERE e.event_type = a.event_type AND e.props = a.props AND e.ts >= a.opened + INTERVAL 1 DAY)
    FROM answers a WHERE a.opened IS NOT NULL),
placed AS (SELECT e.event_id, e.event_type, e.props, e.ts, max(a.opened) AS opened
           FROM events e JOIN answers a ON a.event_type = e.event_type AND a.props = e.props AND a.opened <= e.ts GROUP BY ALL),
named AS (SELECT *, first_value(event_id) OVER (PARTITION BY event_type, props, opened ORDER BY ts, event_id) AS answered_by FROM placed)
SELECT event_id, answered_by, event_id = answered_by AS fresh FROM named""")
def stream_dedup(spark, sf):
    """Events of one type and properties ask for the same; an answer is good for a day."""
    requests, delay = _shuffled_events(spark, sf, "event_id", "event_type", "props", "ts")
    answered = T.stream_dedup(requests, ["event_type", "props"], "ts", "event_id", 86400, delay, int(delay.split()[0]) / 1000)
    return T.drain(answered, work_dir(spark, "stream-dedup")).filter("event_id IS NOT NULL").select("event_id", "answered_by", "fresh")


@query("stream_run_summary", r"""
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS runs, round(avg((event_type <> 'error')::INT), 9) AS success_rate,
       round(avg(floor(value)), 6) AS avg_duration_ms, sum(regexp_extract(props, '\d+')::BIGINT)::BIGINT AS issues_found
FROM events GROUP BY 1""")
def stream_run_summary(spark, sf):
    """The log comes in slices whose files are in no order of time."""
    folder = work_dir(spark, "stream-runs")
    length = _in_slices(_runs(spark, sf).drop("value"), "at", lambda part: part.write.mode("append").json(f"{folder}/log"))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summary = T.stream_run_summary(T.stream_run_log(spark, f"{folder}/log", files_per_batch=files), window="6 hours", delay=_interval(length))
    written = T.drain(summary, folder, "update")
    return T.last_state(written, ["window_start"]).withColumns({
        "window_start": F.col("window_start").cast("timestamp_ntz"),
        "success_rate": F.round("success_rate", 9), "avg_duration_ms": F.round("avg_duration_ms", 6)})


@query("stored_run_log", """
SELECT 'f' || event_id AS file_path, event_type <> 'error' AS success, floor(value)::BIGINT AS duration_ms
FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000""")
def stored_run_log(spark, sf):
    """The log as a stream into a kept log; a batch that is handed over twice counts once."""
    folder = work_dir(spark, "stored-log")
    runs = _runs(spark, sf).drop("value")
    _in_slices(runs, "at", lambda part: part.write.mode("append").json(f"{folder}/in"))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = T.stream_run_log(spark, f"{folder}/in", files_per_batch=files)
    K.stream_to_run_log(stream, f"{folder}/log", f"{folder}/state").awaitTermination()
    return K.read_stored_log(spark, f"{folder}/log", stream.schema).select("file_path", "success", "duration_ms")


@query("stored_results", r"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+'))::BIGINT AS words,
       len(list_distinct(regexp_extract_all(text, '[A-Za-z]+')))::BIGINT AS distinct_words FROM documents""")
def stored_results(spark, sf):
    """A run over the English documents, then one over all: the second computes what the first has not seen."""
    def words(texts):
        found = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
        return texts.select("content_id", F.size(found).cast("long").alias("words"), F.size(F.array_distinct(found)).cast("long").alias("distinct_words"))

    docs, folder = table(spark, sf, "documents").select("doc_id", "lang", "text"), work_dir(spark, "results")
    K.reuse_results(docs.filter("lang = 'en'"), "text", words, folder, "1")
    return K.reuse_results(docs, "text", words, folder, "1").select("doc_id", "words", "distinct_words")


@query("stored_snapshot", """
SELECT e.event_id FROM events e LEFT JOIN (
    SELECT user_id, event_type, max(ts) AS seen FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type <> 'view' GROUP BY 1, 2) s USING (user_id, event_type)
WHERE s.seen IS NULL OR e.ts > s.seen""")
def stored_snapshot(spark, sf):
    """What is new since the last run's snapshot."""
    events, folder = table(spark, sf, "events"), work_dir(spark, "snapshot")
    for until in ("2024-01-10", "2024-01-15"):
        K.keep_snapshot(events.filter(f"ts < TIMESTAMP_NTZ '{until} 00:00:00' AND event_type <> 'view'"), folder, ["user_id", "event_type"], "ts")
    return K.changed_rows(events, folder, ["user_id", "event_type"], "ts").select("event_id")


@query("stored_upsert", """
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY user_id, event_type""")
def stored_upsert(spark, sf):
    """Cheap events are the table, dear ones two rounds of updates."""
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    folder = work_dir(spark, "keyed")
    for part in ("value <= 50", "value > 50 AND value <= 90", "value > 90"):
        K.upsert_stored(events.filter(part), folder, ["user_id", "event_type"], "ts", 8)
    return K.read_stored(spark, folder, events.schema).select("user_id", "event_type", "event_id", "value")
