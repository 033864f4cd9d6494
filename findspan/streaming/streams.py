"""Findings, statistics, rate limits, reuse and run summaries over arriving data."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from findspan.functions.ordered import window_starts
from findspan.functions.scoring import ratio
from findspan.operators.findings import message_template
from findspan.operators.rules import scan_texts
from findspan.operators.versions import latest_per_key
from findspan.sources.files import RUN_LOG_SCHEMA

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States that the keys of a stream are dealt to.
SHARDS = 64


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of one folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A parquet table of a folder as a stream; its schema comes from the files already there."""
    # As a pattern the path may be one file or a folder of files; a plain path to a file is refused.
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return stream_files(spark, f"{folder}/{name}.parque[t]", schema, files_per_batch)


def stream_corpus(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """Arriving text files, each once: ``path`` and ``text``."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(folder, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def stream_findings(
    stream: DataFrame, rules: DataFrame, text: str = "text", language: str | None = None
) -> DataFrame:
    """Rule findings on arriving texts. Stateless: the source's checkpoint makes each file count once."""
    return scan_texts(stream, rules, language, text)


def stream_pattern_stats(findings: DataFrame, seen_at: str = "seen_at", mode: str = "literals") -> DataFrame:
    """Running count and first and last sighting per message pattern (update or complete mode)."""
    keyed = message_template(findings, mode=mode)
    return keyed.groupBy("pattern_id", F.col("rule_name").alias("rule_id")).agg(
        F.count("*").alias("count"), F.min(seen_at).alias("first_seen"), F.max(seen_at).alias("last_seen")
    )


def stream_throttle(
    calls: DataFrame, keys: Sequence[str], ts: str, per_window: int = 20, window: str = "60 seconds",
    delay: str = "60 seconds",
) -> DataFrame:
    """Calls, accepted and rejected per key and clock-aligned window; the watermark drops late calls."""
    counted = calls.withWatermark(ts, delay).groupBy(*keys, F.window(ts, window).alias("__window")).agg(
        F.count("*").alias("calls"))
    accepted = F.least(F.col("calls"), F.lit(per_window))
    return counted.select(
        *keys,
        F.col("__window.start").alias("window_start"),
        "calls",
        accepted.alias("accepted"),
        (F.col("calls") - accepted).alias("rejected"),
    )


class _Slices(StatefulProcessor):
    """Rows wait in slices of event time and are judged, slice by slice, once the watermark has passed a slice's end.

    One state belongs to a shard of keys: the rows of each slice in parts (a batch adds a part and touches no other), the number of
    parts of each slice, and the windows that are open at the end of the last slice judged. A timer stands at the end of
    each slice that has rows, so only slices that are due are read.
    """

    def __init__(self, ts: str, tie: str, width: int, slice_width: int, columns: Sequence[str], judge: Callable) -> None:
        self.ts, self.tie, self.width, self.slice_width, self.columns, self.judge = ts, tie, width, slice_width, list(columns), judge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "slice long, part int", "rows binary")
        self.parts = handle.getMapState("parts", "slice long", "parts int")
        self.open = handle.getValueState("open", "windows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = [part for part in rows if len(part)]
        if arrived:
            frame = pd.concat(arrived, ignore_index=True)
            number = frame[self.ts].to_numpy("datetime64[us]").astype(np.int64) // self.slice_width
            for slice_number, part in frame.groupby(number, sort=False):
                at = int(slice_number)
                before = self.parts.getValue((at,)) if self.parts.containsKey((at,)) else (0,)
                self.rows.updateValue((at, before[0]), (pickle.dumps(part),))
                self.parts.updateValue((at,), (before[0] + 1,))
                if before[0] == 0:
                    self.handle.registerTimer(-(-(at + 1) * self.slice_width // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted(number for (number,) in self.parts.keys() if (number + 1) * self.slice_width <= passed)
        for number in due:  # the first of several timers finds all slices that are due, in their order
            (parts,) = self.parts.getValue((number,))
            frame = pd.concat([pickle.loads(self.rows.getValue((number, part))[0]) for part in range(parts)], ignore_index=True)
            for part in range(parts):
                self.rows.removeKey((number, part))
            self.parts.removeKey((number,))
            yield self._judged(frame, (number + 1) * self.slice_width)

    def _judged(self, frame: pd.DataFrame, end: int) -> pd.DataFrame:
        windows = pickle.loads(self.open.get()[0]) if self.open.exists() else {}
        frame["code"], names = pd.factorize(frame["key"])
        frame = frame.sort_values(["code", self.ts, self.tie], ignore_index=True)
        codes, at = frame["code"].to_numpy(), frame[self.ts].to_numpy("datetime64[us]").astype(np.int64)
        before = [windows.get(name) for name in names]
        known = np.array([w is not None for w in before])
        opened = np.array([w[0] if w else 0 for w in before], dtype=np.int64)
        starts = window_starts(codes, at, opened, known, self.width)
        first = np.append(True, (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1]))
        opener = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        going_on = known[codes] & (starts == opened[codes])
        added, kept = self.judge(frame, opener, going_on, [w and w[1] for w in before])
        last = np.append(codes[1:] != codes[:-1], True)
        windows |= {names[c]: (int(s), k) for c, s, k in zip(codes[last], starts[last], np.asarray(kept)[last].tolist(), strict=True)}
        # A window that has run out by the end of the slice opens anew whatever is known of it.
        self.open.update((pickle.dumps({name: w for name, w in windows.items() if w[0] + self.width > end}),))
        return frame.assign(**added)[self.columns]

    def close(self) -> None:
        pass


def _in_event_order(
    calls: DataFrame, keys: Sequence[str], ts: str, tie: str, width: int, delay: str, slice_seconds: float | None, shards: int,
    added: Sequence[tuple[str, str]], judge: Callable,
) -> DataFrame:
    """Rows of each key, judged in the order of their times behind the watermark; see :class:`_Slices`.

    A row waits until the watermark has passed its slice, because an earlier one may still arrive until then; so files in any order
    give the same result as all rows at once, as long as no row is later than ``delay``. Windows that have run out are forgotten. The last
    rows come out when later ones of any key have moved the watermark on. ``judge`` gets the sorted rows of a slice, the first
    row of each one's window in it, whether that window was open before, and what was kept of it; it returns columns and what to keep.
    """
    spark = calls.sparkSession
    spark.conf.set(STORE, ROCKS)  # the only store with timers and maps
    # Plain names inside: the processor's frames would lose others, those that begin with an underscore for instance.
    plain = {f.name: f"c{i}" for i, f in enumerate(calls.schema.fields)}
    schema = T.StructType([T.StructField(plain[f.name], f.dataType) for f in calls.schema.fields])
    for name, kind in added:
        schema = schema.add(name, T.DataType.fromDDL(kind))
    slice_width = int((slice_seconds or width / 1_000_000) * 1_000_000)
    processor = _Slices(plain[ts], plain[tie], width, slice_width, [f.name for f in schema.fields], judge)
    key = F.to_json(F.struct(*[F.col(plain[k]).alias(k) for k in keys]))
    timed = calls.filter(F.col(ts).isNotNull()).toDF(*plain.values()).withWatermark(plain[ts], delay).withColumn("key", key)
    sharded = timed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    judged = sharded.groupBy("shard").transformWithStateInPandas(processor, schema, "append", "eventTime")
    return judged.toDF(*plain, *[name for name, _ in added])


def stream_throttle_exact(
    calls: DataFrame, keys: Sequence[str], ts: str, tie: str, per_window: int = 20, window_seconds: int = 60,
    delay: str = "60 seconds", slice_seconds: float | None = None, shards: int = SHARDS,
) -> DataFrame:
    """Accepts or rejects each call; a window opens at the first call after the last one has run out.

    Calls are judged in the order of their times once the watermark has passed their slice of ``slice_seconds`` (a window's length
    without it), so shuffled files change nothing as long as no call is later than ``delay``. State holds the calls of slices
    that are not yet past, and the open window of each key with its number of calls. ``shards`` is the number of states that keys are dealt
    to; it has to stay the same over restarts. Calls without a time are left out.
    """

    def judge(rows: pd.DataFrame, opener: np.ndarray, going_on: np.ndarray, kept: list) -> tuple[dict, np.ndarray]:
        used = np.array([k or 0 for k in kept], dtype=np.int64)[rows["code"].to_numpy()]
        place = np.arange(len(rows)) - opener + np.where(going_on, used, 0)
        return {"accepted": place < per_window}, place + 1

    width = int(window_seconds * 1_000_000)
    return _in_event_order(calls, keys, ts, tie, width, delay, slice_seconds, shards, [("accepted", "boolean")], judge)


def stream_dedup(
    requests: DataFrame, content: Sequence[str], ts: str, tie: str, ttl_seconds: int = 300, delay: str = "5 minutes",
    slice_seconds: float | None = None, shards: int = SHARDS,
) -> DataFrame:
    """Requests with ``answered_by``, the ``tie`` of the request whose result they get, and ``fresh`` (their own).

    A request is answered anew if the last fresh answer to the same content is at least the time to live
    old, otherwise it gets that answer. Times decide, not the order of arrival. Slices and shards are those of
    :func:`stream_throttle_exact`.
    """
    kind = requests.schema[tie].dataType.simpleString()

    def judge(rows: pd.DataFrame, opener: np.ndarray, going_on: np.ndarray, kept: list) -> tuple[dict, np.ndarray]:
        answered = rows[inner].to_numpy()[opener]
        earlier = np.array(kept, dtype=object)[rows["code"].to_numpy()]
        answered = np.where(going_on, earlier, answered) if going_on.any() else answered
        fresh = (np.arange(len(rows)) == opener) & ~going_on
        return {"answered_by": answered, "fresh": fresh}, answered

    keyed = requests.withColumn("content_key", F.sha2(F.to_json(F.struct(*content)), 256))
    inner = f"c{keyed.columns.index(tie)}"
    width = int(ttl_seconds * 1_000_000)
    return _in_event_order(
        keyed, ["content_key"], ts, tie, width, delay, slice_seconds, shards, [("answered_by", kind), ("fresh", "boolean")], judge)


def stream_run_summary(
    runs: DataFrame, at: str = "at", window: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Runs, success rate, mean duration and issues per time window of the run log."""
    return runs.withWatermark(at, delay).groupBy(F.window(at, window).alias("__window")).agg(
        F.count("*").alias("runs"),
        ratio(F.count_if("success"), F.count("*")).alias("success_rate"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.coalesce(F.sum("issues_found"), F.lit(0)).alias("issues_found"),
    ).select(F.col("__window.start").alias("window_start"), "runs", "success_rate", "avg_duration_ms", "issues_found")


def stream_run_log(
    spark: SparkSession, folder: str, schema: str = RUN_LOG_SCHEMA, files_per_batch: int = 1000
) -> DataFrame:
    """The JSON-lines run log as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process everything available now and return what was written, with its ``batch``.

    Each batch overwrites its own folder, so a batch that is replayed after a failure is not
    written twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")


def last_state(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Result of an update-mode query at the end: the latest row of every key."""
    return latest_per_key(written, keys, ["batch"]).drop("batch")
