"""Tables that are kept between runs: a run log, results by content, snapshots and keyed tables.

Every change writes new files and then names them in a new version of the folder's list, in one small file that is put in its place by a rename.
A reader takes the last complete list, so it never sees half a change, and a writer that failed leaves only files that no
list names. One writer at a time may change a folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from findspan.operators.versions import changed_since, latest_per_key
from findspan.session import cut_lineage
from findspan.sources.files import RUN_LOG_LIMIT

#: Lists of files that stay readable for readers that began with them.
KEPT_VERSIONS = 3


class Stored:
    """The list of files of a folder, one entry per part of the table."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        lists = self._path(f"{self.folder}/_lists")
        if not self._files.exists(lists):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(lists)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json"))

    def entries(self) -> list[dict]:
        """The entries of the last list; a table that was never written has none."""
        versions = self._versions()
        return self._list(versions[-1]) if versions else []

    def new_path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex}"

    def commit(self, entries: list[dict]) -> None:
        """Make a list the current one, and delete what only older lists named."""
        versions = self._versions()
        number = versions[-1] + 1 if versions else 0
        draft, target = (self._path(f"{self.folder}/_lists/{number}{end}") for end in (f".draft-{uuid.uuid4().hex}", ".json"))
        written = self._files.create(draft, True)
        try:
            written.write(bytearray(json.dumps(entries).encode()))
        finally:
            written.close()
        if not self._files.rename(draft, target):
            raise RuntimeError(f"another writer has changed {self.folder}")
        old = versions[: max(0, len(versions) + 1 - KEPT_VERSIONS)]
        if old:
            for version in old:
                self._files.delete(self._path(f"{self.folder}/_lists/{version}.json"), False)
            self._clean(self.folder, {e["path"] for v in (*versions[len(old):], number) for e in self._list(v)})

    def _list(self, version: int) -> list[dict]:
        opened = self._files.open(self._path(f"{self.folder}/_lists/{version}.json"))
        try:
            return json.loads(bytes(opened.readAllBytes()).decode())
        finally:
            opened.close()

    def _clean(self, folder: str, named: set[str]) -> None:
        """Delete what is in a folder and neither named nor above something named."""
        for status in self._files.listStatus(self._path(folder)):
            name = status.getPath().getName()
            path = f"{folder}/{name}"
            if name == "_lists" or path in named:
                continue
            if any(n.startswith(f"{path}/") for n in named):
                self._clean(path, named)
            else:
                self._files.delete(status.getPath(), True)

    def read(self, schema, entries: Iterable[dict] | None = None) -> DataFrame:
        """The rows of the entries (all, without any given)."""
        paths = [e["path"] for e in (self.entries() if entries is None else entries)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)


def append_batch(log: Stored, batch: DataFrame, number: int, keep_last: int = RUN_LOG_LIMIT, at: str = "at") -> None:
    """Add a batch to a run log, once however often it is handed over.

    A batch is a part of the log with its number, its rows and its times. After it, parts go that are older than the newest
    ``keep_last`` rows altogether: whole files, without reading any.
    """
    entries = [e for e in log.entries() if e["batch"] != number]
    path = log.new_path(f"batch-{number}")
    batch.write.parquet(path)
    rows, first, last = log.spark.read.schema(batch.schema).parquet(path).agg(
        F.count("*"), F.coalesce(F.min(at).cast("string"), F.lit("")), F.coalesce(F.max(at).cast("string"), F.lit(""))).first()
    if rows:
        entries.append({"path": path, "batch": number, "rows": rows, "first": first, "last": last})
    # A part stays unless the parts that begin after it has ended hold enough rows.
    kept = [e for e in entries if sum(x["rows"] for x in entries if x["first"] > e["last"]) < keep_last]
    log.commit(kept)


def stream_to_run_log(
    runs: DataFrame, folder: str, checkpoint: str, keep_last: int = RUN_LOG_LIMIT, at: str = "at", every: str | None = None,
) -> StreamingQuery:
    """Append a stream of runs to the log at a folder, batch by batch; without ``every`` all that is there now."""
    log = Stored(runs.sparkSession, folder)
    writer = runs.writeStream.foreachBatch(lambda batch, number: append_batch(log, batch, number, keep_last, at))
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_stored_log(spark: SparkSession, folder: str, schema, keep_last: int = RUN_LOG_LIMIT, at: str = "at", tie: str = "file_path") -> DataFrame:
    """The newest ``keep_last`` entries of a log; those without a time are the oldest."""
    return Stored(spark, folder).read(schema).orderBy(F.desc(at), F.desc(tie)).limit(keep_last)


def reuse_results(
    df: DataFrame, text: str, op: Callable[[DataFrame], DataFrame], folder: str, version: str, buckets: int = 64,
) -> DataFrame:
    """Results of ``op`` for every row's text, computed only for contents that no earlier run of this ``version`` has seen.

    ``op`` gets ``content_id`` (the digest of the text) and the text, once per content, and keeps ``content_id``; it may give any number of rows.
    Contents and their results lie in the store by the digest's first bits, so a run reads and joins the buckets it needs. A
    missing text has no results. Another version of the operator begins a store of its own.
    """
    store = Stored(df.sparkSession, f"{folder}/{version}")
    marked = df.withColumn("content_id", F.sha2(F.col(text), 256))
    bucket = F.pmod(F.conv(F.substring("content_id", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")

    def stored(kind: str, schema: str | T.StructType) -> DataFrame:
        paths = [e["path"] for e in entries if e["kind"] == kind]
        if not paths:
            return store.spark.createDataFrame([], schema)
        return store.spark.read.schema(schema).option("basePath", f"{store.folder}/{kind}").parquet(*paths)

    entries = store.entries()
    seen = stored("seen", "content_id string, bucket int")
    once = marked.filter(F.col("content_id").isNotNull()).groupBy("content_id").agg(F.any_value(text).alias(text)).withColumn("bucket", bucket)
    fresh = cut_lineage(once.join(seen, ["bucket", "content_id"], "left_anti"))
    results = op(fresh.drop("bucket")).drop(text)
    if not fresh.isEmpty():
        names = {kind: f"{store.folder}/{kind}/run={uuid.uuid4().hex}" for kind in ("results", "seen")}
        results.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(names["results"])
        fresh.select("content_id", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(names["seen"])
        entries = [*entries, *({"path": path, "kind": kind} for kind, path in names.items())]
        store.commit(entries)
    known = stored("results", results.withColumn("bucket", bucket).schema)
    asked = marked.drop(text).withColumn("bucket", bucket)
    return asked.join(known, ["bucket", "content_id"], "left").drop("bucket", "content_id")


def changed_rows(df: DataFrame, folder: str, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows that the snapshot at a folder lacks or that are newer than in it; see :func:`keep_snapshot`."""
    store = Stored(df.sparkSession, folder)
    return changed_since(df, store.read(df.select(*keys, ts).schema), keys, ts)


def keep_snapshot(df: DataFrame, folder: str, keys: Sequence[str], ts: str) -> None:
    """Make the keys and times of a table the snapshot that the next run compares with; only the last versions stay."""
    store = Stored(df.sparkSession, folder)
    path = store.new_path("snapshot")
    df.groupBy(*keys).agg(F.max(ts).alias(ts)).write.parquet(path)
    store.commit([{"path": path}])


def upsert_stored(updates: DataFrame, folder: str, keys: Sequence[str], ts: str, buckets: int = 64) -> int:
    """Merge updates into the keyed table at a folder: the newest row of each key stays, of equal times the update.

    The table lies in ``buckets`` by the hash of its keys. Only buckets with updates are read and written anew; the others are named
    again as they are. Returns how many were written.
    """
    store = Stored(updates.sparkSession, folder)
    entries = {e["bucket"]: e for e in store.entries()}
    buckets = next(iter(entries.values()))["buckets"] if entries else buckets
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = cut_lineage(updates.withColumn("__bucket", place))
    touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())  # at most as many as there are buckets
    old = store.read(updates.schema, [entries[b] for b in touched if b in entries]).withColumn("__bucket", place)
    both = old.withColumn("__update", F.lit(0)).unionByName(new.withColumn("__update", F.lit(1)))
    merged = latest_per_key(both, ["__bucket", *keys], [ts, "__update"]).drop("__update")
    path = store.new_path("rows")
    merged.repartition("__bucket").write.partitionBy("__bucket").parquet(path)
    for b in touched:
        entries[b] = {"path": f"{path}/__bucket={b}", "bucket": b, "buckets": buckets}
    if touched:
        store.commit([entries[b] for b in sorted(entries)])
    return len(touched)


def read_stored(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of a table kept by :func:`upsert_stored`."""
    return Stored(spark, folder).read(schema)
