"""Session defaults, shared scratch folders and tables read in blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def builder(app: str = "findspan") -> SparkSession.Builder:
    """Session builder with the settings the operators are tuned for.

    Broadcasts are left to Spark's own size threshold and adaptive re-planning; skewed join
    keys are split even when that costs an extra shuffle after the join.
    """
    return (
        SparkSession.builder.appName(app)
        .config(map=SETTINGS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )


def tune(spark: SparkSession) -> SparkSession:
    """Give a session that was built elsewhere the settings of adaptive execution."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let a Python worker get at most ``rows`` rows at a time, for texts may be long; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder beside the
    warehouse tables serves, which all executors reach as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_findspan"
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


_made: list[str] = []


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    _made.append(f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}")
    return _made[-1]


def work_so_far() -> int:
    """A mark for :func:`delete_work`."""
    return len(_made)


def delete_work(spark: SparkSession, since: int = 0, keep: Iterable[str] = ()) -> int:
    """Delete the intermediate tables that this process has made after a mark, but for those named; returns how many.

    Results are read from these tables when they are asked for, so this is for the time when they have been written elsewhere.
    """
    kept = set(keep)
    gone = [path for path in _made[since:] if path not in kept]
    for path in gone:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _made[since:] = [path for path in _made[since:] if path in kept]
    return len(gone)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that a lost executor costs a re-read and
    not a replay of all rounds. Unlike a checkpoint, a written table is computed once."""
    path = work_dir(df.sparkSession, "rounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(df: DataFrame, key: str | Sequence[str], size: int) -> Iterator[list[Row]]:
    """The rows of a table of rules, templates or candidates, about ``size`` at a time.

    A block holds the rows whose key's hash falls into it, so the driver never holds more than a block
    and a table of any length is read to its end. An empty table is one empty block.
    """
    blocks = max(1, -(-df.count() // size))
    for block in range(blocks):
        yield df.filter(F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(blocks)) == block).collect()
