"""Corpus files, lint reports, rule catalogues and run logs."""

from __future__ import annotations

import errno
import itertools
import os
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from findspan.functions.text import glob_regex
from findspan.operators.rules import severity_label
from findspan.operators.versions import latest_per_key
from findspan.session import work_dir

# What is linted by default.
INCLUDE = ("**/*.{ts,tsx,js,jsx}",)
EXCLUDE = ("node_modules/**", "dist/**", "build/**")

REPORT_SCHEMA = (
    "filePath string, messages array<struct<ruleId: string, message: string, line: int, column: int, "
    "severity: string, fix: string>>"
)

_RULE = (
    "struct<id: string, name: string, description: string, category: string, severity: string, "
    "implementation: struct<type: string, rule_name: string>, cost: int, autofix: boolean, "
    "ai_enhanced: boolean, tags: array<string>, dependencies: array<string>>"
)
CATALOG_SCHEMA = (
    f"rulebase struct<static_rules: array<{_RULE}>, behavioral_rules: array<{_RULE}>, hybrid_rules: array<{_RULE}>>"
)

RUN_LOG_SCHEMA = (
    "file_path string, success boolean, total_steps int, executed_steps array<string>, "
    "duration_ms long, issues_found long, ai_strategy string, at timestamp"
)
RUN_LOG_LIMIT = 5000


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """Whether ignore rules leave a file out; ``path`` is relative to the folder the rules are for.

    The rules are the lines of an ignore file: ``#`` comments, ``!`` takes a rule back, a name without
    ``/`` counts at any depth, one with ``/`` from the top, one with ``/`` at the end only for folders. The last rule that
    matches decides, and nothing below an ignored folder comes back.
    """
    parts = F.split(path, "/")
    # Every folder on the way and at last the file itself.
    steps = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), (n < F.size(parts)).alias("folder")),
    )

    def left_out(step: Column) -> Column:
        verdict = F.lit(False)
        for line in rules:
            rule = line.rstrip("\n").rstrip()
            if not rule or rule.startswith("#"):
                continue
            back = rule.startswith("!")
            rule = rule.removeprefix("!").removeprefix("\\")
            folders_only = rule.endswith("/")
            rule = rule.rstrip("/")
            if "/" not in rule:
                rule = "**/" + rule
            hit = step["path"].rlike(glob_regex(rule.removeprefix("/"), literal_separator=True))
            if folders_only:
                hit = hit & step["folder"]
            verdict = F.when(hit, F.lit(not back)).otherwise(verdict)
        return verdict

    return F.exists(steps, left_out)


#: What Spark escapes in the names of partition folders, and what it calls the folder of a missing or empty value.
_ESCAPED, _NO_VALUE = re.compile("[\x00-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]"), "__HIVE_DEFAULT_PARTITION__"


def _write_part(folder: str, columns: Sequence[str], text: str, rows: Iterable[Row]) -> None:
    """The files of one task; the rows of a folder follow each other."""
    for values, same in itertools.groupby(rows, lambda r: tuple(r[c] for c in columns)):
        names = [f"{c}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', str(v)) if v not in (None, '') else _NO_VALUE}" for c, v in zip(columns, values)]
        where = os.path.join(folder, *names)
        os.makedirs(where, exist_ok=True)
        # Named after the task's share of the rows: a repeated task writes the same file again.
        with open(os.path.join(where, f"part-{TaskContext.get().partitionId():05d}.txt"), "wb") as file:
            file.writelines((r[text] or "").encode("utf-8", "surrogatepass") + b"\n" for r in same)


def write_folders(df: DataFrame, folder: str, columns: Sequence[str], text: str = "text") -> None:
    """Write texts into a folder for each value of the columns, the same files as ``df.write.partitionBy(columns).text(folder)``.

    Spark's own writer starts a process for each file and folder that it makes on a local or mounted file system, which is most of the
    work when files are small; there the tasks write the files themselves. Elsewhere Spark's writer is used.
    """
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", folder)
    if not local or local[1].startswith("//"):
        df.select(*columns, text).write.partitionBy(*columns).text(folder)
        return
    os.makedirs(local[1], exist_ok=True)
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in columns], text).sortWithinPartitions(*columns)
    rows.foreachPartition(partial(_write_part, local[1], list(columns), text))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"

#: Entries after which a listing task leaves the folders it has met to the next round; files and bytes of a reading task; bytes of its batches.
_ENTRIES, _TASK_FILES, _TASK_BYTES, _BATCH_BYTES = 2_000, 10_000, 64 << 20, 8 << 20
_LISTED = {"place": pa.binary(), "folder": pa.bool_(), "bytes": pa.int64(), "modified": pa.int64()}
_LISTED_SCHEMA = "place binary, folder boolean, bytes long, modified long"


def _passed_over(name: bytes, folder: bool) -> bool:
    """Whether Spark's readers pass over a name."""
    hidden = name.startswith(b".") or name.endswith(b"._COPYING_") or name.startswith(b"_") and b"=" not in name
    return hidden and not (folder and name.startswith((b"_metadata", b"_common_metadata")))


def _entries(root: bytes, given: Iterable[bytes]) -> Iterator[tuple[bytes, bool, int, int]]:
    """Files below the given folders, and the folders that are left to list once ``_ENTRIES`` entries have been seen."""
    seen = 0
    for first in given:
        waiting = deque([first])
        while waiting:
            place = waiting.popleft()
            if place is not first and seen >= _ENTRIES:
                yield place, True, 0, 0
                continue
            with os.scandir(os.path.join(root, place)) as entries:
                for entry in entries:
                    seen += 1
                    try:
                        folder = entry.is_dir()
                        status = None if folder else entry.stat()
                    except OSError as e:  # a link to nowhere or a file that has gone
                        if e.errno in (errno.ENOENT, errno.ELOOP):
                            continue
                        raise
                    if _passed_over(entry.name, folder):
                        continue
                    inner = os.path.join(place, entry.name)
                    if status is not None:
                        if status.st_size > 0:  # Spark's reader has no row for an empty file
                            yield inner, False, status.st_size, status.st_mtime_ns // 1_000_000 * 1000
                    elif seen < _ENTRIES:
                        waiting.append(inner)
                    else:
                        yield inner, True, 0, 0


def _list_folders(root: bytes, folders: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the folders of one task hold, as rows of ``_LISTED``."""
    found = _entries(root, (place for batch in folders for place in batch.column(0).to_pylist()))
    while some := list(itertools.islice(found, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _LISTED.values())], list(_LISTED))


def _listing(spark: SparkSession, root: bytes, file_glob: str | None) -> DataFrame:
    """The files below a folder: ``place`` (the path from there), ``bytes`` and ``modified`` (microseconds).

    Tasks list the folders, round by round, and write what they find, so that the driver has no entry per file or folder.
    """
    wanted = F.lit(True)
    if file_glob:
        pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(file_glob).compiled().pattern()
        wanted = F.col("folder") | F.regexp_extract(F.col("place").cast("string"), r"([^/]*)\z", 1).rlike(rf"\A(?s:{pattern})\z")
    # A name that readers pass over, in case the shared folder is within the corpus.
    where, rounds = work_dir(spark, ".listing"), []
    folders = spark.range(0, 1, 1, 1).select(F.lit("").cast("binary").alias("place"))
    while not rounds or not folders.isEmpty():
        dealt = folders.repartition(4 * spark.sparkContext.defaultParallelism, "place") if rounds else folders
        rounds.append(f"{where}/{len(rounds)}")
        dealt.mapInArrow(partial(_list_folders, root), _LISTED_SCHEMA).filter(wanted).write.parquet(rounds[-1])
        folders = spark.read.schema(_LISTED_SCHEMA).parquet(rounds[-1]).filter("folder").select("place")
    return spark.read.schema(_LISTED_SCHEMA).parquet(*rounds).filter("NOT folder").drop("folder")


def _checked(path: bytes) -> bytes:
    """The content of a file; as in Spark's reader, an error if it differs from the checksums that Hadoop's writers put beside a local file."""
    with open(path, "rb") as file:
        content = file.read()
    folder, name = os.path.split(path)
    try:
        with open(os.path.join(folder, b"." + name + b".crc"), "rb") as file:
            kept = file.read()
    except OSError:
        return content
    width = int.from_bytes(kept[4:8], "big")
    if kept[:4] == b"crc\0" and width > 0:
        if kept[8:] != b"".join(zlib.crc32(content[at : at + width]).to_bytes(4, "big") for at in range(0, len(content), width)):
            raise OSError(f"checksum error: {os.fsdecode(path)}")
    return content


def _contents(root: bytes) -> Callable[[Column], Column]:
    """A function that gives the content of a file below a folder."""

    @F.arrow_udf("binary")
    def contents(places: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in places:
            held, size = [], 0
            for place in batch.to_pylist():
                held.append(_checked(os.path.join(root, place)))
                size += len(held[-1])
                if size >= _BATCH_BYTES:
                    yield pa.array(held, pa.binary())
                    held, size = [], 0
            if held:
                yield pa.array(held, pa.binary())

    return contents


def _local_folder(spark: SparkSession, path: str) -> bytes | None:
    """A folder of a local or mounted file system as tasks open it; None for any other path."""
    if re.search(r"[{}\[\]*?\\]", path):  # Spark takes it for a pattern
        return None
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    place = system.makeQualified(there).toUri()
    if place.getScheme() != "file" or not system.exists(there) or not system.getFileStatus(there).isDirectory():
        return None
    return os.fsencode(place.getPath())


def scan_corpus(
    spark: SparkSession,
    path: str,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    max_kb: int | None = None,
    file_glob: str | None = None,
    ignore: Sequence[str] = (),
) -> DataFrame:
    """Files below a folder: relative ``path``, ``bytes``, ``modified`` and ``text``.

    Globs and ``ignore`` rules (see :func:`ignored`) apply to the path and ``max_kb`` to the size in whole KB. All are filters on file
    metadata, so other files are never opened, and no file is where ``text`` is not used;
    ``file_glob`` already prunes the listing. ``INCLUDE`` and ``EXCLUDE`` are the usual globs for
    source code. The folder is an absolute path or a URI.

    The files are those that Spark's readers see: empty files and names that begin with ``.`` or ``_`` are left out. On a local or
    mounted file system tasks list the folders and open the files; what they have listed is a table in the shared folder. Elsewhere
    Spark's reader is used, which keeps an entry per file and folder on the driver.
    """
    if not re.sub(_SCHEME, "", path).startswith("/"):
        raise ValueError("the corpus folder must be an absolute path or a URI")
    root = _local_folder(spark, path)
    if root is not None:
        files = _listing(spark, root, file_glob)
        inside, size, modified = F.make_valid_utf8(F.col("place").cast("string")), F.col("bytes"), F.timestamp_micros("modified")
        content = _contents(root)(F.col("place"))
    else:
        files, inside = _spark_files(spark, path, file_glob)
        size, modified, content = F.col("_metadata.file_size"), F.col("modificationTime"), F.col("content")
    if include:
        files = files.filter(inside.rlike(glob_regex(include)))
    if exclude:
        files = files.filter(~inside.rlike(glob_regex(exclude)))
    if ignore:
        files = files.filter(~ignored(inside, ignore))
    if max_kb is not None:
        files = files.filter(size < (max_kb + 1) * 1024)
    if root is not None:
        count, total = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        tasks = max(1, min(count, spark.sparkContext.defaultParallelism), count // _TASK_FILES, total // _TASK_BYTES)
        files = files.repartition(tasks, "place")
    return files.select(inside.alias("path"), size.alias("bytes"), modified.alias("modified"), F.decode(content, "UTF-8").alias("text"))


def _spark_files(spark: SparkSession, path: str, file_glob: str | None) -> tuple[DataFrame, Column]:
    """The files below a folder by Spark's own reader, and their path from there."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    # The scan reports escaped absolute URIs; what follows the root is the path within the corpus.
    root = "/" + re.sub(_SCHEME, "", path).strip("/") + "/"
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    inside = F.substring(F.regexp_replace(whole, _SCHEME, ""), F.lit(len(root) + 1), F.lit(1 << 30))
    # Spark lists folders in tasks of one folder each, up to 10,000 at a time; a few folders a task cost far less.
    width = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(width)
    spark.conf.set(width, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        return reader.load(path), inside
    finally:
        spark.conf.set(width, before)


#: How the entry of a file begins in a report that linters write without extra white space.
RECORD_START = '{"filePath":'


def _split_reports(spark: SparkSession, path: str) -> DataFrame:
    """The entries of reports that are one array each, of any size: the text is cut where an entry begins, so its parts are read by many tasks.

    Inside of JSON texts quotes are escaped, so the beginning of an entry can't occur there.
    """
    parts = spark.read.option("lineSep", RECORD_START).text(path).select(F.regexp_replace("value", r"[,\]\s]*\z", "").alias("value"))
    other = F.col("value").rlike(r'(^|[^\\])"filePath"\s*:')
    checked = F.when(other, F.raise_error(F.lit(f"an entry does not begin with {RECORD_START}"))).otherwise(F.col("value"))
    # What stands before the first entry of a file is no entry.
    entries = parts.select(F.from_json(F.concat(F.lit(RECORD_START), checked), REPORT_SCHEMA).alias("entry"))
    return entries.select("entry.*")


def read_findings(spark: SparkSession, path: str, source: str, one_per_line: bool = False, split: bool = False) -> DataFrame:
    """Findings from nested lint reports; numeric (2, 1) and textual severities are accepted.

    Missing texts become empty and missing numbers 0. Each file is one JSON array and is read by
    one task, as linters write it; with ``one_per_line`` each line is an array, so that files of any size split over tasks.
    With ``split`` a file is one array and still split, if its entries begin with ``RECORD_START``; other files are refused.
    """
    if split:
        reports = _split_reports(spark, path)
    else:
        reports = spark.read.schema(REPORT_SCHEMA).option("multiLine", str(not one_per_line).lower()).json(path)
    message = reports.select(
        F.coalesce("filePath", F.lit("")).alias("file_path"), F.explode("messages").alias("m"))
    return message.select(
        F.coalesce("m.ruleId", F.lit("")).alias("rule_name"),
        F.coalesce("m.message", F.lit("")).alias("message"),
        "file_path",
        F.coalesce("m.line", F.lit(0)).alias("line"),
        F.coalesce("m.column", F.lit(0)).alias("column"),
        report_severity(F.col("m.severity")).alias("severity"),
        F.col("m.fix").isNotNull().alias("fix_available"),
        F.lit(source).alias("source"),
    )


def report_severity(raw: Column) -> Column:
    return F.when(raw.isin("2", "error"), "Error").when(raw.isin("1", "warning"), "Warning").otherwise("Info")


def read_rules(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One row per rule id from catalogues with static, behavioural and hybrid rules; the later
    entry of an id wins, over files in order of their names and over the lines of a file."""
    catalog = spark.read.schema(CATALOG_SCHEMA).option("multiLine", str(not one_per_line).lower()).json(path)
    # Within a task rows count up in the order of the file, and blocks of a file say where they start.
    catalog = catalog.select(
        "rulebase", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"))
    kinds = ("static", "behavioral", "hybrid")
    parts = [
        catalog.select(
            "__file", "__block", "__line", F.lit(order).alias("__kind_order"), F.lit(kind).alias("kind"),
            F.posexplode(f"rulebase.{kind}_rules").alias("__place", "rule"),
        )
        for order, kind in enumerate(kinds)
    ]
    rules = parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        "__file", "__block", "__line", "__kind_order", "__place", "kind", "rule.*")
    rules = rules.withColumns(
        {
            "severity": severity_label(F.col("severity")),
            "autofix": F.coalesce("autofix", F.lit(False)),
            "ai_enhanced": F.coalesce("ai_enhanced", F.lit(False)),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "dependencies": F.coalesce("dependencies", F.array().cast("array<string>")),
        }
    )
    last = latest_per_key(rules, ["id"], ["__file", "__block", "__line", "__kind_order", "__place"])
    return last.drop("__file", "__block", "__line", "__kind_order", "__place")


def read_run_log(spark: SparkSession, path: str, schema: str | StructType = RUN_LOG_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_run_log(
    df: DataFrame, path: str, new_path: str, keep_last: int = RUN_LOG_LIMIT, at: str = "at", tie: str = "file_path"
) -> None:
    """Write the newest ``keep_last`` entries of the log at ``path`` plus ``df`` as JSON lines to ``new_path``.

    The old log is not overwritten while it is being read: callers switch to the new path. Each
    task keeps at most ``keep_last`` rows before the merge.
    """
    existing = read_run_log(df.sparkSession, path, df.schema) if path else None
    every = df if existing is None else existing.select(*df.columns).unionByName(df)
    every.orderBy(F.desc(at), F.desc(tie)).limit(keep_last).write.json(new_path)
