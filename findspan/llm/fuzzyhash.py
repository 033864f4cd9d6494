"""Document fingerprints by context-triggered piecewise hashing."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.llm.common import saved, texts

WINDOW, SMALLEST, PIECES = 7, 3, 64
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LONG_RUN = re.compile(r"(.)\1{3,}")


def rolling(data: bytes) -> np.ndarray:
    """Hash of the last seven bytes at each place of a text."""
    byte = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    total = byte.copy()
    for back in range(1, min(WINDOW, len(byte))):
        total[back:] += byte[:-back] * np.uint32(pow(0x01000193, back, 1 << 32))
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x2C1B3C6D)
    return total ^ (total >> np.uint32(12))


def block_size(length: int) -> int:
    """The least of 3, 6, 12, … that gives at most about 64 pieces."""
    size = SMALLEST
    while size * PIECES < length:
        size *= 2
    return size


def signature(data: bytes, hashes: np.ndarray, size: int) -> str:
    """One digit for each piece; a piece ends where the rolling hash hits the block size's trigger, and at the end."""
    ends = [*(np.flatnonzero(hashes % np.uint32(size) == size - 1) + 1).tolist()]
    if data and (not ends or ends[-1] < len(data)):
        ends.append(len(data))
    start, digits = 0, []
    for end in ends:
        digits.append(DIGITS[zlib.crc32(data[start:end]) & 63])
        start = end
    return "".join(digits)


def fingerprint(text: str) -> str:
    """``block size:signature:signature at twice the block size`` of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    size, hashes = block_size(len(data)), rolling(data)
    return f"{size}:{signature(data, hashes, size)}:{signature(data, hashes, 2 * size)}"


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two signatures, a column of the table per step, as bits."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        match = at.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        distance += 1 if rise & last else -1 if fall & last else 0
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
    return distance


def _same_share(a: str, b: str) -> float:
    if a == b:
        return 1.0
    # Runs of one digit say little; and signatures without a common run are not alike.
    a, b = LONG_RUN.sub(r"\1\1\1", a), LONG_RUN.sub(r"\1\1\1", b)
    run = min(4, min(len(a), len(b)) // 4)
    if run and not {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b), 1)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints in 0 to 1, by the signatures at a block size that both have; 0 without one."""
    if a == b:
        return 1.0
    size_a, *of_a = a.split(":")
    size_b, *of_b = b.split(":")
    have_a = {int(size_a) * (i + 1): s for i, s in enumerate(of_a)}
    have_b = {int(size_b) * (i + 1): s for i, s in enumerate(of_b)}
    return max((_same_share(have_a[s], have_b[s]) for s in have_a.keys() & have_b.keys()), default=0.0)


def edited(text: str, following: str) -> str:
    """The last quarter of a text's characters replaced by the first ones of the text that follows."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


#: Of a document: what is known without the next one, and what follows from it.
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc: int | None, text: str, own: str, following: str, follows: str) -> tuple:
    changed = edited(text, following)
    data = changed.encode("utf-8", "surrogatepass")
    print_of = fingerprint(changed)
    return (doc, len(text), hashlib.sha256(data).hexdigest(), own, print_of, likeness(own, print_of), likeness(own, follows))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SCHEMA = pa.schema(_FIELDS)
_OPEN = pa.schema([("range", pa.int64()), ("edge", pa.string()), *_FIELDS, ("packed", pa.binary())])


def _ranges(docs: DataFrame, count: int) -> list[int]:
    """Ids that cut the documents into ``count`` ranges of nearly equal size, from an approximate quantile of the ids."""
    shares = [i / count for i in range(1, count)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else None
    return sorted(set(found or []))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: fingerprints of its text and of the text with its last quarter from the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited (likeness of the two),
    near_next (likeness to the next document's fingerprint). The next document is the one with the
    next id (a missing id comes first, rows of one id in order of their text's hash), after the last the first.
    Null texts are empty; empty texts have empty signatures and are alike. No documents give no rows.

    Texts are shuffled once, compressed, to ranges of ids; a range is read in order by one task that holds
    two texts at a time. Where ranges meet, first and last text of each are kept and joined by the
    number of the range.
    """
    spark = docs.sparkSession
    rows = texts(docs, key, text)
    bounds = _ranges(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, edges = zstandard.ZstdCompressor(level=1), np.array(bounds, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = part.column(0).to_pylist()
                number = [0 if d is None else int(np.searchsorted(edges, d, "right")) for d in ids]
                packed = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int32()), part.column(0), part.column(1), pa.array(packed, pa.binary())],
                    ["range", "doc_id", "text_hash", "packed"],
                )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, opener, last = TaskContext.get().partitionId(), zstandard.ZstdDecompressor(), None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part, out = batch.slice(start, 500), []
                for doc, packed in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text_of = opener.decompress(packed).decode("utf-8", "surrogatepass")
                    own = fingerprint(text_of)
                    if last is None:
                        out.append((number, "first", doc, None, None, own, None, None, None, packed))
                    else:
                        out.append((number, None, *_row(*last[:3], text_of, own), None))
                    last = (doc, text_of, own, packed)
                yield _batch(out, _OPEN)
        if last:
            yield _batch([(number, "last", last[0], None, None, last[2], None, None, None, last[3])], _OPEN)

    squeezed = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        squeeze, "range int, doc_id long, text_hash long, packed binary"
    )
    dealt = squeezed.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("doc_id", "text_hash")
    walked = saved(
        dealt.select("doc_id", "packed").mapInArrow(walk, f"range long, edge string, {RESULT}, packed binary"), "fingerprints"
    )
    ends = walked.filter("edge is not null").select("range", "edge", "doc_id", "fingerprint", "packed")
    used = sorted(r["range"] for r in ends.filter("edge = 'last'").select("range").collect())  # a number per range
    follows = spark.createDataFrame(
        [(a, b) for a, b in zip(used, used[1:] + used[:1], strict=True)], "range long, following long"
    )
    first = ends.filter("edge = 'first'").select(
        F.col("range").alias("following"), F.col("fingerprint").alias("next_print"), F.col("packed").alias("next_packed")
    )
    open_ends = ends.filter("edge = 'last'").join(follows, "range").join(first, "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()

        def whole(packed: bytes) -> str:
            return opener.decompress(packed).decode("utf-8", "surrogatepass")

        for batch in batches:
            rows_of = [
                _row(doc, whole(packed), own, whole(next_packed), follows_print)
                for doc, own, packed, follows_print, next_packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            ]
            yield _batch(rows_of, _SCHEMA)

    closed = open_ends.select("doc_id", "fingerprint", "packed", "next_print", "next_packed").mapInArrow(close, RESULT)
    return walked.filter("edge is null").drop("range", "edge", "packed").unionByName(closed)
