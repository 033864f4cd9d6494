"""Packing along a space-filling curve: similar documents become neighbours, and the token stream is cut gaplessly."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.llm.common import saved, texts

VECTOR, DIMENSIONS, LEVELS = 1024, 4, 10
END_ID = 1


def vocabulary() -> str:
    """Path of the byte-level BPE vocabulary as ranks: the same vocabulary and ids as ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The tokenizer as a function of a text; the end-of-text string is its own id, as it is by default there."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(ranks)}
    coder = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    mark = next(iter(special))
    return lambda text: coder.encode(text, allowed_special="all") if mark in text else coder.encode_ordinary(text)


def hilbert(points: np.ndarray, levels: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, d) with ``levels`` bits a coordinate.

    Bit planes are walked from the highest: each coordinate whose bit is set inverts the first
    coordinate's lower bits, each other one swaps its lower bits with the first's; the Gray code of
    what remains, read across coordinates, is the place.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(levels - 1, 0, -1):
        below = (1 << level) - 1
        for d in range(dims):
            high = (x[d] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(levels - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(levels - 1, -1, -1):
        for d in range(dims):
            place = (place << 1) | ((x[d] >> level) & 1)
    return place


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Curve keys of hashed document vectors (n, 1024): a fixed random projection to four dimensions, then the curve."""
    projection = np.random.default_rng(8).standard_normal((VECTOR, DIMENSIONS))
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    low = vectors @ projection / np.where(length == 0, 1.0, length)
    grid = (1 << LEVELS) / (1.0 + np.exp(-1.7 * low))
    return hilbert(np.minimum(grid.astype(np.int64), (1 << LEVELS) - 1), LEVELS)


def tokenized(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: row (unique), doc_id, curve (its key), n (tokens with the end id), ids (compressed)."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze = encoder(path), zstandard.ZstdCompressor(level=1)
        row = TaskContext.get().partitionId() << 36
        buckets = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                counts, blobs, vectors = [], [], np.zeros((part.num_rows, VECTOR))
                for i, one in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encode(one), END_ID], dtype="<u2")  # ids of this vocabulary fit in two bytes
                    vectors[i] = np.sqrt(np.bincount(buckets[ids], minlength=VECTOR))
                    counts.append(len(ids))
                    blobs.append(squeeze.compress(ids.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + part.num_rows)), part.column(0), pa.array(curve_keys(vectors)),
                     pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                    ["row", "doc_id", "curve", "n", "ids"],
                )
                row += part.num_rows

    return texts(docs, key, text).mapInArrow(run, "row long, doc_id long, curve long, n long, ids binary")


def stream_places(tokens: DataFrame) -> DataFrame:
    """(row, at): where each document starts in the stream of all tokens, in curve order.

    Rows are range-sorted by curve key (ties by doc_id and row) with their token counts alone; running sums within a range
    are moved by the sum of the ranges before it. The driver sees one sum per range.
    """
    ranges = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            end = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), number, np.int64)), pa.array(end - n), batch.column(1)],
                ["row", "range", "at", "n"],
            )
            at = int(end[-1]) if len(end) else at

    order = ["curve", "doc_id", "row"]
    ranged = tokens.select("row", "n", "curve", "doc_id").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = saved(ranged.select("row", "n").mapInArrow(run, "row long, range long, at long, n long"), "places")
    totals = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    before, so_far = [], 0
    for number in sorted(totals):
        before.append((number, so_far))
        so_far += totals[number]
    shifts = F.broadcast(tokens.sparkSession.createDataFrame(before, "range long, before long"))  # a row per range
    return placed.join(shifts, "range").select("row", (F.col("at") + F.col("before")).alias("at"))


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Documents are laid end to end along the curve and the stream is cut every ``size`` tokens, so only the
    last sequence needs padding and similar documents share sequences. ``start`` counts the document's ids before the
    piece; ``ids`` are the piece's ids as two-byte integers. A null or empty text is its end id alone; repeated
    rows are packed as often as they occur; an empty table gives no rows; other columns are not used.
    Texts are tokenized once, into a table in the shared folder; the ids are shuffled once.
    """
    tokens = saved(tokenized(docs, path, key, text), "tokens")
    placed = stream_places(tokens).join(tokens, "row").select("doc_id", "at", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                columns: list[list] = [[] for _ in range(8)]
                for doc, at, blob in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    ids = np.frombuffer(open_up.decompress(blob), "<u2")
                    begin = 0
                    while begin < len(ids):
                        place = at + begin
                        length = min(len(ids) - begin, size - place % size)
                        piece = ids[begin : begin + length]
                        values = (doc, begin, length, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), place // size, place % size, piece.tobytes())
                        for column, value in zip(columns, values, strict=True):
                            column.append(value)
                        begin += length
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return placed.mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
