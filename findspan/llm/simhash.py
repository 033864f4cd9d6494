"""Near-duplicates by SimHash: a grid range-join on segment bit counts, verified exactly."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.llm.common import per_batch, saved, texts
from findspan.llm.components import stars

FIELDS = 32
EVEN_BITS = 0x5555555555555555


def simhash(text: str, words: int = 4) -> int:
    """64-bit SimHash of one text: a bit is 1 if it is set in over half of the shingles' hashes."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    starts = [0, *ends]
    if len(found) < words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        hashes = [
            xxhash.xxh64_intdigest(joined[starts[i] : starts[i + words] - 1], 42)
            for i in range(len(found) - words + 1)
        ]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_in = bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * set_in > len(hashes), bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """One row (doc_id, text_hash, fp) per document.

    Words are separated by ASCII white space, A-Z count as a-z, and shingles of ``words`` words count
    as often as they occur; a shorter text is one shingle. A text without words (null and empty ones too) has
    fingerprint 0. ``text_hash`` tells rows of one key apart.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [simhash(t, words) for t in batch.column(2).to_pylist()]
        column = pa.array(np.array(prints, dtype=np.uint64).astype(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], ["doc_id", "text_hash", "fp"])

    rows = texts(docs, key, text).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(per_batch(run), "doc_id long, text_hash long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(count: int) -> list[int]:
    """Masks that cut the 32 two-bit counts into ``count`` runs of nearly equal length."""
    edges = [round(i * FIELDS / count) for i in range(count + 1)]
    return [sum(3 << (2 * i) for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def close_pairs(prints: DataFrame, radius: int = 4, spare: int = 2) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within ``radius`` differing bits.

    Embedding: the 64 bits are cut into 32 segments, and a fingerprint becomes the vector of its bit counts per
    segment (packed, two bits each). The Manhattan distance of two such vectors never exceeds the
    number of differing bits. So vectors within the radius agree in at least ``spare`` of ``radius +
    spare`` blocks of coordinates; for every choice of ``spare`` blocks those coordinates are the
    cell of a grid, and fingerprints that share a cell are compared: first the Manhattan distance,
    then the exact one. A pair is compared where it meets first, not in every cell it shares.

    Within a cell the fingerprint of most documents is the pivot. Members within the radius of the pivot
    get a link to it, and pairs of such members are not listed: they are connected already. So a
    dense group of g fingerprints gives about g links and not g * g; only pairs with a member
    outside the pivot's radius are listed. More ``spare`` blocks give smaller cells and more
    rows; each choice finds the same groups.
    """
    blocks = _blocks(radius + spare)
    choices = list(itertools.combinations(range(len(blocks)), spare))
    first = [next((t for t, c in enumerate(choices) if all(s >> k & 1 for k in c)), -1) for s in range(1 << len(blocks))]
    even = F.lit(EVEN_BITS)
    left, right = F.col("fp").bitwiseAND(even), F.shiftrightunsigned("fp", 1).bitwiseAND(even)
    # The sum of two bits, written into the two bits of its segment.
    counts = prints.withColumn("e", left.bitwiseXOR(right).bitwiseOR(F.shiftleft(left.bitwiseAND(right), 1)))
    masks = F.array(*[F.lit(_signed(sum(blocks[k] for k in c))) for c in choices])
    cells = counts.select("fp", "n", "e", F.posexplode(masks).alias("t", "mask")).withColumn(
        "cell", F.col("e").bitwiseAND(F.col("mask"))
    )
    pivots = (
        cells.groupBy("t", "cell")
        .agg(F.count("*").alias("members"), F.max_by("fp", F.struct("n", "fp")).alias("pivot"))
        .filter("members > 1")
        .drop("members")
    )
    members = cells.join(pivots, ["t", "cell"]).select(
        "t", "cell", "fp", "e", "pivot",
        (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= radius).alias("near"),
    )
    to_pivot = members.filter("near and fp <> pivot").select(F.col("fp").alias("u"), F.col("pivot").alias("v")).distinct()

    x = F.col("a.e").bitwiseXOR(F.col("b.e"))
    low, high = x.bitwiseAND(even), F.shiftrightunsigned(x, 1).bitwiseAND(even)
    manhattan = F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))
    same = sum(
        (F.when(x.bitwiseAND(F.lit(_signed(m))) == 0, 1 << k).otherwise(0) for k, m in enumerate(blocks)), F.lit(0)
    )
    met_first = F.element_at(F.array(*[F.lit(t) for t in first]), same + 1)
    pairs = (
        members.alias("a")
        .join(
            members.alias("b"),
            (F.col("a.t") == F.col("b.t"))
            & (F.col("a.cell") == F.col("b.cell"))
            & (F.col("a.fp") < F.col("b.fp"))
            & ~(F.col("a.near") & F.col("b.near"))
            & (manhattan <= radius)
            & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
            & (met_first == F.col("a.t")),
        )
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    return to_pivot.unionByName(pairs)


def spare_blocks(distinct: int) -> int:
    """Blocks of a cell for so many fingerprints: one more for each factor of 16 beyond 16 million."""
    return 2 + sum(distinct > limit for limit in (1 << 24, 1 << 28, 1 << 32))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """One row (doc_id, text_hash, fp, component_id) per document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    least key that links reach from a document, its own included (null only if all keys of the
    component are null). Exact copies share a fingerprint and are compared once. Repeated rows
    appear as often as they are given; an empty table gives no rows; other columns are not used.
    """
    rows = saved(fingerprints(docs, key, text), "simhash")
    prints = saved(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "prints")
    links = stars(close_pairs(prints, radius, spare_blocks(prints.count())))
    roots = links.unionByName(links.select(F.col("v").alias("u"), "v").distinct())
    named = roots.join(prints, roots.u == prints.fp).select("u", "v", "least")
    lowest = named.groupBy("v").agg(F.min("least").alias("lowest"))
    linked = named.join(lowest, "v").select(F.col("u").alias("fp"), "lowest")
    groups = saved(prints.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "least").alias("component_id")), "groups")
    # Both sides are plain tables here, so Spark can split a fingerprint that very many documents share.
    return rows.join(groups, "fp", "left").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """The documents that represent their near-duplicate component, all columns kept."""
    return keep_one(docs, near_duplicates(docs, key, text, radius), key, text)


def keep_one(docs: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component of ``groups`` (doc_id, text_hash, component_id) the document with the least key, all columns kept.

    The least text hash stays where rows repeat a key, one of rows that repeat both. Only keys and
    hashes travel to decide it; texts are read again and shuffled once.
    """
    kept = groups.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("keep")
    ).select(key_text("keep.doc_id").alias("_key"), F.col("keep.text_hash").alias("_hash"))
    # In a struct the columns keep their names, whatever they are called.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = whole.select(
        "row", key_text(f"row.`{key}`").alias("_key"),
        F.xxhash64(F.coalesce(F.col(f"row.`{text}`"), F.lit(""))).alias("_hash"),
    )
    chosen = left.join(kept, ["_key", "_hash"], "left_semi")
    return chosen.groupBy("_key", "_hash").agg(F.first("row").alias("row")).select("row.*")


def key_text(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("long").cast("string"), F.lit(""))
