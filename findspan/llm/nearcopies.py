"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from the SimHash of the shingles by the grid of ``simhash``, which finds the nearest, and from bands of minhashes, which
reach down to the similarity; every link is verified exactly on the shingles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.llm.common import per_batch, saved, texts
from findspan.llm.components import stars
from findspan.llm.simhash import close_pairs, keep_one, key_text, majority, spare_blocks

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Differing bits of fingerprints up to which a pair is verified. Similarity 0.8 has 10 on average; cells of a grid for that are too large.
RADIUS = 4
#: Minhashes of a band, and bands: a pair of similarity 0.8 shares none with probability 3e-6, one of 0.9 with 5e-12.
BAND, BANDS = 4, 24
#: Minhashes that give a bit each, and differing bits up to which a pair is verified: similarity 0.8 has 51 on average, and 85 is
#: five deviations above.
BITS, MOST_BITS = 512, 85
LONGS = [f"bits{i}" for i in range(BITS // 64)]
#: The longer sketch of sets that pivots have not linked: similarity 0.8 has 205 differing bits on average, and 273 is five deviations above;
#: 0.7 has 307.
LONG_BITS, MOST_LONG_BITS = 2048, 273
#: Differing bits of both sketches, which have their own permutations: similarity 0.8 has 256 on average, and 332 is five deviations above.
MOST_OF_ALL = 332
#: A round lists as many pairs as a few times the members of cells, and all that are left after a round that took off less than a share.
FEW, WORTH = 12, 0.1
#: Constants that all workers share.
_DRAWN = np.random.default_rng(2026).integers(0, 1 << 63, (3, BITS), dtype=np.uint64)
FLIPS, FACTORS, MIXERS = _DRAWN[0][:, None], _DRAWN[1][:, None] | np.uint64(1), _DRAWN[2] | np.uint64(1)


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a shorter text is one shingle, also one without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(found)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    starts = [0, *np.cumsum([len(w) + 1 for w in found]).tolist()]
    hashes = {xxhash.xxh64_intdigest(joined[starts[i] : starts[i + words] - 1], 42) for i in range(len(found) - words + 1)}
    return np.sort(np.fromiter(hashes, dtype=np.uint64, count=len(hashes)))


def minhashes(found: np.ndarray, flips: np.ndarray = FLIPS, factors: np.ndarray = FACTORS) -> np.ndarray:
    """The least value of each of the permutations, over a few shingles at a time so that what lies between stays in the processor's cache."""
    least = np.full(len(flips), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), 64):
        part = found[i : i + 64] ^ flips
        part *= factors
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _long_sketches(sets: DataFrame) -> DataFrame:
    """Rows (set_id, long bits) of sets (set_id, found)."""
    drawn = np.random.default_rng(2027).integers(0, 1 << 63, (3, LONG_BITS), dtype=np.uint64)
    flips, factors, mixers = drawn[0][:, None], drawn[1][:, None] | np.uint64(1), drawn[2] | np.uint64(1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = [np.packbits((minhashes(f.values.to_numpy().view(np.uint64), flips, factors) * mixers) >> np.uint64(63) != 0) for f in batch.column(1)]
        whole = pa.array(np.array(bits, dtype=np.uint8).view("<i8").reshape(-1).copy())
        longs = pa.FixedSizeListArray.from_arrays(whole, LONG_BITS // 64).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), longs], ["set_id", "long_bits"])

    found = sets.mapInArrow(per_batch(run), "set_id long, long_bits array<long>")
    return found.select("set_id", *[F.col("long_bits")[i].alias(f"long{i}") for i in range(LONG_BITS // 64)])


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, set_id (a hash of the set of shingles), size, its SimHash, the keys of its bands, its bits."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, prints, bands, bits = [], [], [], [], []
        for t in batch.column(2).to_pylist():
            found = shingles(t)
            least = minhashes(found)
            ids.append(xxhash.xxh64_intdigest(found.tobytes(), 7))
            sizes.append(len(found))
            prints.append(majority(found))
            bands.append([xxhash.xxh64_intdigest(b.tobytes(), 9) for b in least[: BAND * BANDS].reshape(BANDS, BAND)])
            bits.append(np.packbits((least * MIXERS) >> np.uint64(63) != 0))
        whole = np.array(bits, dtype=np.uint8).view("<i8")
        signed = lambda x: pa.array(np.array(x, dtype=np.uint64).astype(np.int64).reshape(-1))
        keys = pa.FixedSizeListArray.from_arrays(signed(bands), BANDS)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), signed(ids), pa.array(sizes, pa.int64()), signed(prints), keys.cast(pa.list_(pa.int64())),
             *[pa.array(whole[:, i].copy()) for i in range(len(LONGS))]],
            ["doc_id", "text_hash", "set_id", "size", "fp", "bands", *LONGS],
        )

    rows = texts(docs, key, text).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    columns = ", ".join(f"{c} long" for c in LONGS)
    return rows.mapInArrow(per_batch(run), f"doc_id long, text_hash long, set_id long, size long, fp long, bands array<long>, {columns}")


def _sets(docs: DataFrame, needed: DataFrame, key: str, text: str) -> DataFrame:
    """The shingles of the sets (set_id) whose document is named by (_key, _hash)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t).astype(np.int64) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["set_id", "found"])

    rows = texts(docs, key, text).select(key_text("doc_id").alias("_key"), F.xxhash64("text").alias("_hash"), "text")
    # Rows that repeat key and text give their set once more; a repeated link does no harm.
    return rows.join(needed, ["_key", "_hash"]).select("set_id", "text").mapInArrow(per_batch(run), "set_id long, found array<long>")


def _to_pivots(members: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of members of cells with the pivots of their cells, if sizes and sketches leave the similarity possible.

    A pivot is the member that comes first in an order which is the same for all bands, so that members of a family have few pivots over
    all their cells.
    """
    pivots = members.groupBy("t", "cell").agg(F.min_by("set_id", F.xxhash64("set_id")).alias("v"))
    facts = prints.select("set_id", "size", *LONGS)
    met = members.join(facts, "set_id").join(pivots, ["t", "cell"]).filter("set_id <> v").dropDuplicates(["set_id", "v"]).alias("a")
    possible = (
        (F.col("a.v") == F.col("b.set_id"))
        & (F.least("a.size", "b.size") >= SIMILARITY * F.greatest("a.size", "b.size"))
        & (_differing("a", "b", LONGS) <= MOST_BITS)
    )
    return met.join(facts.alias("b"), possible).select(F.col("a.set_id").alias("u"), "v")


def _apart(pairs: DataFrame, forest: DataFrame) -> DataFrame:
    """The pairs (u, v) that links have not joined yet."""
    a, b = (forest.select(F.col("u").alias(c), F.col("v").alias(f"{c}_root")) for c in "uv")
    rooted = pairs.join(a, "u", "left").join(b, "v", "left")
    return rooted.filter(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity."""
    a, b = (sets.select(F.col("set_id").alias(c), F.col("found").alias(f"{c}_found")) for c in "uv")
    shared = F.size(F.array_intersect("u_found", "v_found"))
    union = F.size("u_found") + F.size("v_found") - shared
    return pairs.join(a, "u").join(b, "v").filter(shared >= SIMILARITY * union).select("u", "v")


def _close(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets whose fingerprints are within the radius: links between fingerprints by the grid, each by the first of its
    sets, and from that to its others."""
    marks = saved(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("set_id").alias("first")), "marks")
    near = close_pairs(marks.select("fp", "n"), RADIUS, spare_blocks(marks.count())).distinct()
    a, b = (marks.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in "uv")
    between = near.join(a, "u").join(b, "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    within = prints.join(marks.filter("n > 1"), "fp").filter("set_id <> first").select(F.col("set_id").alias("u"), F.col("first").alias("v"))
    return saved(between.unionByName(within), "close")


def _pairs_left(current: DataFrame) -> int:
    """Pairs of members of a cell that are in different components, over all cells."""
    labels = current.groupBy("t", "cell", "label").agg(F.count("*").alias("n"))
    cells = labels.groupBy("t", "cell").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return cells.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0


def _differing(a: str, b: str, names: list[str]) -> F.Column:
    return sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in names), F.lit(0))


def _listed(current: DataFrame, facts: DataFrame, done: float, share: float) -> DataFrame:
    """Pairs (u, v) of a cell in different components that may be similar: those whose hash lies between ``done`` and ``done + share``.

    A pair is listed in the first cell that both are in. Members of a cell's largest component are only met by the others.
    """
    labels = current.groupBy("t", "cell", "label").agg(F.count("*").alias("n"))
    cells = labels.groupBy("t", "cell").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("major")).filter("labels > 1")
    rest = saved(current.join(cells.drop("labels"), ["t", "cell"]).join(facts, "set_id"), "rest")
    long_names = [c for c in facts.columns if c.startswith("long")]
    met_before = reduce(lambda x, y: x | y, [(F.col("a.t") > s) & (F.col("a.bands")[s] == F.col("b.bands")[s]) for s in range(BANDS - 1)])
    place = F.pmod(F.xxhash64(F.least("a.set_id", "b.set_id"), F.greatest("a.set_id", "b.set_id")), F.lit(1 << 30)) / float(1 << 30)
    pairs = rest.filter("label <> major").alias("a").join(
        rest.alias("b"),
        (F.col("a.t") == F.col("b.t"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.label") != F.col("b.label"))
        & ((F.col("b.label") == F.col("b.major")) | (F.col("a.set_id") < F.col("b.set_id")))
        & (place >= done) & (place < done + share)
        & (F.least("a.size", "b.size") >= SIMILARITY * F.greatest("a.size", "b.size"))
        & (_differing("a", "b", LONGS) <= MOST_BITS)
        & (_differing("a", "b", long_names) <= MOST_LONG_BITS)
        & (_differing("a", "b", [*LONGS, *long_names]) <= MOST_OF_ALL)
        & ~met_before,
    )
    return saved(pairs.select(F.col("b.set_id").alias("u"), F.col("a.set_id").alias("v")), "listed")


def links(docs: DataFrame, prints: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (u, v) that link each set of shingles to the least of its component, where similar sets are linked.

    Each cell (band and its key) has a pivot, and its other members are verified against it first. The pairs that are close by their
    fingerprints are verified next, but for those whose ends are joined already. Of the pairs of a cell that this leaves in
    different components some are listed by their hash, about ``FEW`` times the members, if their sizes and sketches leave the
    similarity possible, and verified; their links join components, whose other pairs need no look any more. Rounds go on until all
    pairs have been listed or joined. After a round that joined little all the rest is listed at once. A round's links are added to the
    components so far, not to the links that made them.
    """
    cells = prints.select("set_id", F.posexplode("bands").alias("t", "cell"))
    shared = cells.groupBy("t", "cell").agg(F.count("*").alias("members")).filter("members > 1").drop("members")
    members = saved(cells.join(shared, ["t", "cell"]), "members")
    close = _close(prints)
    named = members.select("set_id").unionByName(close.select(F.explode(F.array("u", "v")).alias("set_id"))).distinct()
    needed = named.join(prints.select("set_id", "sample"), "set_id").select(
        key_text("sample.doc_id").alias("_key"), F.col("sample.text_hash").alias("_hash"), "set_id"
    )
    sets = saved(_sets(docs, needed, key, text), "sets")
    forest = stars(_similar(_to_pivots(members, prints), sets))
    pending = saved(_apart(close, forest), "pending")

    def labelled() -> DataFrame:
        label = forest.select(F.col("u").alias("set_id"), F.col("v").alias("label"))
        named = members.join(label, "set_id", "left").select("t", "cell", "set_id", F.coalesce("label", "set_id").alias("label"))
        return saved(named, "labels")

    current = labelled()
    left, size, done, facts = _pairs_left(current), members.select("set_id").distinct().count(), 0.0, None
    passing, stalled = 1.0, False  # the part of the pairs left that sketches let through
    while left and done < 1.0:
        if facts is None:  # longer sketches of the members of cells that have several components, which can only become fewer
            labels = current.groupBy("t", "cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
            alone = current.join(labels.select("t", "cell"), ["t", "cell"]).select("set_id").distinct()
            longer = _long_sketches(sets.join(alone, "set_id", "left_semi").dropDuplicates(["set_id"]))
            facts = saved(prints.select("set_id", "size", "bands", *LONGS).join(longer, "set_id"), "facts")
        share = 1.0 - done if stalled else min(1.0, FEW * size / (left * passing)) * (1.0 - done)
        pairs = _listed(current, facts, done, share)
        known = forest.unionByName(_similar(pairs if pending is None else pairs.unionByName(pending), sets))
        forest, pending = stars(known), None
        done = done + share if share < 1.0 - done else 1.0
        if done < 1.0:
            looked, listed = left * share / (1.0 - done + share), pairs.count()
            passing = max(listed / looked, 1e-6)
            current = labelled()
            before, left = left, _pairs_left(current)
            stalled = listed > FEW * size / 3 and left > (1 - WORTH) * before
    return forest if pending is None else stars(forest.unionByName(_similar(pending, sets)))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, text_hash, component_id) per document.

    Words are separated by ASCII white space and A-Z count as a-z. Documents whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more are linked; ``component_id`` is the least key that links reach
    from a document, its own included (null only if all keys of the component are null). Texts without words are
    alike; a text of fewer than five words is like those of the same words. Equal sets are compared once.
    """
    rows = saved(sketches(docs, key, text), "sketches")
    sample = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("sample")
    same = [F.max(c).alias(c) for c in ("size", "fp", "bands", *LONGS)]
    prints = saved(rows.groupBy("set_id").agg(sample, *same), "sets_of_shingles")
    found = links(docs, prints, key, text)
    roots = found.unionByName(found.select(F.col("v").alias("u"), "v").distinct())
    named = roots.join(prints, roots.u == prints.set_id).select("u", "v", F.col("sample.doc_id").alias("least"))
    lowest = named.groupBy("v").agg(F.min("least").alias("lowest"))
    linked = named.join(lowest, "v").select(F.col("u").alias("set_id"), "lowest")
    groups = saved(
        prints.join(linked, "set_id", "left").select("set_id", F.coalesce("lowest", "sample.doc_id").alias("component_id")), "copies"
    )
    return rows.select("doc_id", "text_hash", "set_id").join(groups, "set_id", "left").select("doc_id", "text_hash", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that represent their component of near copies, all columns kept; which one stays is told at ``keep_one``."""
    return keep_one(docs, near_copies(docs, key, text), key, text)
