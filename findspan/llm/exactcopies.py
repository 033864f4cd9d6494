"""Exact copies, told by full contents and combined in three stages so that no group meets in one task.

Texts are equal when they are identical after each run of ASCII white space has become one space.

1. Rows are dealt to salts by their key. Every task first combines its own rows of equal digest, salt and content
   (the map side of the aggregation), so a shuffle carries a text once per task and salt.
2. The groups of a digest and a salt are merged, again by content.
3. The winners of the salts are combined over all salts, by content. They number at most ``SALTS`` per text.

The combined groups go back to the salts they have members in, and each row finds its group there, so that a text that
a third of all rows share is ``SALTS`` keys and not one. A digest that belongs to one content identifies it; that is known
after stage 3, and rows of any other digest are joined by their contents as well.

Everything is a DataFrame expression; no row passes through Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findspan.llm.common import saved

#: Keys that the rows of one text are spread over.
SALTS = 256
_WORD = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; a missing text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _salt(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")


def _used_salts() -> list[Column]:
    """The salts of a group as bits of a few integers."""
    return [
        F.bit_or(F.when(F.floor(F.col("salt") / _WORD) == i, F.expr(f"shiftleft(1L, salt % {_WORD})")).otherwise(F.lit(0).cast("long"))).alias(f"salts{i}")
        for i in range(SALTS // _WORD)
    ]


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct content and salt it occurs in: digest, salt, keep_key, group_size, content.

    ``content`` is null where the digest belongs to one content only.
    """
    rows = docs.select(F.col(key).alias("key"), normalised(F.col(text)).alias("content")).select(
        "key", digest(F.col("content")).alias("digest"), _salt("key").alias("salt"), "content"
    )
    merged = rows.groupBy("digest", "salt", "content").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    # Dealt by digest alone, so that the contents of a digest are counted without another shuffle.
    whole = (
        merged.repartition("digest").groupBy("digest", "content")
        .agg(F.min("least").alias("keep_key"), F.sum("n").alias("group_size"), *_used_salts())
        .withColumn("contents", F.count("*").over(Window.partitionBy("digest")))
    )
    bits = [f"salts{i}" for i in range(SALTS // _WORD)]
    used = F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit(element_at(array({', '.join(bits)}), cast(1 + s div {_WORD} as int)), s % {_WORD}) = 1)")
    whole = whole.select(
        "digest", "keep_key", "group_size", F.when(F.col("contents") > 1, F.col("content")).alias("content"), *bits
    )
    found = saved(whole, "contents")
    salts = F.when(F.col("group_size") == 1, F.array(_salt("keep_key"))).otherwise(used)
    return found.select("digest", F.explode(salts).alias("salt"), "keep_key", "group_size", "content")


def _placed(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column], carried: list[Column]) -> DataFrame:
    """Every row with its key, digest, keep_key, group_size and place (1: the row that stays), and the carried columns."""
    rows = docs.select(*carried, F.col(key).alias("key"), normalised(F.col(text)).alias("content"))
    rows = rows.withColumns({"digest": digest(F.col("content")), "salt": _salt("key"), "other": F.lit("")})
    found = groups(docs, key, text, digest)
    joined = rows.drop("content").join(found.filter("content IS NULL").drop("content"), ["digest", "salt"])
    shared = found.filter("content IS NOT NULL")
    if not shared.isEmpty():  # digests of several contents: told apart by the contents themselves
        apart = rows.withColumn("other", F.col("content")).join(shared, ["digest", "salt", "content"]).drop("content")
        joined = joined.unionByName(apart)
    # All rows of a key and a text have one salt, so the first of them is known within the salt.
    inside = Window.partitionBy("digest", "salt", "other").orderBy(F.col("key").asc_nulls_last())
    kept = (F.row_number().over(inside) == 1) & F.col("key").eqNullSafe(F.col("keep_key"))
    return joined.withColumn("kept", kept)


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_digest) per document.

    * Of equal texts the row with the smallest key stays (``kept``). A missing key is larger than any other; where all keys
      of a group are missing, ``keep_id`` is null. Of rows that repeat that key and text exactly one stays.
    * A missing or empty text is an empty content; a text of white space alone is one space. Both are contents like any other.
    * Very long texts are compared whole. An empty table gives no rows. Other columns are not used, whatever their names.

    The table is read twice, so its rows must be the same in both readings. Rows that share key and text, null keys among
    them, have one salt; they are sorted there by their keys, not gathered.
    """
    return _placed(docs, key, text, digest, []).select(
        F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_digest")
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row that stays of each group of equal texts, all columns kept; other cases as in ``exact_copies``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # in a struct they keep their names, whatever they are
    return _placed(docs, key, text, sha256, [row]).filter("kept").select("row.*")


def copies_sql() -> str:
    """The same for the documents, for DuckDB."""
    return r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents),
        g AS (SELECT doc_id, content, min(doc_id) OVER (PARTITION BY content) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM g
    """
