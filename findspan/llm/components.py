"""Connected components of links between integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.session import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(row)


def _to_minimum(edges: DataFrame) -> DataFrame:
    """Links of u to larger neighbours move to the least neighbour of u (or u itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _to_least_below(edges: DataFrame) -> DataFrame:
    """Links of u to smaller neighbours move to the least of them, and u itself with them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """From links (u, v) to rows (u, v) that link each member u to the least member v of its component.

    Two alternating steps shorten paths to the least member; their number grows with the logarithm of
    the longest path. Each step groups links by one end, so a member with very many links is only a
    key of a minimum (reduced before the shuffle) and of a join that Spark may split. Links between
    equal ends and repeated links are dropped; the least members themselves have no row.
    """
    edges = cut_lineage(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _mark(edges)
    while before[0]:
        edges = cut_lineage(_to_least_below(_to_minimum(edges)))
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges
