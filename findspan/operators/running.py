"""Running totals and neighbours along an order, without putting one key into one task.

A window over a whole key sorts all its rows in one task. Here the rows are dealt by range of (key, order), so that a
key with a third of all rows, or with all of them at one hour, is split wherever the ranges end; only the rows of one key in one range
are sorted together. A scan over the ranges' few totals carries what came before into each of them. A caller that has a
coarse bucket that follows the order may name it instead of the ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findspan.session import cut_lineage

def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "__range") -> DataFrame:
    """Add the number of the row's range along (keys, order): a larger one never comes before a smaller one.

    Ranges are of about equal size, whatever the keys. The table is written below the shared folder, so that all that
    reads it sees the same ranges. Rows that are equal in keys and order are in one range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *[F.col(c) for c in (*keys, *order)])
    return cut_lineage(dealt.withColumn(name, F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | None = None,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running sums and maxima up to and including each row.

    Without ``bucket`` the rows are dealt by range, see :func:`in_ranges`. A ``bucket`` saves that shuffle; it must never decrease
    along ``order`` within a key, for example ``date_trunc("hour", ts)`` or ``floor(seq / 100000)``, and one task sorts a key's
    rows of one bucket.
    """
    columns = df.columns
    if bucket is None:
        df, bucket = in_ranges(df, keys, order), F.col("__range")
    sums, maxima = dict(sums or {}), dict(maxima or {})
    steps = {**{n: (F.sum, c) for n, c in sums.items()}, **{n: (F.max, c) for n, c in maxima.items()}}
    # One struct as key: rows whose keys are null still meet in the join.
    group = F.struct(*keys, bucket.alias("__bucket"))
    source = df.withColumns({"__group": group, **{f"__v_{n}": c for n, (_, c) in steps.items()}})
    inside = W.partitionBy("__group").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = (
        W.partitionBy(*[F.col("__group")[k] for k in keys])
        .orderBy(F.col("__group")["__bucket"])
        .rowsBetween(W.unboundedPreceding, -1)
    )
    totals = source.groupBy("__group").agg(*[f(f"__v_{n}").alias(f"__t_{n}") for n, (f, _) in steps.items()])
    carried = totals.select("__group", *[f(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n, (f, _) in steps.items()])
    joined = source.withColumns({f"__w_{n}": f(f"__v_{n}").over(inside) for n, (f, _) in steps.items()}).join(
        carried, "__group"
    )
    result = {}
    for n in sums:
        result[n] = F.coalesce(f"__w_{n}", F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0))
    for n in maxima:
        result[n] = F.greatest(f"__w_{n}", f"__c_{n}")
    return joined.select(*columns, *[c.alias(n) for n, c in result.items()])


def running_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column | None = None) -> DataFrame:
    """Cumulative average after each observation."""
    totals = running(df, keys, order, bucket, {"__sum": F.col(value), "__n": F.col(value).isNotNull().cast("long")})
    return totals.withColumn("running_mean", F.try_divide("__sum", "__n")).drop("__sum", "__n")
