"""Layered settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.session import cut_lineage


def merge_layers(
    layers: DataFrame, tenant: str = "tenant", path: str = "path", value: str = "value", layer: str = "layer",
    separator: str = ".",
) -> DataFrame:
    """Effective settings per tenant: the highest layer wins at each path.

    A value replaces what lower layers have below its path, and paths below a value's path
    replace that value when they come from a higher layer. Each path knows its few ancestors, so
    both rules are equi-joins on (tenant, path) over aggregates that merge before the shuffle.
    """
    best = layers.groupBy(tenant, path).agg(
        F.max(layer).alias("__layer"), F.max_by(value, layer).alias(value)
    )
    parts = F.split(F.col(path), re.escape(separator))
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    above = F.transform(depths, lambda d: F.array_join(F.slice(parts, 1, d), separator))
    upward = best.select(tenant, path, "__layer", F.explode(above).alias("__above"))

    values = best.select(tenant, F.col(path).alias("__above"), F.col("__layer").alias("__above_layer"))
    hidden = upward.join(values, [tenant, "__above"]).filter(F.col("__above_layer") > F.col("__layer"))
    hidden = hidden.select(tenant, path)

    below = upward.groupBy(tenant, F.col("__above").alias(path)).agg(F.max("__layer").alias("__below_layer"))
    replaced = best.join(below, [tenant, path]).filter(F.col("__below_layer") > F.col("__layer")).select(tenant, path)

    dropped = hidden.union(replaced)
    return best.join(dropped, [tenant, path], "left_anti").select(
        tenant, path, value, F.col("__layer").alias(layer)
    )


def effective_settings(
    files: DataFrame, settings: DataFrame, path: str = "path", value: str = "value", separator: str = "."
) -> tuple[DataFrame, DataFrame]:
    """Settings of each file after those it extends, and the files that extend themselves in a circle.

    ``files`` has ``file`` and ``extends``, the ordered list of files it builds on (null or empty: none); ``settings`` has
    ``file``, ``path`` and ``value``. A later entry of the list goes over an earlier one, and a file over
    all it extends. Each round replaces the extended files in the lists by theirs, until only files without
    any are left; a file that meets itself is circular, and so is whatever extends it.
    """
    known = files.select("file", F.coalesce("extends", F.array().cast("array<string>")).alias("extends"))
    # The order of layers, lowest first; an open entry stands for a file whose own list is still to be put in.
    start = known.select("file", F.posexplode_outer("extends").alias("__at", "layer"))
    own = known.select("file", F.array().cast("array<int>").alias("rank"), F.col("file").alias("layer"), F.array("file").alias("way"))
    parents = cut_lineage(start.filter("layer is not null").select("file", F.col("__at").alias("place"), F.col("layer").alias("parent")))
    done, circular = [own.select("file", "rank", "layer")], []
    fresh = own
    while True:
        # A parent's place comes before those of the layers that it lies under.
        grown = fresh.withColumnRenamed("file", "root").join(parents.withColumnRenamed("file", "layer"), "layer")
        grown = grown.select(
            F.col("root").alias("file"), F.concat("rank", F.array("place")).alias("rank"), F.col("parent").alias("layer"), "way")
        fresh = cut_lineage(grown.select("*", F.array_contains("way", F.col("layer")).alias("again")))
        if fresh.isEmpty():
            break
        circular.append(fresh.filter("again").select("file"))
        fresh = fresh.filter("not again").select("file", "rank", "layer", F.concat("way", F.array("layer")).alias("way"))
        done.append(fresh.select("file", "rank", "layer"))
    layers = done[0]
    for more in done[1:]:
        layers = layers.unionByName(more)
    loops = known.select("file").limit(0)
    for more in circular:
        loops = loops.unionByName(more)
    loops = loops.distinct()
    # Lowest first: a deeper list sorts before the file that it belongs to, an earlier place before a later one.
    order = F.concat("rank", F.array(F.lit(2147483647)))
    placed = layers.join(loops, "file", "left_anti").select("file", order.alias("__layer"), "layer")
    values = placed.join(settings.withColumnRenamed("file", "layer"), "layer")
    merged = merge_layers(values, "file", path, value, "__layer", separator)
    return merged.select("file", path, value), loops
