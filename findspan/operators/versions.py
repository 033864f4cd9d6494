"""Versioned things: latest rows, changes, best rows, version numbers, templates and prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findspan.operators.running import in_ranges

PROMPTS_SCHEMA = (
    "version string, optimized_prompts map<string, struct<template: string>>, "
    "copro_candidates struct<active: array<struct<name: string, template: string, score: double>>>, "
    "base_prompts map<string, struct<template: string>>"
)

HIGH_SCORE = 0.8


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key. A maximum of whole rows merges before the shuffle, so no key is too hot."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(columns)]).alias("at"), F.struct(*rest).alias("row"))
    best = df.groupBy(*keys).agg(F.max_by(ranked["row"], ranked["at"]).alias("row"))
    return best.select(*keys, "row.*").select(*df.columns)


def upsert_latest(target: DataFrame, updates: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Union of both with the newest row per key; on equal times the update wins."""
    both = target.withColumn("__update", F.lit(0)).unionByName(updates.withColumn("__update", F.lit(1)))
    return latest_per_key(both, keys, [ts, "__update"]).drop("__update")


def changed_since(df: DataFrame, snapshot: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows that the snapshot lacks or that are strictly newer than in it."""
    seen = snapshot.groupBy(*keys).agg(F.max(ts).alias("__seen"))
    return df.join(seen, list(keys), "left").filter(F.col("__seen").isNull() | (F.col(ts) > F.col("__seen"))).drop("__seen")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The best ``n`` rows per key with their ``rank``; each task keeps ``n`` per key before the shuffle."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", place).filter(F.col("rank") <= n)


def version_timeline(
    changes: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None = None, change: str = "change"
) -> DataFrame:
    """Version after each change, starting from 1.0.0: minor resets patch, major resets both.

    Within a (key, bucket) the parts are counts since the last reset. A bucket is summed up as its number of
    majors and the minors and patches after its last reset; that composes, so the sums of the earlier buckets
    give where a bucket starts: one pass over the rows and one over the buckets. Without ``bucket`` the rows are dealt by range of
    (keys, order), so that no key is one task; a ``bucket`` must never decrease along ``order`` within a key and bounds what one task sorts.
    """
    columns = changes.columns
    if bucket is None:
        changes, bucket = in_ranges(changes, keys, order), F.col("__range")
    kind = F.col("__kind")
    group = F.struct(*keys, bucket.alias("__bucket"))
    source = changes.withColumns({"__group": group, "__kind": F.col(change)})
    inside = W.partitionBy("__group").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)

    def upto(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).over(inside)

    counted = source.withColumns({
        "__majors": upto(kind == "major"), "__minors": upto(kind == "minor"), "__patches": upto(kind == "patch")})
    counted = counted.withColumns({
        "__minors_at": F.max(F.when(kind == "major", F.col("__minors"))).over(inside),
        "__patches_at": F.max(F.when(kind.isin("major", "minor"), F.col("__patches"))).over(inside)})
    # A bucket's own counts: all majors, and what follows its last major or minor (all, without one).
    totals = counted.groupBy("__group").agg(
        F.max("__majors").alias("majors"),
        (F.max("__minors") - F.coalesce(F.max("__minors_at"), F.lit(0))).alias("minors"),
        (F.max("__patches") - F.coalesce(F.max("__patches_at"), F.lit(0))).alias("patches"),
        F.max("__minors_at").isNotNull().alias("major_reset"),
        F.max("__patches_at").isNotNull().alias("reset"))
    earlier = W.partitionBy(*[F.col("__group")[k] for k in keys]).orderBy(F.col("__group")["__bucket"])
    before = earlier.rowsBetween(W.unboundedPreceding, -1)
    # Sums since the last bucket with a reset, that one's rest included.
    marks = totals.withColumns({
        "minors_upto": F.sum("minors").over(earlier.rowsBetween(W.unboundedPreceding, 0)),
        "patches_upto": F.sum("patches").over(earlier.rowsBetween(W.unboundedPreceding, 0))})
    carried = marks.select(
        "__group",
        F.coalesce(F.sum("majors").over(before), F.lit(0)).alias("__majors_before"),
        (F.coalesce(F.sum("minors").over(before), F.lit(0)) - F.coalesce(
            F.max(F.when(F.col("major_reset"), F.col("minors_upto") - F.col("minors"))).over(before), F.lit(0))).alias("__minors_before"),
        (F.coalesce(F.sum("patches").over(before), F.lit(0)) - F.coalesce(
            F.max(F.when(F.col("reset"), F.col("patches_upto") - F.col("patches"))).over(before), F.lit(0))).alias("__patches_before"))
    joined = counted.join(carried, "__group")
    minors = F.when(F.col("__minors_at").isNull(), F.col("__minors") + F.col("__minors_before")).otherwise(F.col("__minors") - F.col("__minors_at"))
    patches = F.when(F.col("__patches_at").isNull(), F.col("__patches") + F.col("__patches_before")).otherwise(F.col("__patches") - F.col("__patches_at"))
    parts = (F.col("__majors") + F.col("__majors_before") + 1, minors, patches)
    return joined.withColumn("version", F.concat_ws(".", *[p.cast("string") for p in parts])).select(*columns, "version")


def next_version(version: Column, change: Column) -> Column:
    """One bump of a version; malformed versions become 1.0.1, 1.1.0 or 1.0.0."""
    parts = F.split(version, r"\.")

    def number(index: int) -> Column:
        return F.coalesce(F.try_element_at(parts, F.lit(index)).try_cast("int"), F.lit(0)) + 1

    three = F.size(parts) == 3
    major, minor = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return (
        F.when(change == "major", F.concat(number(1).cast("string"), F.lit(".0.0")))
        .when((change == "minor") & three, F.concat(major, F.lit("."), number(2).cast("string"), F.lit(".0")))
        .when(change == "minor", "1.1.0")
        .when(three, F.concat(major, F.lit("."), minor, F.lit("."), number(3).cast("string")))
        .otherwise("1.0.1")
    )


def effective_template(base: DataFrame, history: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Optimised content where the last history entry succeeded, else the base content."""
    last = history.groupBy(key).agg(F.max_by(F.struct("content", "success"), seq).alias("__last"))
    won = F.coalesce(F.col("__last")["success"], F.lit(False))
    return base.join(last, key, "left").select(
        key,
        F.when(won, F.col("__last")["content"]).otherwise(F.col("content")).alias("content"),
        won.alias("optimized"),
    )


def rollback(history: DataFrame, ids: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Mark the last entry of the given ids as failed, so that the base content applies again."""
    last = history.join(ids.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max(seq).alias(seq))
    marked = history.join(last.withColumn("__undo", F.lit(True)), [key, seq], "left")
    return marked.withColumn("success", F.col("success") & F.col("__undo").isNull()).select(*history.columns)


def available_names(*layers: DataFrame, fallback: DataFrame | None = None, column: str = "name") -> DataFrame:
    """Distinct names of all layers in order; the fallback's only if there are none at all."""
    names = layers[0].select(column)
    for layer in layers[1:]:
        names = names.union(layer.select(column))
    names = names.distinct()
    if fallback is not None:
        # One row that says whether any name exists decides about the fallback.
        any_name = names.limit(1).select(F.lit(True).alias("__any"))
        spare = fallback.select(column).distinct().withColumn("__any", F.lit(True))
        names = names.union(spare.join(any_name, "__any", "left_anti").select(column))
    return names.orderBy(column)


def effective_prompts(docs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Prompts of each document: optimised ones, candidates above the high score, and base prompts
    without either. Documents of another major version than 1 are left out.

    ``docs`` follows ``PROMPTS_SCHEMA`` plus the keys.
    """
    usable = docs.filter(F.col("version").isNull() | F.col("version").startswith("1."))

    def entries(column: str) -> Column:
        return F.coalesce(F.map_entries(column), F.array().cast("array<struct<key:string,value:struct<template:string>>>"))

    def entry(base: Column, suffix: str, template: Column) -> Column:
        return F.struct(F.concat(base, F.lit(suffix)).alias("name"), template.alias("template"), base.alias("base"))

    # All three sections are in the row, so choosing among them needs neither a join nor a shuffle.
    optimized = F.transform(entries("optimized_prompts"), lambda e: entry(e["key"], "_optimized", e["value"]["template"]))
    active = F.coalesce("copro_candidates.active", F.array().cast("array<struct<name:string,template:string,score:double>>"))
    good = F.filter(active, lambda c: (c["score"] > HIGH_SCORE) & c["name"].isNotNull())
    candidates = F.transform(good, lambda c: entry(c["name"], "_copro", c["template"]))
    better = F.filter(F.concat(optimized, candidates), lambda p: p["template"].isNotNull())
    chosen = usable.select(*keys, "base_prompts", better.alias("__better"))
    base = F.filter(
        F.transform(entries("base_prompts"), lambda e: entry(e["key"], "", e["value"]["template"])),
        lambda p: p["template"].isNotNull() & ~F.exists("__better", lambda b: b["base"] == p["name"]))
    return chosen.select(*keys, F.explode(F.concat("__better", base)).alias("__p")).select(
        *keys, F.col("__p.name").alias("name"), F.col("__p.template").alias("template"))


def template_variables(template: Column) -> Column:
    """Distinct ``{name}`` variables in order of appearance; an unclosed name runs to the end."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([^{}][^}]*)(?:\}|\z)"), F.lit(1)))


def render_templates(
    templates: DataFrame, contexts: DataFrame, on: Sequence[str] = ("name",)
) -> tuple[DataFrame, DataFrame]:
    """Fill in templates; returns the rendered rows and the rows whose ``missing`` variable was not given.

    ``contexts`` has the join columns and ``vars`` (a map). The first missing variable is named.
    """
    joined = contexts.join(templates, list(on))
    needed = template_variables(F.col("template"))
    absent = F.array_except(needed, F.map_keys("vars"))
    marked = joined.withColumn("missing", F.try_element_at(absent, F.lit(1)))
    filled = F.aggregate(
        needed,
        F.col("template"),
        lambda text, name: F.replace(
            text, F.concat(F.lit("{"), name, F.lit("}")), F.coalesce(F.try_element_at("vars", name), F.lit(""))
        ),
    )
    rendered = marked.filter(F.col("missing").isNull()).withColumn("rendered", filled).drop("missing")
    return rendered, marked.filter(F.col("missing").isNotNull())
