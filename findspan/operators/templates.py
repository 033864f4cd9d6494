"""Templates that apply to paths."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.functions.text import _alternatives, glob_regex
from findspan.session import cut_lineage, in_blocks

# Templates that one pass over the files handles; a longer table takes more passes.
TEMPLATES_PER_PASS = 400


def match_templates(files: DataFrame, templates: DataFrame, path: str = "path") -> DataFrame:
    """Every template whose include globs accept the path and whose exclude globs do not.

    ``templates`` (``template_id``, ``include``, ``exclude`` arrays) are read in blocks, so their
    number has no limit: the globs of a block become literal patterns in one projection, without a join.
    """
    found = None
    for rows in in_blocks(templates.select("template_id", "include", "exclude"), "template_id", TEMPLATES_PER_PASS):
        matched = [F.lit(None).cast("string")]
        for row in sorted(rows, key=lambda r: r.template_id):
            if not row.include:
                continue
            accepts = F.col(path).rlike(glob_regex(row.include))
            if row.exclude:
                accepts = accepts & ~F.col(path).rlike(glob_regex(row.exclude))
            matched.append(F.when(accepts, F.lit(row.template_id)))
        part = files.select(*files.columns, F.explode(F.array_compact(F.array(*matched))).alias("template_id"))
        found = part if found is None else found.unionByName(part)
    return found


def _glob_key(glob: str) -> str:
    """What every path that a glob accepts has: its folders up to some depth, else its extension, else nothing."""
    wild = [i for i, c in enumerate(glob) if c in "*?["]
    head = glob if not wild else glob[: wild[0]]
    tail = glob if not wild else re.split(r"[*?\]]", glob)[-1]
    if "/" in head:
        return "in " + head[: head.rindex("/") + 1]
    name = tail.rsplit("/", 1)[-1]
    return "by " + name.rsplit(".", 1)[1] if "." in name else "any"


def _indexed(globs: list[str] | None) -> list[tuple[str, str]]:
    """Key and pattern of each alternative of the globs."""
    return list(dict.fromkeys((_glob_key(one), glob_regex(one)) for glob in globs or [] for one in _alternatives(glob)))


def match_templates_indexed(files: DataFrame, templates: DataFrame, path: str = "path") -> DataFrame:
    """The rows of :func:`match_templates` for any number of templates, through an index of their globs.

    Each alternative of an include glob is kept under the folders it begins with, else under its extension. A path is looked up
    under each of its folders and its extension in one join, and only the globs that it meets are tested. Only templates
    that begin and end with wildcards meet every path.
    """
    alternatives = F.udf(lambda globs: _indexed(globs), "array<struct<key: string, pattern: string>>")  # once per template
    excluded = F.udf(lambda globs: glob_regex(globs) if globs else None, "string")
    told = templates.select("template_id", alternatives("include").alias("__globs"), excluded("exclude").alias("__not"))
    index = cut_lineage(told.select("template_id", "__globs", "__not", F.explode("__globs").alias("__glob")))
    whole = F.col(path)
    parts = F.split(whole, "/", -1)
    folders = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("in "), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    by = F.regexp_extract(whole, r"(?s)\.([^./]*)\z", 1)
    keys = F.array_distinct(F.concat(F.array(F.lit("any"), F.concat(F.lit("by "), by)), folders))
    met = files.withColumn("__key", F.explode(keys)).join(index.withColumn("__key", F.col("__glob.key")), "__key")
    # A template with several globs is found by the first that accepts the path.
    fits = F.expr(f"get(filter(__globs, g -> `{path}` RLIKE g.pattern), 0) = __glob AND (__not IS NULL OR NOT `{path}` RLIKE __not)")
    return met.filter(fits).select(*files.columns, "template_id")
