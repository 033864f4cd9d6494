"""Texts as tables: selection, lines, positions, languages and heuristics on whole texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findspan.functions.text import (
    bytes_of,
    extension,
    glob_regex,
    occurrences,
    position,
    sql_text,
    text_lines,
)

# File extension -> language.
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "rs": "rust",
    "py": "python",
    "go": "go",
    "java": "java",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "c++": "cpp",
    "c": "c",
}

# Extensions of the languages that have rules of their own.
SUPPORTED_BY_EXTENSION = {
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
}

# Line heuristics: name, condition, confidence, advice.
LINE_SMELLS = [
    ("long-line", "octet_length({line}) > 120", 1.0, "Break long line into multiple lines"),
    ("multiple-statements", "length({line}) - length(replace({line}, ';', '')) > 3", 0.8,
     "Split into separate lines for better readability"),
]

# What each unit of nesting or branching looks like in text.
NESTING_NEEDLES = ("{", "if ", "else if", "switch", "case ", "for ", "while ", "do ", " && ", " || ")

NESTING_LIMIT = 15


def filter_by_globs(
    df: DataFrame,
    column: str,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    literal_separator: bool = False,
) -> DataFrame:
    """Keep rows whose path matches any include glob (none given = all) and no exclude glob."""
    kept = df
    if include:
        kept = kept.filter(F.col(column).rlike(glob_regex(include, literal_separator)))
    if exclude:
        kept = kept.filter(~F.col(column).rlike(glob_regex(exclude, literal_separator)))
    return kept


def size_guard(df: DataFrame, text: str, max_kb: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Split into texts within the limit and rejected rows with a reason. Whole KB are compared."""
    kilobytes = F.floor(bytes_of(F.col(text)) / 1024)
    accepted = df.filter(F.coalesce(kilobytes <= max_kb, F.lit(True)))
    rejected = df.filter(kilobytes > max_kb).withColumn(
        "reason", F.concat(F.lit("too large: "), kilobytes.cast("string"), F.lit(f" KB > {max_kb} KB"))
    )
    return accepted, rejected


def explode_lines(df: DataFrame, text: str, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per line with a 1-based ``line`` number and ``line_text``."""
    kept = [c for c in df.columns if c != text] if keep is None else list(keep)
    return df.select(*kept, F.posexplode(text_lines(F.col(text))).alias("__at", "line_text")).select(
        *kept, (F.col("__at") + 1).alias("line"), "line_text"
    )


def locate(df: DataFrame, text: str, offset: str) -> DataFrame:
    """Add the 1-based ``line`` and ``column`` of a 0-based character offset."""
    line, column = position(F.col(text), F.col(offset))
    return df.withColumns({"line": line, "column": column})


def _probe(low: Column) -> Column:
    """Language guessed from lower-cased content; the first rule that holds wins."""

    def has(*needles: str) -> Column:
        test = F.lit(True)
        for needle in needles:
            test = test & low.contains(needle)
        return test

    # What tells each language, in this order.
    return (
        F.when(has("#!/usr/bin/env python") | has("import ", "def "), "python")
        .when(has("#!/bin/bash") | has("#!/bin/sh"), "bash")
        .when(has("use ", "fn ", "impl "), "rust")
        .when(has("package ", "func "), "go")
        .when(has("class ", "public "), "java")
        .when(has("#include", "int main"), "cpp")
        .when(has("<?php") | has("$", "function"), "php")
        .when(has("interface ") | has("type ") | has(": "), "typescript")
        .when(has("function ") | has("var ") | has("const "), "javascript")
    )


def detect_language(
    df: DataFrame, path: str | None = None, text: str | None = None, default: str | None = None
) -> DataFrame:
    """Add ``language``: by extension, else by content, else the default, else typescript."""
    candidates, marked = [], df
    if path is not None:
        ext, by_extension = extension(F.col(path)), F.lit(None).cast("string")
        for name, language in LANGUAGE_BY_EXTENSION.items():
            by_extension = F.when(ext == name, language).otherwise(by_extension)
        candidates.append(by_extension)
    if text is not None:
        # A column of its own, so that the text is put in lower case once for all probes.
        marked = marked.withColumn("__low", F.lower(F.col(text)))
        candidates.append(_probe(F.col("__low")))
    candidates.append(F.lit(default or "typescript"))
    return marked.withColumn("language", F.coalesce(*candidates)).drop("__low")


def split_supported(
    df: DataFrame,
    path: str,
    supported: Sequence[str] = ("typescript", "javascript"),
    explicit: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of supported languages and skipped rows. An explicit language overrides the extension."""
    ext, language = F.lower(extension(F.col(path))), F.lit("unknown")
    for name, value in SUPPORTED_BY_EXTENSION.items():
        language = F.when(ext == name, value).otherwise(language)
    marked = df.withColumn("language", F.lit(explicit) if explicit else language)
    wanted = F.col("language").isin(*supported)
    return marked.filter(wanted), marked.filter(~wanted)


def nesting_score(df: DataFrame, text: str) -> DataFrame:
    """Add the count of nesting and branching marks and whether it is above the limit."""
    score = sum((occurrences(F.col(text), n) for n in NESTING_NEEDLES), F.lit(0))
    return df.withColumn("nesting_score", score.cast("long")).withColumn(
        "too_nested", F.col("nesting_score") > NESTING_LIMIT
    )


def line_smells(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """Findings for long lines and for several statements on one line, one row per smell.

    ``scan_rules(…, smells=True)`` gives the same findings along with those of the rules.
    """
    kept = [c for c in lines.columns if c != text]
    smells = ", ".join(
        f"CASE WHEN {condition.format(line=f'`{text}`')} THEN named_struct('rule_name', {sql_text(name)}, "
        f"'confidence', {confidence}D, 'suggested_fix', {sql_text(fix)}) END"
        for name, condition, confidence, fix in LINE_SMELLS
    )
    return lines.select(*kept, F.expr(f"explode(array_compact(array({smells})))").alias("__smell")).select(*kept, "__smell.*")


def marker_count(df: DataFrame, text: str, markers: Sequence[str] = ("TODO", "FIXME")) -> DataFrame:
    """Add how often any of the markers occurs."""
    return df.withColumn("markers", sum((occurrences(F.col(text), m) for m in markers), F.lit(0)).cast("long"))


def paired_absence(
    df: DataFrame,
    text: str,
    needle: str = "addEventListener",
    partner: str = "removeEventListener",
    rule_name: str = "potential-memory-leak",
) -> DataFrame:
    """Rows that contain a needle but not its partner."""
    column = F.col(text)
    return df.filter(column.contains(needle) & ~column.contains(partner)).withColumn("rule_name", F.lit(rule_name))


def reuse_by_content(df: DataFrame, text: str, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``op`` once per distinct text and give its result to every row with that text.

    ``op`` receives ``content_id`` and the text and must keep ``content_id``. Copies collapse
    before the shuffle; on the way back only the hash travels, and a much-copied text is a skewed
    join key on the left side, which adaptive execution splits.
    """
    marked = df.withColumn("content_id", F.sha2(F.col(text), 256))
    once = marked.groupBy("content_id").agg(F.any_value(text).alias(text))
    return marked.drop(text).join(op(once).drop(text), "content_id", "left")
