"""Findings: combining, templates, pattern statistics, proposals, contexts and fixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findspan.functions.text import extension
from findspan.operators.rules import not_yet_known

# Rules that generated code breaks most often.
COMMON_MISTAKES = (
    "no-unused-vars", "no-console", "prefer-const", "no-var", "eqeqeq", "no-undef",
    "no-duplicate-imports", "no-unreachable", "prefer-arrow-callback", "no-magic-numbers",
)

# Words that mark a string literal as a credential.
CREDENTIAL_WORDS = (
    "password", "pwd", "pass", "token", "tok", "jwt", "key", "api_key", "apikey",
    "secret", "sec", "private", "auth", "oauth", "bearer",
)

DEFAULT_CONFIDENCE = 0.8
FIX_CONFIDENCE = 0.9


def combine_engines(**engines: DataFrame) -> DataFrame:
    """Concatenate the findings of several engines, tagged with the engine in ``source``; no de-duplication."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in engines.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def sort_findings(findings: DataFrame) -> DataFrame:
    """Order by file, line, column and rule (a range shuffle, every task sorts its own range)."""
    return findings.orderBy("file_path", "line", "column", "rule_name")


def template_of(message: Column, mode: str = "literals") -> Column:
    """Message with quoted texts and numbers (``full``: and identifiers) replaced by placeholders."""
    text = F.regexp_replace(message, "'[^']*'", "'<STRING>'")
    text = F.regexp_replace(text, '"[^"]*"', '"<STRING>"')
    text = F.regexp_replace(text, r"\b\d+\b", "<NUMBER>")
    if mode == "full":
        text = F.regexp_replace(text, r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", "<IDENTIFIER>")
    elif mode != "literals":
        raise ValueError(f"unknown mode {mode!r}")
    return text


def message_template(
    df: DataFrame, rule: str = "rule_name", message: str = "message", mode: str = "literals"
) -> DataFrame:
    """Add the message ``template`` and the ``pattern_id`` (rule and template)."""
    return df.withColumn("template", template_of(F.col(message), mode)).withColumn(
        "pattern_id", F.concat_ws("::", F.col(rule), F.col("template"))
    )


def pattern_stats(findings: DataFrame, seen_at: str = "seen_at", mode: str = "literals") -> DataFrame:
    """Per recurring pattern: count, first and last seen, file types and findings per severity.

    A first aggregation by pattern, severity and file type shrinks every pattern to a handful of
    rows before any list is built, so a pattern with a third of all findings stays cheap. The
    contexts of a pattern are the rows of :func:`pattern_contexts`, not a list.
    """
    keyed = message_template(findings, mode=mode).withColumn(
        "file_type", F.coalesce(F.nullif(extension(F.col("file_path")), F.lit("")), F.lit("unknown"))
    )
    first = F.struct(seen_at, "file_path", "line", "column")
    partial = keyed.groupBy("pattern_id", F.col("rule_name").alias("rule_id"), "severity", "file_type").agg(
        F.count("*").alias("n"),
        F.min(seen_at).alias("first_seen"),
        F.max(seen_at).alias("last_seen"),
        F.min(F.struct(first.alias("at"), F.col("message").alias("message"))).alias("opening"),
    )
    by_severity = partial.groupBy("pattern_id", "rule_id", "severity").agg(
        F.sum("n").alias("n"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("opening").alias("opening"),
        F.collect_set("file_type").alias("types"),
    )
    return by_severity.groupBy("pattern_id", "rule_id").agg(
        F.sum("n").alias("count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("opening")["message"].alias("message_template"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("file_types"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severity_distribution"),
    )


def pattern_contexts(
    findings: DataFrame, contexts: DataFrame, mode: str = "literals", keep: Sequence[str] = ()
) -> DataFrame:
    """Code context of every finding with its pattern: one row per finding, any number per pattern."""
    keyed = message_template(findings, mode=mode).select("pattern_id", "file_path", "line", *keep)
    return keyed.join(contexts, ["file_path", "line"])


def pattern_clusters(stats: DataFrame) -> DataFrame:
    """Patterns of the same rule form a cluster; one row per member, so clusters may be of any size."""
    return stats.select(
        F.concat(F.lit("cluster_"), F.col("rule_id")).alias("cluster_id"), "rule_id", "pattern_id"
    )


# Name and description of a proposed rule; the description has the count and the template put in.
PROPOSED_NAME = "Adaptive Rule: "
PROPOSED_DESCRIPTION = ("AI-generated rule for pattern detected ", " times: ")


def propose_rules(
    stats: DataFrame, known: DataFrame | None = None, min_count: int = 3, min_confidence: float = 0.8
) -> DataFrame:
    """New rules for frequent patterns that have none yet."""
    frequency = F.least(F.col("count") / F.lit(10.0), F.lit(1.0))
    consistency = F.when(F.col("count") > 1, 0.8).otherwise(0.5)
    proposals = (
        stats.filter(F.col("count") >= min_count)
        .select(
            F.concat(F.lit("adaptive_"), F.col("pattern_id")).alias("rule_id"),
            F.concat(F.lit(PROPOSED_NAME), F.col("rule_id")).alias("name"),
            F.concat(
                F.lit(PROPOSED_DESCRIPTION[0]), F.col("count").cast("string"),
                F.lit(PROPOSED_DESCRIPTION[1]), F.col("message_template"),
            ).alias("description"),
            F.lit("warning").alias("severity"),
            F.round((frequency + consistency) / 2, 9).alias("confidence"),
            F.col("count").alias("training_examples"),
        )
        .filter(F.col("confidence") >= min_confidence)
    )
    return proposals if known is None else not_yet_known(proposals, known)


def lint_metrics(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Findings, errors, warnings and distinct files, over all or per key (such as the engine)."""
    return findings.groupBy(*keys).agg(
        F.count("*").alias("findings"),
        F.countDistinct("file_path").alias("files_processed"),
        F.count_if(F.col("severity") == "Error").alias("errors"),
        F.count_if(F.col("severity") == "Warning").alias("warnings"),
    )


def with_context(lines: DataFrame, findings: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """Up to ``n`` lines before and after each finding, clipped at the ends of the text.

    Only lines near findings are joined; no window runs over whole texts, and each (text, line)
    is a key of its own, so long texts do not skew.
    """
    wanted = findings.select(*keys, "line").distinct().withColumn(
        "__near", F.explode(F.sequence(F.greatest(F.col("line") - n, F.lit(1)), F.col("line") + n))
    )
    source = lines.select(*keys, F.col("line").alias("__near"), "line_text")
    around = wanted.join(source, [*keys, "__near"])
    entry = F.struct("__near", "line_text")

    def texts(condition: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(condition, entry)))
        return F.transform(ordered, lambda e: e["line_text"])

    return around.groupBy(*keys, "line").agg(
        texts(F.col("__near") < F.col("line")).alias("before_lines"),
        F.max(F.when(F.col("__near") == F.col("line"), F.col("line_text"))).alias("error_line"),
        texts(F.col("__near") > F.col("line")).alias("after_lines"),
    )


def mistake_summary(findings: DataFrame, listed: DataFrame, confidence: str = "confidence") -> DataFrame:
    """All findings, those of listed rules, and the mean confidence of the listed ones (0 when none)."""
    marked = findings.join(
        listed.select("rule_name").distinct().withColumn("__listed", F.lit(True)), "rule_name", "left"
    )
    hit = F.coalesce(F.col("__listed"), F.lit(False))
    return marked.agg(
        F.count("*").alias("total_mistakes"),
        F.count_if(hit).alias("ai_generated_mistakes"),
        F.coalesce(F.avg(F.when(hit, F.col(confidence))), F.lit(0.0)).alias("average_confidence"),
    )


def confident(
    predictions: DataFrame, thresholds: DataFrame, default: float = DEFAULT_CONFIDENCE, key: str = "pattern_id"
) -> DataFrame:
    """Predictions at or above their pattern's threshold, or the default where none is set."""
    limits = thresholds.select(key, F.col("threshold").alias("__threshold"))
    return (
        predictions.join(limits, key, "left")
        .filter(F.col("confidence") >= F.coalesce("__threshold", F.lit(default)))
        .drop("__threshold")
    )


def confident_fixes(fixes: DataFrame, minimum: float = FIX_CONFIDENCE) -> DataFrame:
    """Fix suggestions that are certain enough to be shown."""
    return fixes.filter(F.col("confidence") >= minimum)


DEFAULT_LITERAL = r"\"[^\"\n]*\"|'[^'\n]*'"


# Kind, message, advice, confidence and impact of the two findings about literals.
CREDENTIAL_FINDING = (
    "hardcoded-credential", "Potential hardcoded credential detected",
    "// Use environment variables or secure key management", 0.8, 8)
URL_FINDING = ("insecure-url", "Insecure HTTP URL detected", "// Use HTTPS instead of HTTP", 0.9, 7)


def secret_literals(df: DataFrame, text: str, literal_re: str = DEFAULT_LITERAL) -> DataFrame:
    """String literals that look like credentials, and literals with plain http addresses."""
    kept = [c for c in df.columns if c != text]
    literals = df.select(*kept, F.explode(F.regexp_extract_all(F.col(text), F.lit(literal_re), F.lit(0))).alias("__quoted"))
    value = F.col("value")
    low = F.lower(value)
    credential = reduce(lambda a, b: a | b, [low.contains(w) for w in CREDENTIAL_WORDS])
    credential = credential & (F.octet_length(value) > 8) & ~value.rlike(r"^\p{L}*\z")

    def finding(kind: str, message: str, fix: str, confidence: float, impact: int) -> Column:
        return F.struct(
            F.lit(kind).alias("rule_name"), F.lit(message).alias("message"), F.lit(fix).alias("suggested_fix"),
            F.lit(confidence).alias("confidence"), F.lit(impact).alias("impact_score"),
        )

    found = F.array_compact(
        F.array(
            F.when(credential, finding(*CREDENTIAL_FINDING)),
            F.when(low.startswith("http://"), finding(*URL_FINDING)),
        )
    )
    return (
        literals.withColumn("value", F.expr("substring(__quoted, 2, length(__quoted) - 2)"))
        .select(*kept, "value", F.explode(found).alias("finding"))
        .select(*kept, "value", "finding.*")
    )


def apply_replacements(df: DataFrame, fixes: DataFrame, key: str, text: str) -> DataFrame:
    """Apply each text's fixes from the last line to the first, every occurrence of each.

    ``fixes`` has the key, ``line``, ``original`` and ``fixed``. Fixes of one text belong to one
    output value, so they are gathered per text, a repeated one once; ties on a line go by original
    and fixed text.
    """
    fix = F.struct((-F.col("line")).alias("at"), "original", "fixed")
    wanted = fixes.filter(F.length("original") > 0).select(key, "line", "original", "fixed").distinct()
    gathered = wanted.groupBy(key).agg(F.array_sort(F.collect_list(fix)).alias("__fixes"))
    patched = F.aggregate(
        F.coalesce("__fixes", F.array()), F.col(text), lambda t, f: F.replace(t, f["original"], f["fixed"])
    )
    return df.join(gathered, key, "left").withColumn(text, patched).drop("__fixes")
