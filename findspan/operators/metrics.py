"""Structure metrics of texts and roll-ups of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.functions.scoring import maintainability_clamped, maintainability_volume
from findspan.functions.text import occurrences, text_lines

DEFAULT_OPERATORS = r"[-+*/%=<>!&|^~?:]+|[(){}\[\];,.]"
DEFAULT_WORDS = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"


def token_mix(
    df: DataFrame, text: str, operators: str = DEFAULT_OPERATORS, words: str = DEFAULT_WORDS
) -> DataFrame:
    """Vocabulary, length, volume, difficulty and effort of each text.

    Operators and operands come from two patterns. A text is one row, so its tokens are counted
    inside the row and nothing is shuffled.
    """
    extracted = df.withColumns(
        {
            "__operators": F.regexp_extract_all(F.col(text), F.lit(operators), F.lit(0)),
            "__operands": F.regexp_extract_all(F.col(text), F.lit(words), F.lit(0)),
        }
    )
    counted = extracted.withColumns(
        {
            "total_operators": F.size("__operators").cast("long"),
            "total_operands": F.size("__operands").cast("long"),
            "distinct_operators": F.size(F.array_distinct("__operators")).cast("long"),
            "distinct_operands": F.size(F.array_distinct("__operands")).cast("long"),
        }
    )
    n1, n2 = F.col("distinct_operators"), F.col("distinct_operands")
    none = (n1 == 0) | (n2 == 0)
    measured = counted.withColumns(
        {
            "vocabulary": n1 + n2,
            "length": F.col("total_operators") + F.col("total_operands"),
        }
    ).withColumns(
        {
            "volume": F.when(none, 0.0).otherwise(F.col("length") * F.log2(F.col("vocabulary"))),
            "difficulty": F.when(none, 0.0).otherwise((n1 / 2.0) * F.try_divide(F.col("total_operands"), n2)),
        }
    )
    return measured.withColumn("effort", F.col("difficulty") * F.col("volume")).drop("__operators", "__operands")


def maintainability(
    df: DataFrame, variant: str = "clamped", complexity: str = "cyclomatic", lines: str = "loc", volume: str = "volume"
) -> DataFrame:
    """Add the maintainability index: ``clamped`` to 0..100, or with ``volume`` and unclamped."""
    if variant == "clamped":
        index = maintainability_clamped(F.col(complexity), F.col(lines))
    elif variant == "volume":
        index = maintainability_volume(F.col(volume), F.col(complexity), F.col(lines))
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return df.withColumn("maintainability", index)


def improvement(before: DataFrame, after: DataFrame, keys: Sequence[str], variant: str = "score") -> DataFrame:
    """Percent by which complexity fell: ``score`` weighs three measures and may be negative,
    ``cc`` compares cyclomatic complexity only and is never below 0. A zero base gives 0."""

    def score(side: str):
        cc = F.col(f"{side}.cyclomatic").cast("double")
        if variant == "cc":
            return cc
        return cc + F.col(f"{side}.cognitive") + 2.0 * F.col(f"{side}.nesting")

    if variant not in ("score", "cc"):
        raise ValueError(f"unknown variant {variant!r}")
    joined = before.alias("b").join(after.alias("a"), list(keys))
    change = F.coalesce(F.try_divide(score("b") - score("a"), score("b")) * 100.0, F.lit(0.0))
    if variant == "cc":
        change = F.greatest(change, F.lit(0.0))
    return joined.select(*keys, change.alias("improvement"))


def line_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], text: str,
              documented: str | None = None) -> DataFrame:
    """Changed lines over the common length plus the difference in line count.

    Both versions meet in one row, so lines are compared in place. With ``documented`` (a column
    with the number of documented symbols) its growth counts as well.
    """
    extra = [documented] if documented else []
    old = before.select(*keys, F.col(text).alias("__old"), *[F.col(c).alias("__old_documented") for c in extra])
    new = after.select(*keys, F.col(text).alias("__new"), *[F.col(c).alias("__new_documented") for c in extra])
    joined = old.join(new, list(keys)).withColumns(
        {"__old_lines": text_lines(F.col("__old")), "__new_lines": text_lines(F.col("__new"))}
    )
    common = F.least(F.size("__old_lines"), F.size("__new_lines"))
    pairs = F.zip_with(
        F.slice("__old_lines", F.lit(1), common), F.slice("__new_lines", F.lit(1), common), lambda a, b: a != b
    )
    changed = F.size(F.filter(pairs, lambda different: different)) + F.abs(
        F.size("__old_lines") - F.size("__new_lines")
    )
    if documented:
        changed = changed + F.greatest(F.col("__new_documented") - F.col("__old_documented"), F.lit(0))
    return joined.select(*keys, changed.cast("long").alias("changed_lines"))


def project_rollup(files: DataFrame, findings: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Mean of the truncated improvements, and refactoring suggestions.

    Files that improve by more than 30 % get a suggestion each; more than 10 findings of rules
    named after "any" give one per project.
    """
    summary = files.groupBy(*keys).agg(
        F.count("*").alias("files_analyzed"),
        F.coalesce(
            F.try_divide(F.sum(F.greatest(F.col("improvement"), F.lit(0)).cast("long")).cast("double"), F.count("*")),
            F.lit(0.0),
        ).alias("complexity_improvement"),
    )
    complex_files = files.filter(F.col("improvement") > 30.0).select(
        *keys,
        F.lit("ExtractMethod").alias("suggestion"),
        F.col("file_path"),
        F.col("improvement").cast("long").alias("estimated_reduction"),
        F.lit(0.85).alias("confidence"),
    )
    any_rules = findings.filter(F.col("rule_name").contains("any")).groupBy(*keys).agg(F.count("*").alias("n"))
    typing = any_rules.filter(F.col("n") > 10).select(
        *keys,
        F.lit("ReplaceWithInterface").alias("suggestion"),
        F.lit(None).cast("string").alias("file_path"),
        F.floor(F.col("n") * 0.5).cast("long").alias("estimated_reduction"),
        F.lit(0.9).alias("confidence"),
    )
    return summary, complex_files.unionByName(typing)


def response_summary(outcomes: DataFrame) -> DataFrame:
    """Per file: issues found, issues fixed (the model's result before the linter's), success and a message.

    Optional maps ``learned_patterns`` and ``custom_prompts`` give what was learned and optimised;
    without the first, warnings count as learned.
    """
    fixed = (
        F.when(F.coalesce("model_success", F.lit(False)), F.coalesce("model_resolved", F.lit(0)))
        .when(F.coalesce("linter_success", F.lit(False)), F.coalesce("linter_fixed", F.lit(0)))
        .otherwise(0)
    )

    def entries(name: str):
        known = name in outcomes.columns
        return F.when(F.col(name).isNotNull(), F.size(name)) if known else F.lit(None).cast("int")

    return outcomes.withColumns(
        {
            "issues_found": F.col("findings") + F.col("warnings"),
            "issues_fixed": fixed,
            "patterns_learned": F.coalesce(entries("learned_patterns"), F.col("warnings")),
            "prompts_optimized": F.coalesce(entries("custom_prompts"), F.lit(0)),
        }
    ).withColumns(
        {
            "success": F.coalesce("task_success", F.lit(False)) & (F.col("issues_fixed") >= F.col("findings")),
            "message": F.format_string(
                "Analysis complete: %d issues found, %d issues flagged for fixing", "issues_found", "issues_fixed"
            ),
        }
    )


def branch_count(df: DataFrame, text: str, out: str = "cyclomatic") -> DataFrame:
    """One plus the branching words of a text: a stand-in for parsed cyclomatic complexity."""
    words = ("if ", "for ", "while ", "case ", " && ", " || ")
    return df.withColumn(out, (F.lit(1) + sum((occurrences(F.col(text), w) for w in words), F.lit(0))).cast("long"))
