"""Annotations in texts, fenced blocks and relations written as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findspan.functions.text import text_lines

# A documentation block, function and method heads. The block's quantifiers give
# nothing back, so a comment of any length is matched in a loop and not by recursion.
COMMENT = r"/\*\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
FUNCTION = r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)"
METHOD = (
    r"(?m)^\s*(?:public\s+|private\s+|protected\s+|readonly\s+|static\s+)*\s*"
    r"([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)\s*\{"
)

# Tags that need no definition, and words before a parameter name.
ALLOWED_TAGS = ("@param", "@returns", "@remarks", "@example", "@deprecated", "@throws", "@see")
PARAMETER_PREFIXES = ("readonly ", "public ", "private ", "protected ", "async ", "...")


def _symbols(text: Column, kind: str, pattern: str, comment: str) -> Column:
    """``array<struct<kind, comment, name, params>>``: every symbol with the block right before it.

    The optional leading group takes a comment only when nothing but white space separates it
    from the symbol, which makes it the nearest one.
    """
    flags, body = ("(?m)", pattern[4:]) if pattern.startswith("(?m)") else ("", pattern)
    whole = f"{flags}(?:({comment})\\s*)?(?:{body})"
    found = F.regexp_extract_all(text, F.lit(whole), F.lit(0))

    def one(match: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.regexp_extract(match, whole, 1).alias("comment"),
            F.regexp_extract(match, whole, 2).alias("name"),
            F.regexp_extract(match, whole, 3).alias("params"),
            match.alias("head"),
        )

    return F.transform(found, one)


def annotation_symbols(
    df: DataFrame, text: str, symbols: dict[str, str] | None = None, comment: str = COMMENT
) -> DataFrame:
    """One row per symbol with its ``comment`` (empty when undocumented), ``name`` and ``params``.

    ``symbols`` maps a kind to a pattern whose groups 1 and 2 are name and parameters. By default
    functions and methods are found; a method head that is a function's is not counted twice.
    """
    kept = [c for c in df.columns if c != text]
    patterns = symbols or {"function": FUNCTION, "method": METHOD}
    arrays = []
    for kind, pattern in patterns.items():
        found = _symbols(F.col(text), kind, pattern, comment)
        if kind == "method":
            code = lambda s: F.regexp_replace(s["head"], comment, "")
            found = F.filter(found, lambda s: ~code(s).contains("function"))
        arrays.append(found)
    return (
        df.select(*kept, F.explode(F.concat(*arrays)).alias("symbol"))
        .select(*kept, "symbol.kind", "symbol.name", "symbol.params", "symbol.comment")
        .withColumn("documented", F.col("comment") != "")
    )


def annotation_coverage(
    df: DataFrame, text: str, symbols: dict[str, str] | None = None, comment: str = COMMENT
) -> DataFrame:
    """Symbols, documented symbols and coverage in percent (100 without symbols) per text, in place."""
    kept = [c for c in df.columns if c != text]
    patterns = symbols or {"function": FUNCTION, "method": METHOD}
    total, documented = F.lit(0), F.lit(0)
    for kind, pattern in patterns.items():
        found = _symbols(F.col(text), kind, pattern, comment)
        if kind == "method":
            found = F.filter(found, lambda s: ~F.regexp_replace(s["head"], comment, "").contains("function"))
        total = total + F.size(found)
        documented = documented + F.size(F.filter(found, lambda s: s["comment"] != ""))
    return df.select(
        *kept, total.cast("long").alias("total_symbols"), documented.cast("long").alias("documented_symbols")
    ).withColumn(
        "coverage",
        F.coalesce(F.try_divide(F.col("documented_symbols") * 100.0, F.col("total_symbols")), F.lit(100.0)),
    )


def _comment_lines(comment: Column) -> Column:
    """Lines of a block without its frame and leading stars."""
    body = F.regexp_replace(F.regexp_replace(comment, r"^(?:/\*\*)+", ""), r"(?:\*/)+\z", "")
    return F.transform(text_lines(body), lambda line: F.regexp_replace(line, r"^\s*\*?\s*", ""))


def parameter_names(params: Column) -> Column:
    """Names in a parameter list without types, defaults, modifiers and destructured parts."""
    parts = F.filter(F.transform(F.split(params, ","), F.trim), lambda p: (p != "") & ~p.rlike(r"^[{\[]"))
    prefixes = "|".join(p.replace(".", r"\.") for p in PARAMETER_PREFIXES)
    names = F.transform(
        parts,
        lambda p: F.trim(
            F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(p, r"^([^:=]*)", 1)), f"^(?:{prefixes})+", ""), r"\?+\z", "")
        ),
    )
    return F.filter(names, lambda n: n != "")


def annotation_gaps(symbols: DataFrame, allowed_tags: Sequence[str] = ALLOWED_TAGS) -> DataFrame:
    """What is missing: whole comments, summaries, ``@param`` entries, and tags outside the allowed set.

    All checks look at one symbol's row only.
    """
    kept = [c for c in symbols.columns if c not in ("comment", "params", "documented")]
    lines = _comment_lines(F.col("comment"))
    tag_lines = F.filter(lines, lambda x: x.startswith("@"))
    tags = F.array_distinct(F.transform(tag_lines, lambda x: F.substring_index(x, " ", 1)))
    first_tag = F.coalesce(F.nullif(F.array_position(F.transform(lines, lambda x: x.startswith("@")), True), F.lit(0)), F.size(lines) + 1)
    no_summary = F.size(F.filter(F.slice(lines, F.lit(1), (first_tag - 1).cast("int")), lambda x: x != "")) == 0
    described = F.transform(
        F.filter(tag_lines, lambda x: F.substring_index(x, " ", 1) == "@param"),
        lambda x: F.regexp_replace(F.regexp_extract(x, r"^@param\s+(\S+)", 1), r"^[\[\]{}]+|[\[\]{}]+\z", ""),
    )
    undescribed = F.array_except(parameter_names(F.col("params")), described)
    unknown = F.array_except(tags, F.array(*[F.lit(t) for t in allowed_tags]))

    def gap(kind: str, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("gap"), detail.alias("detail"))

    missing = F.array(gap("missing-comment", F.col("name")))
    checked = F.concat(
        F.when(no_summary, F.array(gap("missing-summary", F.col("name")))).otherwise(
            F.array().cast("array<struct<gap: string, detail: string>>")
        ),
        F.transform(undescribed, lambda p: gap("missing-param", p)),
        F.transform(unknown, lambda t: gap("unknown-tag", t)),
    )
    gaps = F.when(F.col("documented"), checked).otherwise(missing)
    return symbols.select(*kept, F.explode(gaps).alias("found")).select(*kept, "found.*")


def fenced_block(text: Column) -> Column:
    """Text between the first two fences without the info line, or the whole text, trimmed."""
    fence = r"(?s)^.*?```(.*?)```"
    inner = F.regexp_extract(text, fence, 1)
    block = F.when(inner.contains("\n"), F.regexp_replace(inner, r"^[^\n]*\n", "")).otherwise(inner)
    return F.regexp_replace(F.when(text.rlike(fence), block).otherwise(text), r"^\s+|\s+\z", "")


def extract_code_blocks(df: DataFrame, text: str) -> DataFrame:
    """Add ``code``: what an answer's first fenced block holds."""
    return df.withColumn("code", fenced_block(F.col(text)))


def extract_json_edges(df: DataFrame, text: str) -> DataFrame:
    """Relations from the JSON array between the first ``[`` and the last ``]``.

    Items that lack a field or have one of another type are dropped; broken JSON gives no rows.
    """
    kept = [c for c in df.columns if c != text]
    body = F.regexp_extract(F.col(text), r"(?s)\[.*\]", 0)
    items = F.from_json(F.nullif(body, F.lit("")), "array<string>")
    # ``array<string>`` keeps every item as raw JSON, so one odd item does not void the array.
    field = {
        name: F.try_variant_get("item", f"$.{name}", "variant") for name in ("source", "target", "type", "confidence")
    }
    complete = F.schema_of_variant(field["confidence"]).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    for name in ("source", "target", "type"):
        complete = complete & (F.schema_of_variant(field[name]) == "STRING")
    return (
        df.select(*kept, F.explode(items).alias("raw"))
        .select(*kept, F.try_parse_json("raw").alias("item"))
        .filter(complete)
        .select(
            *kept,
            *[F.try_variant_get("item", f"$.{n}", "string").alias(n) for n in ("source", "target", "type")],
            F.try_variant_get("item", "$.confidence", "double").alias("confidence"),
        )
    )
