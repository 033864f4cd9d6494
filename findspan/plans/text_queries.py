"""Registered queries over texts: documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findspan.functions.text import line_count
from findspan.operators import corpus as X
from findspan.operators import docs as D
from findspan.operators import findings as N
from findspan.operators import metrics as M
from findspan.operators import rules as R
from findspan.operators import search as S
from findspan.operators import templates as T
from findspan.plans.registry import query, quoted, table, texts

# Rules a user adds for this data, in the form of the shipped ones.
EXTRA_RULES = [
    ("script-element", "Script Element", "Detects inline scripts", r"<script[^>]*>", "Warning", "security",
     True, ["html"], 4, None, 1.0, True, ["<script"], None),
    ("plain-link", "Plain Link", "Detects links without encryption", r"http://[^ <>]+", "Info", "security",
     True, ["*"], 3, "https://", 0.9, True, ["http://"], "http://"),
    ("mail-address", "Mail Address", "Detects mail addresses", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+", "Error", "privacy",
     True, ["*"], 8, None, 0.85, True, ["@"], None),
    ("license-line", "License Line", "Detects license texts", r"(?i)license|copyright", "Info", "documentation",
     True, ["en", "de", "fr", "es"], 1, None, 1.0, False, None, None),
    ("switched-off", "Switched Off", "Never reported", r"e", "Info", "style", False, ["*"], 1, None, 1.0, False, None, None),
    ("named-address", "Named Address", "Spell out the address", r"([A-Za-z0-9._]+)@([A-Za-z0-9]+)\.[a-z]+", "Info", "privacy",
     True, ["*"], 2, "$1 at $2", 0.7, True, ["@"], None),
]


def _lines_sql(source: str, key: str, text: str) -> str:
    return (
        f"SELECT {key}, u.line, u.line_text FROM {source}, "
        rf"unnest(string_split_regex(regexp_replace({text}, '\r?\n\z', ''), '\r?\n')) WITH ORDINALITY AS u(line_text, line) "
        f"WHERE length({text}) > 0"
    )


def corpus_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All texts with a source, a key and a language."""
    docs = texts(spark, sf, "documents", "doc_id", "lang", "text").select(
        F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("file_path"), F.col("lang").alias("language"), "text")
    pages = texts(spark, sf, "pages", "page_id", "html").select(
        F.lit("pages").alias("source"), F.col("page_id").cast("string").alias("file_path"), F.lit("html").alias("language"),
        F.col("html").alias("text"))
    talks = texts(spark, sf, "conversations", "conv_id", "turn", "text").select(
        F.lit("conversations").alias("source"), F.concat_ws("/", "conv_id", "turn").alias("file_path"),
        F.lit("chat").alias("language"), "text")
    return docs.unionByName(pages).unionByName(talks)


def all_rules(spark: SparkSession) -> DataFrame:
    return R.default_rules(spark).unionByName(R.fix_rules(spark)).unionByName(
        spark.createDataFrame(EXTRA_RULES, R.RULE_SCHEMA))


def _groups_sql(fix: str | None, pattern: str, group: int) -> str:
    """What a group of every match holds, for fixes that name it."""
    named = f"${group}" in (fix or "")
    return f"regexp_extract_all(line_text, {quoted(pattern)}, {group})" if named else "CAST(NULL AS VARCHAR[])"


def _hits_sql() -> str:
    """Every rule against every line, one branch per rule so that its pattern is a constant."""
    rows = [(i, p, s, c, langs, impact, None, 1.0, False, d, None) for i, _, d, p, s, c, langs, impact in R.PATTERN_RULES]
    rows += [(i, p, "Warning", "fix", ["*"], impact, fix, conf, every, d, R.REPLACES.get(i)) for i, p, every, d, fix, conf, impact in R.FIX_RULES]
    rows += [(i, p, s, c, langs, impact, fix, conf, every, d, old)
             for i, _, d, p, s, c, on, langs, impact, fix, conf, every, _, old in EXTRA_RULES if on]
    branches = []
    for i, p, s, c, langs, impact, fix, conf, every, d, old in rows:
        spoken = "" if "*" in langs else f" AND language IN ({', '.join(quoted(x) for x in langs)})"
        branches.append(
            f"SELECT *, {quoted(i)} AS rule_name, {quoted(s)} AS severity, {quoted(c)} AS category, {impact} AS impact_score, "
            f"{quoted(fix)}::VARCHAR AS fix_text, {quoted(old)}::VARCHAR AS replaces, {conf} AS confidence, {str(every).lower()} AS every_match, {quoted(d)} AS message, "
            f"regexp_extract_all(line_text, {quoted(p)}) AS found, string_split_regex(line_text, {quoted(p)}) AS gaps, "
            f"{_groups_sql(fix, p, 1)} AS first_group, {_groups_sql(fix, p, 2)} AS second_group "
            f"FROM lines WHERE regexp_matches(line_text, {quoted(p)}){spoken}"
        )
    return " UNION ALL ".join(branches)


CORPUS_SQL = """
    SELECT 'documents' AS source, doc_id::VARCHAR AS file_path, lang AS language, text FROM documents
    UNION ALL SELECT 'pages', page_id::VARCHAR, 'html', html FROM pages
    UNION ALL SELECT 'conversations', conv_id || '/' || turn, 'chat', text FROM conversations
"""

# Rules x lines; a match starts after all earlier matches and gaps.
FINDINGS_SQL = f"""
WITH corpus AS ({CORPUS_SQL}),
lines AS ({_lines_sql("corpus", "source, file_path, language", "text")}),
hits AS ({_hits_sql()}),
numbered AS (SELECT *, unnest(generate_series(1, CASE WHEN every_match THEN len(found) ELSE 1 END)) AS k FROM hits),
findings AS (
    SELECT source, file_path, language, line, found[k] AS matched, rule_name, severity, category, message,
           replace(replace(fix_text, '$2', coalesce(second_group[k], '')), '$1', coalesce(first_group[k], '')) AS suggested_fix,
           coalesce(replaces, found[k]) AS original_text,
           confidence::DOUBLE AS confidence, impact_score,
           (1 + list_sum(list_transform(gaps[1:k], lambda g: length(g)))
              + coalesce(list_sum(list_transform(found[1:k-1], lambda m: length(m))), 0))::INT AS "column"
    FROM numbered)
"""


@query("scan_rules", FINDINGS_SQL + """
SELECT source, file_path, line, "column", "column" + length(matched)::INT AS end_column, rule_name, matched, severity,
       category, suggested_fix, original_text, confidence, impact_score FROM findings""")
def scan_rules(spark, sf):
    found = R.scan_texts(corpus_texts(spark, sf), all_rules(spark), "language")
    return found.select("source", "file_path", "line", "column", "end_column", "rule_name", "matched", "severity",
                        "category", "suggested_fix", "original_text", "confidence", "impact_score")


@query("scan_rules_indexed", FINDINGS_SQL + """
SELECT source, file_path, line, "column", "column" + length(matched)::INT AS end_column, rule_name, matched, severity,
       category, suggested_fix, original_text, confidence, impact_score FROM findings""")
def scan_rules_indexed(spark, sf):
    """The same findings through an index of the rules' literals."""
    found = R.scan_texts_indexed(corpus_texts(spark, sf), all_rules(spark), "language")
    return found.select("source", "file_path", "line", "column", "end_column", "rule_name", "matched", "severity",
                        "category", "suggested_fix", "original_text", "confidence", "impact_score")


@query("scan_many_rules", """
WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS word FROM benchmark),
docs AS (SELECT doc_id, unnest(string_split_regex(CASE WHEN text LIKE '%' || chr(10) THEN left(text, -1) ELSE text END, '\r?\n')) AS line_text,
                generate_subscripts(string_split_regex(CASE WHEN text LIKE '%' || chr(10) THEN left(text, -1) ELSE text END, '\r?\n'), 1) AS line
         FROM documents WHERE text <> ''),
runs AS (SELECT DISTINCT doc_id, line, line_text, unnest(regexp_extract_all(line_text, '[A-Za-z]{8,}')) AS run FROM docs),
hits AS (SELECT DISTINCT doc_id, line, line_text, word FROM (SELECT DISTINCT run FROM runs) r JOIN words ON contains(r.run, word) JOIN runs USING (run))
SELECT doc_id, line::INTEGER AS line, word AS rule_name, strpos(line_text, word)::INTEGER AS "column" FROM hits""")
def scan_many_rules(spark, sf):
    """A rule for each long word of the benchmark, on whole documents."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), 0)).alias("word")).distinct()
    nothing = {n: F.lit(None).cast(t.dataType).alias(n) for n, t in ((f.name, f) for f in R.default_rules(spark).schema)}
    given = nothing | {
        "id": F.col("word").alias("id"), "pattern": F.col("word").alias("pattern"), "enabled": F.lit(True).alias("enabled"),
        "languages": F.array(F.lit("*")).alias("languages"), "all_matches": F.lit(False).alias("all_matches")}
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return R.scan_texts_indexed(docs, words.select(*given.values())).select("doc_id", "line", "rule_name", "column")


@query("scan_lines", FINDINGS_SQL + "SELECT source, file_path, line, rule_name, matched, suggested_fix FROM findings")
def scan_lines(spark, sf):
    """The same rules on lines that were cut before."""
    found = R.scan_rules(X.explode_lines(corpus_texts(spark, sf), "text"), all_rules(spark), "language")
    return found.select("source", "file_path", "line", "rule_name", "matched", "suggested_fix")


@query("fix_texts", FINDINGS_SQL.replace("WITH corpus", "WITH RECURSIVE corpus", 1) + """
, fixes AS (SELECT DISTINCT source, file_path, line, original_text, suggested_fix FROM findings WHERE suggested_fix IS NOT NULL),
numbered_fixes AS (
    SELECT *, row_number() OVER (PARTITION BY source, file_path ORDER BY line DESC, original_text, suggested_fix) AS nth FROM fixes),
patched AS (
    SELECT source, file_path, text, 0::BIGINT AS nth FROM corpus SEMI JOIN fixes USING (source, file_path)
    UNION ALL
    SELECT p.source, p.file_path, replace(p.text, f.original_text, f.suggested_fix), f.nth
    FROM patched p JOIN numbered_fixes f ON f.source = p.source AND f.file_path = p.file_path AND f.nth = p.nth + 1)
SELECT source, file_path, arg_max(md5(text), nth) AS fixed_md5 FROM patched GROUP BY source, file_path""")
def fix_texts(spark, sf):
    """From texts to findings to fixed texts."""
    texts = corpus_texts(spark, sf).withColumn("file", F.struct("source", "file_path"))
    found = R.scan_texts(texts, all_rules(spark), "language").filter("fix_available")
    fixes = found.select("file", "line", F.col("original_text").alias("original"), F.col("suggested_fix").alias("fixed"))
    fixed = N.apply_replacements(texts.join(fixes.select("file").distinct(), "file", "left_semi"), fixes, "file", "text")
    return fixed.select("source", "file_path", F.md5(F.col("text").cast("binary")).alias("fixed_md5"))


@query("lint_by_source", FINDINGS_SQL + """
, smells AS (
    SELECT source, file_path FROM lines WHERE strlen(line_text) > 120
    UNION ALL
    SELECT source, file_path FROM lines WHERE length(line_text) - length(replace(line_text, ';', '')) > 3)
SELECT source, count(*) AS findings, count(DISTINCT file_path) AS files_processed,
       count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings
FROM (SELECT source, file_path, severity FROM findings UNION ALL SELECT source, file_path, 'Warning' FROM smells)
GROUP BY source""")
def lint_by_source(spark, sf):
    """Flagship: lines, rules and line heuristics to metrics per source."""
    return N.lint_metrics(R.scan_texts(corpus_texts(spark, sf), all_rules(spark), "language", smells=True), ["source"])


@query("explode_lines", _lines_sql("documents", "doc_id", "text"))
def explode_lines(spark, sf):
    return X.explode_lines(texts(spark, sf, "documents", "doc_id", "text"), "text")


@query("line_smells", f"""
WITH lines AS ({_lines_sql(f"({CORPUS_SQL})", "source, file_path", "text")})
SELECT source, file_path, line, 'long-line' AS rule_name, 1.0::DOUBLE AS confidence FROM lines WHERE strlen(line_text) > 120
UNION ALL
SELECT source, file_path, line, 'multiple-statements', 0.8::DOUBLE FROM lines
WHERE length(line_text) - length(replace(line_text, ';', '')) > 3""")
def line_smells(spark, sf):
    smells = X.line_smells(X.explode_lines(corpus_texts(spark, sf), "text"))
    return smells.select("source", "file_path", "line", "rule_name", "confidence")


@query("filter_by_globs", """
SELECT page_id, url FROM pages
WHERE (url LIKE 'http%://%.example.com/%' OR url LIKE '%.html') AND NOT (url LIKE '%/de/%' OR url LIKE 'de/%')""")
def filter_by_globs(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return X.filter_by_globs(pages, "url", ["http*://*.example.com/**", "**/*.{html,htm}"], ["**/de/**"])


@query("size_guard", """
SELECT page_id, CASE WHEN strlen(html) // 1024 > 3
       THEN 'too large: ' || (strlen(html) // 1024) || ' KB > 3 KB' END AS reason FROM pages""")
def size_guard(spark, sf):
    kept, rejected = X.size_guard(table(spark, sf, "pages"), "html", max_kb=3)
    return kept.select("page_id", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select("page_id", "reason"))


@query("locate", """
WITH h AS (SELECT doc_id, left(text, (n_chars // 2)::BIGINT) AS head FROM documents)
SELECT doc_id, length(head) - length(replace(head, chr(10), '')) + 1 AS line,
       length(string_split(head, chr(10))[-1]) + 1 AS "column" FROM h""")
def locate(spark, sf):
    docs = table(spark, sf, "documents").withColumn("offset", F.expr("n_chars div 2"))
    return X.locate(docs, "text", "offset").select("doc_id", "line", "column")


_PROBES = """
    CASE WHEN has(t, '#!/usr/bin/env python') OR (has(t, 'import ') AND has(t, 'def ')) THEN 'python'
         WHEN has(t, '#!/bin/bash') OR has(t, '#!/bin/sh') THEN 'bash'
         WHEN has(t, 'use ') AND has(t, 'fn ') AND has(t, 'impl ') THEN 'rust'
         WHEN has(t, 'package ') AND has(t, 'func ') THEN 'go'
         WHEN has(t, 'class ') AND has(t, 'public ') THEN 'java'
         WHEN has(t, '#include') AND has(t, 'int main') THEN 'cpp'
         WHEN has(t, '<?php') OR (has(t, '$') AND has(t, 'function')) THEN 'php'
         WHEN has(t, 'interface ') OR has(t, 'type ') OR has(t, ': ') THEN 'typescript'
         WHEN has(t, 'function ') OR has(t, 'var ') OR has(t, 'const ') THEN 'javascript' END
""".replace("has(", "contains(")


@query("detect_language", f"""
SELECT source, file_path, coalesce({_PROBES}, 'prose') AS language
FROM (SELECT source, file_path, lower(text) AS t FROM ({CORPUS_SQL}))""")
def detect_language(spark, sf):
    texts = corpus_texts(spark, sf).drop("language")
    return X.detect_language(texts, None, "text", default="prose").select("source", "file_path", "language")


def _paths(spark, sf):
    """A path with an extension for every document."""
    docs = table(spark, sf, "documents")
    ext = F.when(F.col("lang") == "en", "ts").when(F.col("lang") == "fr", "mjs").when(F.col("lang") == "de", "JSX").otherwise("rs")
    return docs.withColumn("path", F.concat_ws("", F.col("source"), F.lit("/d"), F.col("doc_id"), F.lit("."), ext))


_PATHS_SQL = """(SELECT *, source || '/d' || doc_id || '.' ||
    CASE lang WHEN 'en' THEN 'ts' WHEN 'fr' THEN 'mjs' WHEN 'de' THEN 'JSX' ELSE 'rs' END AS path FROM documents)"""


@query("split_supported", f"""
SELECT doc_id, CASE lang WHEN 'en' THEN 'typescript' WHEN 'es' THEN 'unknown' ELSE 'javascript' END AS language,
       lang = 'es' AS skipped FROM {_PATHS_SQL}""")
def split_supported(spark, sf):
    kept, skipped = X.split_supported(_paths(spark, sf), "path")
    return kept.select("doc_id", "language", F.lit(False).alias("skipped")).unionByName(
        skipped.select("doc_id", "language", F.lit(True).alias("skipped")))


def _count_sql(text: str, needle: str) -> str:
    return f"(length({text}) - length(replace({text}, {quoted(needle)}, ''))) // {len(needle)}"


@query("nesting_score", f"""
SELECT source, file_path, score AS nesting_score, score > 15 AS too_nested
FROM (SELECT source, file_path, ({" + ".join(_count_sql("text", n) for n in X.NESTING_NEEDLES)})::BIGINT AS score
      FROM ({CORPUS_SQL}))""")
def nesting_score(spark, sf):
    return X.nesting_score(corpus_texts(spark, sf), "text").select("source", "file_path", "nesting_score", "too_nested")


@query("marker_count", f"""
SELECT doc_id, ({" + ".join(_count_sql("text", n) for n in ("TODO", "FIXME", "the ", "der "))})::BIGINT AS markers
FROM documents""")
def marker_count(spark, sf):
    return X.marker_count(texts(spark, sf, "documents", "doc_id", "text"), "text", ("TODO", "FIXME", "the ", "der ")).select("doc_id", "markers")


@query("paired_absence", """
SELECT page_id, 'unclosed-table' AS rule_name FROM pages WHERE contains(html, '<div') AND NOT contains(html, '<table')""")
def paired_absence(spark, sf):
    found = X.paired_absence(texts(spark, sf, "pages", "page_id", "html"), "html", "<div", "<table", "unclosed-table")
    return found.select("page_id", "rule_name")


@query("reuse_by_content", r"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+'))::BIGINT AS words,
       len(list_distinct(regexp_extract_all(text, '[A-Za-z]+')))::BIGINT AS distinct_words FROM documents""")
def reuse_by_content(spark, sf):
    def words(texts: DataFrame) -> DataFrame:
        found = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
        return texts.select("content_id", F.size(found).cast("long").alias("words"),
                            F.size(F.array_distinct(found)).cast("long").alias("distinct_words"))

    return X.reuse_by_content(texts(spark, sf, "documents", "doc_id", "text"), "text", words).select("doc_id", "words", "distinct_words")


_MIX = rf"""
SELECT source, file_path, language, text,
       regexp_extract_all(text, {quoted(M.DEFAULT_OPERATORS)}) AS o, regexp_extract_all(text, {quoted(M.DEFAULT_WORDS)}) AS w
FROM ({CORPUS_SQL})"""
_MEASURED = f"""
SELECT source, file_path, text, len(o) AS total_operators, len(w) AS total_operands,
       len(list_distinct(o)) AS n1, len(list_distinct(w)) AS n2,
       CASE WHEN n1 = 0 OR n2 = 0 THEN 0 ELSE (len(o) + len(w)) * log2(n1 + n2) END AS volume,
       CASE WHEN n1 = 0 OR n2 = 0 THEN 0 ELSE (n1 / 2.0) * (len(w) / n2) END AS difficulty
FROM ({_MIX})"""


@query("token_mix", f"""
SELECT source, file_path, total_operators::BIGINT AS total_operators, total_operands::BIGINT AS total_operands,
       n1::BIGINT AS distinct_operators, n2::BIGINT AS distinct_operands, (n1 + n2)::BIGINT AS vocabulary,
       (total_operators + total_operands)::BIGINT AS length, round(volume + 1e-9, 4) AS volume, round(difficulty + 1e-9, 4) AS difficulty,
       round(difficulty * volume + 1e-9, 2) AS effort
FROM ({_MEASURED})""")
def token_mix(spark, sf):
    return M.token_mix(corpus_texts(spark, sf), "text").select(
        "source", "file_path", "total_operators", "total_operands", "distinct_operators", "distinct_operands",
        "vocabulary", "length", *[F.round(F.col(c) + 1e-9, digits).alias(c) for c, digits in (("volume", 4), ("difficulty", 4), ("effort", 2))])


_CC = " + ".join(_count_sql("text", w) for w in ("if ", "for ", "while ", "case ", " && ", " || "))
_RAW = "171.0 - 5.2 * ln({0}) - 0.23 * cc - 16.2 * ln(loc)"


@query("maintainability", f"""
SELECT source, file_path, cc::BIGINT AS cyclomatic, loc::BIGINT AS loc,
       round(CASE WHEN loc = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, {_RAW.format("cc")})) END, 6) AS clamped,
       round(CASE WHEN volume = 0 THEN NULL ELSE {_RAW.format("volume")} END, 6) AS by_volume
FROM (SELECT source, file_path, volume, 1 + {_CC} AS cc,
             length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END AS loc
      FROM ({_MEASURED}))""")
def maintainability(spark, sf):
    measured = M.branch_count(M.token_mix(corpus_texts(spark, sf), "text"), "text").withColumn(
        "loc", line_count(F.col("text")))
    both = M.maintainability(
        M.maintainability(measured, "clamped").withColumnRenamed("maintainability", "clamped"), "volume")
    finite = F.when(F.col("volume") > 0, F.col("maintainability"))
    return both.select("source", "file_path", "cyclomatic", "loc", F.round("clamped", 6).alias("clamped"),
                       F.round(finite, 6).alias("by_volume"))


def _turn_pairs(spark, sf):
    """Consecutive turns of a conversation as versions of one text."""
    talks = table(spark, sf, "conversations")
    after = talks.select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return talks.select("conv_id", "turn", "text"), after


def _measures(df):
    def count(needle):
        return F.length("text") - F.length(F.replace("text", F.lit(needle), F.lit("")))

    return df.select("conv_id", "turn", count(" ").alias("cyclomatic"), count(",").alias("cognitive"), count(".").alias("nesting"))


_SCORES = """(SELECT conv_id, turn, length(text) - length(replace(text, ' ', '')) AS cc,
    length(text) - length(replace(text, ',', '')) AS cog, length(text) - length(replace(text, '.', '')) AS nest FROM conversations)"""


@query("improvement", f"""
SELECT b.conv_id, b.turn,
       round(coalesce((b.cc + b.cog + 2.0 * b.nest - a.cc - a.cog - 2.0 * a.nest) / nullif(b.cc + b.cog + 2.0 * b.nest, 0) * 100, 0), 6) AS by_score,
       round(greatest(0, coalesce((b.cc - a.cc) / nullif(b.cc, 0) * 100, 0)), 6) AS by_cc
FROM {_SCORES} b JOIN {_SCORES} a ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""")
def improvement(spark, sf):
    before, after = (_measures(side) for side in _turn_pairs(spark, sf))
    keys = ["conv_id", "turn"]
    by_score = M.improvement(before, after, keys, "score").select(*keys, F.round("improvement", 6).alias("by_score"))
    by_cc = M.improvement(before, after, keys, "cc").select(*keys, F.round("improvement", 6).alias("by_cc"))
    return by_score.join(by_cc, keys)


@query("line_diff", r"""
WITH v AS (SELECT conv_id, turn, string_split_regex(text, '\r?\n') AS l FROM conversations)
SELECT b.conv_id, b.turn,
       (len(list_filter(generate_series(1, least(len(b.l), len(a.l))), lambda i: b.l[i] <> a.l[i]))
        + abs(len(b.l) - len(a.l)))::BIGINT AS changed_lines
FROM v b JOIN v a ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""")
def line_diff(spark, sf):
    before, after = _turn_pairs(spark, sf)
    return M.line_diff(before, after, ["conv_id", "turn"], "text")


# Elements of a page as symbols, page comments as their annotation.
ELEMENTS = {"element": r"<(p|div|nav|table)([^>]*)>"}
PAGE_COMMENT = r"<!--[^>]*-->"
_SYMBOLS = r"""
SELECT page_id, regexp_extract(m, '<(p|div|nav|table)([^>]*)>', 1) AS name,
       regexp_extract(m, '<(p|div|nav|table)([^>]*)>', 2) AS params, starts_with(m, '<!--') AS documented, k
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:(?:<!--[^>]*-->)\s*)?<(?:p|div|nav|table)(?:[^>]*)>')) AS m,
             generate_subscripts(regexp_extract_all(html, '(?:(?:<!--[^>]*-->)\s*)?<(?:p|div|nav|table)(?:[^>]*)>'), 1) AS k FROM pages)"""


@query("annotation_symbols", f"SELECT page_id, name, params, documented FROM ({_SYMBOLS})")
def annotation_symbols(spark, sf):
    pages = texts(spark, sf, "pages", "page_id", "html")
    found = D.annotation_symbols(pages, "html", ELEMENTS, PAGE_COMMENT)
    return found.select("page_id", "name", "params", "documented")


@query("annotation_coverage", f"""
SELECT page_id, count(name) AS total_symbols, count(*) FILTER (documented) AS documented_symbols,
       round(coalesce(count(*) FILTER (documented) * 100.0 / nullif(count(name), 0), 100.0), 6)::DOUBLE AS coverage
FROM pages LEFT JOIN ({_SYMBOLS}) USING (page_id) GROUP BY page_id""")
def annotation_coverage(spark, sf):
    pages = texts(spark, sf, "pages", "page_id", "html")
    found = D.annotation_coverage(pages, "html", ELEMENTS, PAGE_COMMENT)
    return found.withColumn("coverage", F.round("coverage", 6))


@query("annotation_gaps", rf"""
WITH s AS ({_SYMBOLS}),
named AS (
    SELECT page_id, k, name, documented, list_distinct(list_filter(list_transform(list_filter(list_transform(
        string_split(params, ','), lambda p: trim(p)), lambda p: p <> ''),
        lambda p: trim(regexp_extract(p, '^([^:=]*)', 1))), lambda n: n <> '')) AS names FROM s)
SELECT page_id, name, 'missing-comment' AS gap, name AS detail FROM named WHERE NOT documented
UNION ALL
SELECT page_id, name, 'missing-param', unnest(names) FROM named WHERE documented""")
def annotation_gaps(spark, sf):
    pages = texts(spark, sf, "pages", "page_id", "html")
    gaps = D.annotation_gaps(D.annotation_symbols(pages, "html", ELEMENTS, PAGE_COMMENT))
    return gaps.select("page_id", "name", "gap", "detail")


@query("extract_code_blocks", r"""
SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+\z', '', 'g') AS code FROM conversations""")
def extract_code_blocks(spark, sf):
    """Assistant turns are wrapped in a fence with an info line, others stay plain."""
    talks = table(spark, sf, "conversations")
    fenced = F.concat(F.lit("Here:\n```text\n"), F.col("text"), F.lit("\n```\nDone."))
    answers = talks.withColumn("answer", F.when(F.col("role") == "assistant", fenced).otherwise(F.col("text")))
    return D.extract_code_blocks(answers, "answer").select("conv_id", "turn", "code")


@query("extract_json_edges", """
SELECT event_id, 'u' || user_id AS source, event_type AS target, 'did' AS type, value AS confidence
FROM events WHERE event_type NOT IN ('view', 'signup', 'click')""")
def extract_json_edges(spark, sf):
    """Views lack a field, clicks carry a number for a text, sign-ups are broken JSON."""
    kind = F.col("event_type")
    source = F.when(kind == "click", F.col("user_id").cast("string")).otherwise(
        F.concat(F.lit('"u'), F.col("user_id"), F.lit('"')))
    last = F.when(kind == "view", F.lit('"c":1')).otherwise(F.concat(F.lit('"confidence":'), F.col("value")))
    item = F.concat(F.lit('{"source":'), source, F.lit(',"target":"'), kind, F.lit('","type":"did",'), last, F.lit("}"))
    broken = F.when(kind == "signup", F.lit("{")).otherwise(F.lit(""))
    answers = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("see ["), item, F.lit(',{"source":"x"}'), broken, F.lit("] end")).alias("answer"))
    return D.extract_json_edges(answers, "answer")


# Assignments and links of this corpus, with one character around them in place of quotes.
SECRET_LITERAL = r".(?:password|secret|key|token)\s*[:=]\s*['\"][^'\"]+['\"]|[ >\"]http://[^ <>\"]+."
_LITERALS = f"""
SELECT source, file_path, q[2:-2] AS value, lower(q[2:-2]) AS low
FROM (SELECT source, file_path, unnest(regexp_extract_all(text, {quoted(SECRET_LITERAL)})) AS q FROM ({CORPUS_SQL}))"""


@query("secret_literals", f"""
SELECT source, file_path, value, 'hardcoded-credential' AS rule_name, 0.8::DOUBLE AS confidence FROM ({_LITERALS})
WHERE ({" OR ".join(f"contains(low, {quoted(w)})" for w in N.CREDENTIAL_WORDS)})
  AND strlen(value) > 8 AND NOT regexp_full_match(value, '\\p{{L}}*')
UNION ALL
SELECT source, file_path, value, 'insecure-url', 0.9::DOUBLE FROM ({_LITERALS}) WHERE starts_with(low, 'http://')""")
def secret_literals(spark, sf):
    found = N.secret_literals(corpus_texts(spark, sf), "text", SECRET_LITERAL)
    return found.select("source", "file_path", "value", "rule_name", "confidence")


@query("apply_replacements", """
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN text
                    ELSE replace(replace(text, ' the ', ' THE '), 'THE', 'the!') END AS text
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def apply_replacements(spark, sf):
    labelled = table(spark, sf, "labels").select("doc_id").distinct()
    fix = F.array(
        F.struct(F.lit(1).alias("line"), F.lit("THE").alias("original"), F.lit("the!").alias("fixed")),
        F.struct(F.lit(2).alias("line"), F.lit(" the ").alias("original"), F.lit(" THE ").alias("fixed")),
    )
    fixes = labelled.select("doc_id", F.explode(fix).alias("f")).select("doc_id", "f.*")
    docs = texts(spark, sf, "documents", "doc_id", "text")
    return N.apply_replacements(docs, fixes, "doc_id", "text")


@query("with_context", FINDINGS_SQL + """
, spots AS (SELECT DISTINCT source, file_path, line FROM findings
)
SELECT a.source, a.file_path, a.line,
       coalesce(string_agg(l.line_text, '|' ORDER BY l.line) FILTER (l.line < a.line), '') AS before_lines,
       max(l.line_text) FILTER (l.line = a.line) AS error_line,
       coalesce(string_agg(l.line_text, '|' ORDER BY l.line) FILTER (l.line > a.line), '') AS after_lines
FROM spots a JOIN lines l ON l.source = a.source AND l.file_path = a.file_path AND abs(l.line - a.line) <= 3
GROUP BY a.source, a.file_path, a.line""")
def with_context(spark, sf):
    """The lines around every finding, taken from the text's own row."""
    found = R.scan_texts(corpus_texts(spark, sf), all_rules(spark), "language", context=3)
    spots = found.select("source", "file_path", "line", F.array_join("before_lines", "|").alias("before_lines"), "error_line",
                         F.array_join("after_lines", "|").alias("after_lines"))
    return spots.distinct()


@query("with_context_joined", FINDINGS_SQL + """
SELECT a.source, a.file_path, a.line, count(l.line) AS lines, min(l.line) AS first_line, max(length(l.line_text)) AS longest
FROM (SELECT DISTINCT source, file_path, line FROM findings) a
JOIN lines l ON l.source = a.source AND l.file_path = a.file_path AND abs(l.line - a.line) <= 2 GROUP BY a.source, a.file_path, a.line""")
def with_context_joined(spark, sf):
    """The lines around findings that come from another table than the lines."""
    corpus = corpus_texts(spark, sf)
    found = R.scan_texts(corpus, all_rules(spark), "language")
    context = N.with_context(X.explode_lines(corpus, "text"), found, ["source", "file_path"], 2)
    whole = F.concat("before_lines", F.array("error_line"), "after_lines")
    return context.select(
        "source", "file_path", "line", F.size(whole).cast("long").alias("lines"), (F.col("line") - F.size("before_lines")).cast("long").alias("first_line"),
        F.array_max(F.transform(whole, lambda x: F.length(x))).cast("long").alias("longest"))


@query("pattern_contexts", FINDINGS_SQL + r"""
SELECT f.rule_name || '::' || regexp_replace(regexp_replace(regexp_replace(f.message, '''[^'']*''', '''<STRING>''', 'g'),
           '"[^"]*"', '"<STRING>"', 'g'), '\b\d+\b', '<NUMBER>', 'g') AS pattern_id,
       f.source || '/' || f.file_path AS file_path, f.line, f."column", md5(string_agg(l.line_text, chr(10) ORDER BY l.line)) AS context_md5
FROM findings f JOIN lines l ON l.source = f.source AND l.file_path = f.file_path AND abs(l.line - f.line) <= 1
GROUP BY f.rule_name, f.message, f.source, f.file_path, f.line, f."column"
""")
def pattern_contexts(spark, sf):
    """Each finding's line with its neighbours, under the pattern of its message."""
    corpus = corpus_texts(spark, sf).withColumn("file_path", F.concat_ws("/", "source", "file_path"))
    found = R.scan_texts(corpus, all_rules(spark), "language", context=1)
    context = F.array_join(F.concat("before_lines", F.array("error_line"), "after_lines"), "\n")
    contexts = found.select("file_path", "line", context.alias("context")).distinct()
    placed = N.pattern_contexts(found.select("file_path", "line", "column", "rule_name", "message"), contexts, keep=["column"])
    return placed.select("pattern_id", "file_path", "line", "column", F.md5(F.col("context").cast("binary")).alias("context_md5"))


TEMPLATES_SQL = """
SELECT page_id, 'com' AS template_id FROM pages WHERE url LIKE 'http%://%.example.com/%' AND NOT url LIKE '%#%'
UNION ALL SELECT page_id, 'french' FROM pages WHERE url LIKE '%/fr/%' OR url LIKE 'fr/%'
UNION ALL SELECT page_id, 'html' FROM pages WHERE url LIKE '%.html'"""


@query("match_templates", TEMPLATES_SQL)
def match_templates(spark, sf):
    return T.match_templates(table(spark, sf, "pages").select("page_id", "url"), _templates(spark), "url").select(
        "page_id", "template_id")


@query("match_templates_indexed", TEMPLATES_SQL)
def match_templates_indexed(spark, sf):
    """The same through an index of the globs."""
    found = T.match_templates_indexed(table(spark, sf, "pages").select("page_id", "url"), _templates(spark), "url")
    return found.select("page_id", "template_id")


def _templates(spark):
    return spark.createDataFrame(
        [("com", ["http*://*.example.com/**"], ["*#*"]), ("french", ["**/fr/**"], []), ("html", ["**/*.html"], [])],
        "template_id string, include array<string>, exclude array<string>")


@query("score_predictions", FINDINGS_SQL + """
, flagged AS (SELECT DISTINCT file_path FROM findings WHERE source = 'documents')
SELECT l.toxic, count(*) AS examples, round(avg(coalesce((l.quality = 0 AND f.file_path IS NOT NULL)::INT, 0)), 9) AS score
FROM labels l LEFT JOIN flagged f ON f.file_path = l.doc_id::VARCHAR GROUP BY l.toxic""")
def score_predictions(spark, sf):
    """Documents with findings are predicted to be of low quality; documents without have no prediction."""
    docs = texts(spark, sf, "documents", "doc_id", "lang", "text").withColumnRenamed("lang", "language")
    flagged = R.scan_texts(docs, all_rules(spark), "language").select(
        "doc_id", F.lit(0).alias("predicted")).distinct()
    scored = S.score_predictions(
        table(spark, sf, "labels"), flagged, ["doc_id"], F.col("predicted") == F.col("quality"), ["toxic"])
    return scored.withColumn("score", F.round("score", 9))


@query("custom_rules", r"""
SELECT doc_id, line, rule_name FROM (
    SELECT doc_id, line, line_text, unnest(['starts-upper-E', 'many-commas']) AS rule_name FROM (""" +
       _lines_sql("documents", "doc_id", "text") + r"""))
WHERE CASE rule_name WHEN 'starts-upper-E' THEN starts_with(line_text, 'E')
      ELSE length(line_text) - length(replace(line_text, ',', '')) > 10 END""")
def custom_rules(spark, sf):
    rules = R.register_rule({}, "starts-upper-E", lambda line: line.startswith("E"))
    R.register_rule(rules, "many-commas", lambda line: F.length(line) - F.length(F.replace(line, F.lit(","), F.lit(""))) > 10)
    lines = X.explode_lines(texts(spark, sf, "documents", "doc_id", "text"), "text")
    return R.scan_custom_rules(lines, rules)


@query("predict", """
SELECT doc_id, CASE WHEN n_chars <= 10000 THEN length(text)::BIGINT END AS prediction,
       CASE WHEN n_chars > 10000 THEN 'ValueError: too long' END AS error FROM documents""")
def predict(spark, sf):
    def lengths(rows):
        if (rows["n_chars"] > 10000).any():
            raise ValueError("too long")
        return [len(t) for t in rows["text"]]

    docs = texts(spark, sf, "documents", "doc_id", "n_chars", "text")
    return S.predict(docs, lengths, batch=32, result_type="long").select("doc_id", "prediction", "error")


@query("search_candidates", """
SELECT 'language' AS predictor, c.candidate,
       round(avg((contains(d.text, ' ' || c.candidate || ' ') = (d.lang = 'en'))::INT), 9) AS score
FROM documents d, (VALUES ('the'), ('of'), ('der'), ('que')) c(candidate) GROUP BY c.candidate
UNION ALL SELECT 'language', 'known', 0.25""")
def search_candidates(spark, sf):
    """Which word tells English best?"""
    words = spark.createDataFrame(
        [("language", w) for w in ("the", "of", "der", "que", "known")], "predictor string, candidate string")
    known = spark.createDataFrame([("language", "known", 0.25)], "predictor string, candidate string, score double")
    docs = texts(spark, sf, "documents", "lang", "text")
    found = S.search_candidates(
        words, docs,
        lambda word, rows: rows["text"].str.contains(f" {word} ", regex=False),
        lambda rows, answers: [float(a == (lang == "en")) for a, lang in zip(answers, rows["lang"])],
        known,
    )
    return found.withColumn("score", F.round("score", 9))
