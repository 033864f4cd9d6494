"""Rule tables: the shipped patterns, scanning lines with them, and rule settings."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findspan.functions.patterns import REGEX_ONLY_INSIDE, required_literals
from findspan.functions.text import match_columns, sql_text, text_lines
from findspan.operators.corpus import LINE_SMELLS
from findspan.session import cut_lineage, in_blocks, small_batches

RULE_SCHEMA = (
    "id string, name string, description string, pattern string, severity string, category string, "
    "enabled boolean, languages array<string>, impact_score int, fix_template string, "
    "confidence double, all_matches boolean, requires array<string>, replaces string"
)

MATCH_TYPE = "array<struct<column: int, matched: string, fix: string>>"

RULE_ATTRIBUTES = (
    "struct<rule_name: string, message: string, severity: string, category: string, "
    "suggested_fix: string, replaces: string, confidence: double, impact_score: int>"
)

# Rules that one pass over the texts handles; a longer table takes more passes.
RULES_PER_PASS = 400

_SCRIPT = ["typescript", "javascript"]

# Literals of which a text must contain one to match a rule: a substring test costs far less than
# the pattern and spares it on most lines.
REQUIRES = {
    "eval-usage": ["eval"],
    "console-log": ["console."],
    "hardcoded-secrets": ["password", "secret", "key", "token"],
    "nested-loops": ["for"],
    "sync-fs": ["fs."],
    "any-type": ["any"],
    "non-null-assertion": ["!"],
    "todo-markers": [":"],
    "replace-any": ["any"],
    "replace-any-parameter": ["any"],
    "cache-length-for": [".length"],
    "cache-length-while": [".length"],
    "cache-length-nested": [".length"],
    "remove-eval": ["eval"],
    "sanitize-inner-html": [".innerHTML"],
    "remove-document-write": ["document.write"],
    "sanitize-set-html": ["dangerouslySetInnerHTML"],
    "remove-timer-string": ["setTimeout", "setInterval"],
}

# Fixed value: what these two rules replace is less than what they match.
REPLACES = {"replace-any": "any", "replace-any-parameter": "any"}

# The eight shipped regex rules.
# id, name, description, pattern, severity, category, languages, impact score
PATTERN_RULES = [
    ("eval-usage", "Eval Usage", "Detects dangerous eval() usage",
     r"eval\s*\(", "Warning", "security", ["*"], 10),
    ("console-log", "Console Log", "Detects console.log statements",
     r"console\.(log|debug|info|warn|error)", "Warning", "security", ["*"], 3),
    ("hardcoded-secrets", "Hardcoded Secrets", "Detects potential hardcoded secrets",
     r"(password|secret|key|token)\s*[:=]\s*['\"][^'\"]+['\"]", "Warning", "security", ["*"], 9),
    ("nested-loops", "Nested Loops", "Detects potentially inefficient nested loops",
     r"for\s*\([^}]*\{\s*[^}]*for\s*\(", "Warning", "performance", _SCRIPT, 7),
    ("sync-fs", "Synchronous FS", "Detects synchronous filesystem operations",
     r"fs\.(readFileSync|writeFileSync|existsSync)", "Warning", "performance", _SCRIPT, 6),
    ("any-type", "Any Type Usage", "Detects usage of 'any' type",
     r":\s*any\b", "Info", "typescript", ["typescript"], 5),
    ("non-null-assertion", "Non-null Assertion", "Detects risky non-null assertions",
     r"!\s*[;\.,\)\]]", "Info", "typescript", ["typescript"], 6),
    ("todo-markers", "TODO/FIXME Markers", "Detects documentation markers indicating incomplete work",
     r"(?i)(TODO|FIXME|HACK|XXX|NOTE|BUG|DEPRECATED):", "Info", "documentation", ["*"], 2),
]

# Rules that propose a fix; ``$1`` stands for the pattern's first group.
# id, pattern, all matches on a line?, description, fix text, confidence, impact score
FIX_RULES = [
    ("replace-any", r":\s*any\b", True,
     "Replace 'any' type with more specific type annotation", "unknown", 0.8, 6),
    ("replace-any-parameter", r"\(\s*\w+\s*:\s*any\s*\)", True,
     "Replace parameter 'any' type with specific type", "unknown", 0.75, 7),
    ("cache-length-for", r"for\s*\(\s*\w+\s*=\s*\d+\s*;\s*\w+\s*<\s*(\w+)\.length\s*;\s*\w+\+\+\s*\)", False,
     "Cache array length in variable to avoid repeated property access",
     "const length = $1.length; for (let i = 0; i < length; i++)", 0.85, 6),
    ("cache-length-while", r"while\s*\(\s*\w+\s*<\s*(\w+)\.length\s*\)", False,
     "Cache array length to improve loop performance",
     "const length = $1.length; while (i < length)", 0.8, 5),
    ("cache-length-nested", r"for\s*\([^)]+\)\s*\{[^}]*for\s*\([^)]+\.length[^}]*\}", False,
     "Cache array length outside nested loops for better performance",
     "Cache length variables before nested loops", 0.75, 7),
    ("remove-eval", r"\beval\s*\(", False,
     "Replace eval() with safer alternatives - eval() poses security risks",
     "// SECURITY: eval() removed - use JSON.parse() or Function constructor", 0.95, 9),
    ("sanitize-inner-html", r"\.innerHTML\s*=", False,
     "Sanitize innerHTML assignments to prevent XSS vulnerabilities",
     ".textContent = // or use DOMPurify.sanitize()", 0.85, 8),
    ("remove-document-write", r"document\.write\s*\(", False,
     "Replace document.write() with safer DOM manipulation methods",
     "// Use createElement() and appendChild() instead", 0.9, 7),
    ("sanitize-set-html", r"dangerouslySetInnerHTML", False,
     "Sanitize content before using dangerouslySetInnerHTML to prevent XSS",
     "// Use DOMPurify.sanitize() before setting HTML", 0.8, 8),
    ("remove-timer-string", r"set(?:Timeout|Interval)\s*\(\s*[\"']", False,
     "Replace setTimeout/setInterval string with function to prevent code injection",
     "setTimeout(() => { /* code */ }, delay)", 0.9, 7),
]

# The canonical category names.
CATEGORIES = (
    "Security", "Performance", "Correctness", "Style", "Maintainability", "Testing",
    "Documentation", "Accessibility", "Complexity", "Observability", "Reliability",
)


def default_rules(spark: SparkSession) -> DataFrame:
    """The shipped regex rules as a table."""
    rows = [
        (i, n, d, p, s, c, True, langs, impact, None, 1.0, False, REQUIRES.get(i), None)
        for i, n, d, p, s, c, langs, impact in PATTERN_RULES
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def fix_rules(spark: SparkSession) -> DataFrame:
    """The rules that propose a replacement text."""
    rows = [
        (i, i, d, p, "Warning", "fix", True, ["*"], impact, fix, conf, every, REQUIRES.get(i), REPLACES.get(i))
        for i, p, every, d, fix, conf, impact in FIX_RULES
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _literal_tests(rule, text: str) -> list[str]:
    """Substring tests that any text or line with a match passes; the rule names the literals, or its pattern tells."""
    literals = rule.requires or required_literals(rule.pattern)
    return ["(" + " OR ".join(f"contains({text}, {sql_text(x)})" for x in literals) + ")"] if literals else []


def _language_test(rule, language: str | None) -> list[str]:
    if language is None or "*" in rule.languages:
        return []
    return [f"`{language}` IN ({', '.join(sql_text(x) for x in rule.languages)})"]


def _matches(rule, line: str) -> str:
    """Array of the matches of a rule that hits, the first or all, each with the text that fixes it.

    ``$1`` to ``$9`` in the fix stand for what the match's groups hold.
    """
    pattern = sql_text(rule.pattern)
    groups = [g for g in "987654321" if f"${g}" in (rule.fix_template or "")]
    fix = "CAST(NULL AS string)" if rule.fix_template is None else sql_text(rule.fix_template)
    if not rule.all_matches:
        for g in groups:
            fix = f"replace({fix}, '${g}', regexp_extract({line}, {pattern}, {g}))"
        return (f"array(named_struct('column', regexp_instr({line}, {pattern}), "
                f"'matched', regexp_extract({line}, {pattern}, 0), 'fix', {fix}))")
    if not groups:
        return f"transform({match_columns(line, pattern)}, m -> named_struct('column', m.column, 'matched', m.matched, 'fix', {fix}))"
    held = ", ".join(f"'g{g}', regexp_extract_all({line}, {pattern}, {g})" for g in groups)
    for g in groups:
        fix = f"replace({fix}, '${g}', get(t.held.g{g}, i))"
    both = f"array(named_struct('found', {match_columns(line, pattern)}, 'held', named_struct({held})))"
    return (f"get(transform({both}, t -> transform(t.found, (m, i) -> "
            f"named_struct('column', m.column, 'matched', m.matched, 'fix', {fix}))), 0)")


def _attributes(rows: list, smells: bool) -> list[dict]:
    found = [
        dict(rule_name=r.id, message=r.description, severity=r.severity, category=r.category,
             suggested_fix=r.fix_template, replaces=getattr(r, "replaces", None), confidence=r.confidence,
             impact_score=r.impact_score)
        for r in rows
    ]
    for name, _, confidence, fix in LINE_SMELLS if smells else ():
        found.append(dict(rule_name=name, message=fix, severity="Warning", category="style", suggested_fix=fix,
                          replaces=None, confidence=confidence, impact_score=None))
    return found


def _line_hits(rows: list, line: str, language: str | None, smells: bool, listed: str | None) -> tuple[str, str]:
    """SQL for: whether any rule hits a line, and the array of (rule number, matches) of those that do.

    ``listed`` is an array of the numbers of the rules that can hit at all.
    """
    hits, found = [], []
    for i, r in enumerate(rows):
        early = [f"array_contains({listed}, {i})"] if listed else _language_test(r, language)
        hits.append(" AND ".join([*early, *_literal_tests(r, line), f"{line} RLIKE {sql_text(r.pattern)}"]))
        found.append(_matches(r, line))
    for _, condition, _, fix in LINE_SMELLS if smells else ():
        hits.append(condition.format(line=line))
        found.append(f"array(named_struct('column', 1, 'matched', CAST(NULL AS string), 'fix', {sql_text(fix)}))")
    per_rule = ", ".join(
        f"CASE WHEN {h} THEN named_struct('rule', {i}, 'found', {m}) END" for i, (h, m) in enumerate(zip(hits, found))
    ) or f"CAST(NULL AS struct<rule: int, found: {MATCH_TYPE}>)"
    return " OR ".join(f"({h})" for h in hits) or "false", f"array_compact(array({per_rule}))"


def _findings(hits: DataFrame, kept: Sequence[str], rows: list, smells: bool) -> DataFrame:
    """One row per match from rows with ``__hit``; the rules' attributes are one literal, picked by number."""
    rule = F.get(F.from_json(F.lit(json.dumps(_attributes(rows, smells))), f"array<{RULE_ATTRIBUTES}>"), F.col("__hit.rule"))
    matched = F.col("__match.matched")
    return (
        hits.select(*kept, rule.alias("__rule"), F.explode("__hit.found").alias("__match"))
        .select(
            *kept,
            "__match.column",
            "__match.matched",
            *[f"__rule.{name}" for name in ("rule_name", "message", "severity", "category")],
            F.col("__match.fix").alias("suggested_fix"),
            F.coalesce("__rule.replaces", "__match.matched").alias("original_text"),
            "__rule.confidence",
            "__rule.impact_score",
            (F.col("__match.column") + F.length(matched)).alias("end_column"),
            F.col("__match.fix").isNotNull().alias("fix_available"),
        )
    )


def _every_pass(rules: DataFrame, smells: bool, scan: Callable[[list, bool], DataFrame]) -> DataFrame:
    """Union of the passes over the blocks of the rule table; the heuristics belong to the first."""
    found = None
    for number, rows in enumerate(in_blocks(rules.filter("enabled"), "id", RULES_PER_PASS)):
        part = scan(sorted(rows, key=lambda r: r.id), smells and number == 0)
        found = part if found is None else found.unionByName(part)
    return found


def scan_rules(
    lines: DataFrame,
    rules: DataFrame,
    language: str | None = None,
    text: str = "line_text",
    smells: bool = False,
) -> DataFrame:
    """Findings of every enabled rule on every line, with ``smells`` also those of the line heuristics.

    Rules are read in blocks and each pattern becomes a literal, so Spark compiles it once per task
    and needs neither a join nor a shuffle; a block is one pass over the lines, so the table of
    rules may have any length. A line that no rule hits is dropped by one filter. A rule applies when its languages
    contain the row's language or ``*``; without a ``language`` column all rules apply. Literals
    that a match must contain are looked for before the pattern. A finding's ``original_text`` is
    what its ``suggested_fix`` stands in for. For whole texts :func:`scan_texts` is faster.
    """
    kept = [c for c in lines.columns if c != text]

    def scan(rows: list, with_smells: bool) -> DataFrame:
        # SQL text rather than Column calls: a table of rules is a large expression to hand over.
        any_hit, hits = _line_hits(rows, f"`{text}`", language, with_smells, None)
        hit_lines = lines.filter(any_hit).select(*kept, F.expr(f"explode({hits})").alias("__hit"))
        return _findings(hit_lines, kept, rows, with_smells)

    return _every_pass(rules, smells, scan)


def scan_texts(
    texts: DataFrame,
    rules: DataFrame,
    language: str | None = None,
    text: str = "text",
    smells: bool = False,
    context: int | None = None,
) -> DataFrame:
    """Findings of :func:`scan_rules` on whole texts, each with its ``line``.

    Each text is first tested as a whole: the rules that can hit one of its lines become a short
    list of numbers, and texts without any are not cut into lines (but for ``smells``). Only the
    listed rules then run on the lines. With ``context`` a finding carries ``before_lines``, ``error_line`` and ``after_lines``,
    up to so many lines around it, from the same row.
    """
    kept = [c for c in texts.columns if c != text]

    def scan(rows: list, with_smells: bool) -> DataFrame:
        tests = []
        for i, r in enumerate(rows):
            whole = [f"`{text}` RLIKE {sql_text(r.pattern)}"] if not REGEX_ONLY_INSIDE.search(r.pattern) else []
            test = " AND ".join([*_language_test(r, language), *_literal_tests(r, f"`{text}`"), *whole]) or "true"
            tests.append(f"CASE WHEN {test} THEN {i} END")
        listed = f"array_compact(array({', '.join(tests)}))" if tests else "CAST(array() AS array<int>)"
        marked = texts.select("*", F.expr(listed).alias("__listed"))
        if not with_smells:
            marked = marked.filter(F.size("__listed") > 0)
        lines = text_lines(F.col(text))
        if context is None:
            cut = marked.select(*kept, "__listed", F.posexplode(lines).alias("__at", "__line"))
            any_hit, hits = _line_hits(rows, "`__line`", language, with_smells, "__listed")
            cut = cut.filter(any_hit).select(
                *kept, (F.col("__at") + 1).alias("line"), F.expr(f"explode({hits})").alias("__hit"))
            return _findings(cut, [*kept, "line"], rows, with_smells)
        _, hits = _line_hits(rows, "l", language, with_smells, "__listed")
        at_lines = f"filter(transform(__lines, (l, i) -> named_struct('at', i + 1, 'hits', {hits})), x -> size(x.hits) > 0)"
        near = marked.select(*kept, "__listed", lines.alias("__lines")).select(
            *kept, "__lines", F.expr(f"explode({at_lines})").alias("__spot"))
        at = F.col("__spot.at")
        first = F.greatest(at - context, F.lit(1))
        around = near.select(
            *kept, at.alias("line"),
            F.slice("__lines", first, at - first).alias("before_lines"),
            F.get("__lines", at - 1).alias("error_line"),
            F.slice("__lines", at + 1, F.lit(context)).alias("after_lines"),
            F.explode("__spot.hits").alias("__hit"))
        return _findings(around, [*kept, "line", "before_lines", "error_line", "after_lines"], rows, with_smells)

    return _every_pass(rules, smells, scan)


#: Letters of a gram of the literal index, and texts that tell which grams are rare. The number changes the speed, never the result.
GRAM = 4
SAMPLE_TEXTS = 2000


def _grams(text: str) -> str:
    """SQL for the distinct grams of a text, all overlapping ones."""
    return f"array_distinct(regexp_extract_all({text}, '(?s)(?=({'.' * GRAM}))', 1))"


#: Bits of a key of the filter that tells grams which no rule has, and bytes of texts that are looked at together.
KEY_BITS = 24
STRETCH = 1 << 20


def _gram_filter(index: DataFrame) -> np.ndarray:
    """A bit for each key of a gram's first four bytes, packed: two megabytes for an index of any length."""
    head = "CAST(conv(hex(substring(CAST(gram AS binary), 1, 4)), 16, 10) AS long)"
    keys = index.selectExpr(f"shiftright({head} * 1640531527L & 4294967295L, {32 - KEY_BITS}) AS key")
    words = keys.groupBy(F.expr("shiftright(key, 5)").alias("word"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, CAST(key & 31 AS int)))").alias("bits")).collect()
    packed = np.zeros(1 << (KEY_BITS - 5), dtype="<u4")
    for r in found:
        packed[r.word] = r.bits
    return packed.view(np.uint8)


def _known_grams(texts: pa.Array, bits: np.ndarray) -> pa.Array:
    """For each text its distinct grams whose key is in the filter; those of the rules are all among them."""
    texts = texts.cast(pa.large_binary())
    found: list[set[str]] = [set() for _ in range(len(texts))]
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends[1:] - ends[0]
    for start in range(0, max(0, len(whole) - 3), STRETCH):
        part = whole[start : start + STRETCH + 3].astype(np.uint32)
        head = (part[:-3] << np.uint32(24)) | (part[1:-2] << np.uint32(16)) | (part[2:-1] << np.uint32(8)) | part[3:]
        key = (head * np.uint32(1640531527)) >> np.uint32(32 - KEY_BITS)
        places = np.flatnonzero((bits[key >> np.uint32(3)] >> (key & np.uint32(7)).astype(np.uint8)) & np.uint8(1)) + start
        for place, row in zip(places.tolist(), np.searchsorted(ends, places, side="right").tolist()):
            gram = whole[place : min(place + 4 * GRAM, ends[row])].tobytes().decode("utf-8", "ignore")[:GRAM]
            if len(gram) == GRAM:
                found[row].add(gram)
    return pa.array([list(f) for f in found], pa.list_(pa.string()))


def rule_index(rules: DataFrame, texts: DataFrame | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The enabled rules by a gram of each of their literals, and the rules that can't be found that way.

    A match contains one of the rule's literals (its ``requires``, or what its pattern shows); a text without the
    gram of any of them can't match. Of a literal's grams the one is taken that is rarest in a sample of ``texts``. Rules without literals, or
    with one shorter than a gram, are returned as they are. The index is a table (``gram``, ``literal``, ``literals``, rule) of any length.
    """
    spark, schema = rules.sparkSession, rules.schema
    literals = F.udf(lambda p: required_literals(p), "array<string>")  # once per rule
    named = F.when(F.size("requires") > 0, F.col("requires")).otherwise(literals("pattern"))
    told = rules.filter("enabled").withColumn("literals", named)
    long = F.forall("literals", lambda x: F.char_length(x) >= GRAM) & (F.size("literals") > 0)
    # Anchors see the ends of lines; the lines themselves are tested later, so only the literals count here.
    told = cut_lineage(told.withColumn("found", F.coalesce(long, F.lit(False))))
    plain = told.filter("NOT found").select(*schema.names)
    grams = (
        told.filter("found").select(F.struct(*schema.names).alias("rule"), "literals", F.explode("literals").alias("literal"))
        .select("*", F.explode(F.expr(f"transform(sequence(1, char_length(literal) - {GRAM - 1}), i -> substring(literal, i, {GRAM}))")).alias("gram"))
    )
    counts = spark.createDataFrame([], "gram string, texts long")
    if texts is not None:
        counts = texts.select(F.col(text).alias("text")).limit(SAMPLE_TEXTS).select(F.expr(f"explode({_grams('text')})").alias("gram"))
        counts = counts.groupBy("gram").agg(F.count("*").alias("texts"))
    rated = grams.join(counts, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = rated.groupBy("rule", "literals", "literal").agg(F.min(F.struct("texts", "gram")).alias("best"))
    return cut_lineage(rarest.select(F.col("best.gram").alias("gram"), "literal", "literals", "rule")), plain


def _matches_of_column(line: str, pattern: str, fix: str) -> tuple[str, str]:
    """SQL for the first match, and for all, with patterns and fixes that are columns; ``$1`` to ``$9`` as in :func:`_matches`."""
    first = fix
    for g in "987654321":
        # What was built so far is named once a level, or the expression would double with each.
        first = f"replace({first}, '${g}', CASE WHEN contains({fix}, '${g}') THEN regexp_extract({line}, {pattern}, {g}) ELSE '${g}' END)"
    one = (f"array(named_struct('column', regexp_instr({line}, {pattern}), 'matched', regexp_extract({line}, {pattern}, 0), 'fix', {first}))")
    every = "t.fix"
    for g in "987654321":
        every = f"replace({every}, '${g}', CASE WHEN contains(t.fix, '${g}') THEN get(regexp_extract_all(t.line, t.pattern, {g}), i) ELSE '${g}' END)"
    given = f"array(named_struct('found', {match_columns(line, pattern)}, 'line', {line}, 'pattern', {pattern}, 'fix', {fix}))"
    many = f"get(transform({given}, t -> transform(t.found, (m, i) -> named_struct('column', m.column, 'matched', m.matched, 'fix', {every}))), 0)"
    return one, many


def scan_texts_indexed(
    texts: DataFrame, rules: DataFrame, language: str | None = None, text: str = "text", sample: DataFrame | None = None,
) -> DataFrame:
    """Findings of :func:`scan_texts` with rules of any number, through an index of their literals.

    The grams of a text that may be a rule's (a filter of fixed size tells) meet the rules' grams in a join, and only rules whose
    literal the text contains are run on its lines. So the cost follows the texts and the rules that may hit, not their product. Spark
    broadcasts the index while it is small. Rules that show no literal are scanned as :func:`scan_texts` does.
    A text that holds literals of very many rules is one row per rule there.
    """
    index, plain = rule_index(rules, texts if sample is None else sample, text)
    kept = [c for c in texts.columns if c != text]
    small_batches(texts.sparkSession)
    bits = texts.sparkSession.sparkContext.broadcast(_gram_filter(index))

    @F.arrow_udf("array<string>")
    def known(column: pa.Array) -> pa.Array:
        return _known_grams(column, bits.value)

    rows = texts.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), F.col(text).alias("__text"))
    rows = rows.withColumn("__grams", known("__text")).filter(F.size("__grams") > 0)
    met = rows.select("__row", "__text", F.explode("__grams").alias("__gram")).join(index.withColumnRenamed("gram", "__gram"), "__gram")
    # A rule with several literals is found by the first that the text contains.
    met = met.filter(F.expr("get(filter(literals, x -> contains(__text, x)), 0) = literal"))
    if language is not None:
        spoken = F.array_contains("rule.languages", "*") | F.array_contains("rule.languages", F.col(f"__row.`{language}`"))
        met = met.filter(spoken)
    cut = met.select("__row", "literals", "rule", F.posexplode(text_lines(F.col("__text"))).alias("__at", "__line"))
    cut = cut.filter(F.expr("exists(literals, x -> contains(__line, x)) AND __line RLIKE rule.pattern"))
    one, many = _matches_of_column("__line", "rule.pattern", "rule.fix_template")
    found = cut.select(
        "__row.*", (F.col("__at") + 1).alias("line"), "rule",
        F.expr(f"explode(CASE WHEN rule.all_matches THEN {many} ELSE {one} END)").alias("__match"))
    matched = F.col("__match.matched")
    indexed = found.select(
        *kept, "line", "__match.column", "__match.matched", F.col("rule.id").alias("rule_name"), F.col("rule.description").alias("message"),
        "rule.severity", "rule.category", F.col("__match.fix").alias("suggested_fix"),
        F.coalesce("rule.replaces", "__match.matched").alias("original_text"), "rule.confidence", "rule.impact_score",
        (F.col("__match.column") + F.length(matched)).alias("end_column"), F.col("__match.fix").isNotNull().alias("fix_available"))
    return indexed.unionByName(scan_texts(texts, plain, language, text))


def custom_rule(
    lines: DataFrame, rule_name: str, condition: Callable[[Column], Column], text: str = "line_text",
    message: str | None = None, severity: str = "Warning",
) -> DataFrame:
    """A user rule: a boolean expression over the line (a pandas UDF column works as well)."""
    kept = [c for c in lines.columns if c != text]
    return lines.filter(condition(F.col(text))).select(
        *kept,
        F.lit(1).alias("column"),
        F.lit(rule_name).alias("rule_name"),
        F.lit(message or rule_name).alias("message"),
        F.lit(severity).alias("severity"),
    )


def register_rule(
    registry: dict[str, Callable[[Column], Column]], rule_id: str, condition: Callable[[Column], Column]
) -> dict[str, Callable[[Column], Column]]:
    """Add a user rule to a registry (a plain dict that the caller keeps); a later one of the same id wins."""
    registry[rule_id] = condition
    return registry


def scan_custom_rules(
    lines: DataFrame, registry: dict[str, Callable[[Column], Column]], rule_ids: Sequence[str] | None = None,
    text: str = "line_text",
) -> DataFrame:
    """Findings of the registered user rules, evaluated in one pass over the lines."""
    wanted = list(registry) if rule_ids is None else list(rule_ids)
    kept = [c for c in lines.columns if c != text]
    hits = F.array_compact(F.array(*[F.when(registry[r](F.col(text)), F.lit(r)) for r in wanted]))
    return lines.select(*kept, F.explode(hits).alias("rule_name"))


def enrich(findings: DataFrame, rules: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Attach rule attributes; findings of unknown rules stay with nulls.

    No broadcast hint: Spark broadcasts the rules while they are below its size threshold and
    otherwise splits the skewed rules of a sort-merge join.
    """
    side = rules.select(F.col("id").alias("rule_name"), *attributes)
    return findings.join(side, "rule_name", "left")


def only_listed(findings: DataFrame, listed: DataFrame, column: str = "rule_name") -> DataFrame:
    """Findings whose rule is in the list."""
    return findings.join(listed.select(column).distinct(), column, "left_semi")


def not_yet_known(candidates: DataFrame, known: DataFrame, column: str = "rule_id") -> DataFrame:
    """Candidates without an existing rule."""
    return candidates.join(known.select(column), column, "left_anti")


def severity_label(raw: Column, default: str = "Warning") -> Column:
    low = F.lower(raw)
    return (
        F.when(low.isin("error", "2"), "Error")
        .when(low.isin("warn", "warning", "1"), "Warning")
        .when(low == "info", "Info")
        .when(low == "hint", "Hint")
        .otherwise(default)
    )


def category_label(raw: Column) -> Column:
    label = F.lower(raw)
    for name in CATEGORIES:
        label = F.when(F.lower(raw) == name.lower(), name).otherwise(label)
    return label


def normalize_labels(
    df: DataFrame, severity: str = "severity", category: str = "category", default_severity: str = "Warning"
) -> DataFrame:
    """Severity synonyms to one spelling, category names to theirs; unknown categories stay in lower case."""
    return df.withColumns(
        {severity: severity_label(F.col(severity), default_severity), category: category_label(F.col(category))}
    )


def filter_rules(
    rules: DataFrame,
    category: str | None = None,
    tags: Sequence[str] | None = None,
    max_cost: int | None = None,
    ai_enhanced: bool | None = None,
    autofix: bool | None = None,
) -> DataFrame:
    """Rules that pass all given filters, cheapest first."""
    kept = rules
    if category is not None:
        kept = kept.filter(F.col("category") == category)
    if tags is not None:
        kept = kept.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if max_cost is not None:
        kept = kept.filter(F.col("cost") <= max_cost)
    if ai_enhanced is not None:
        kept = kept.filter(F.col("ai_enhanced") == ai_enhanced)
    if autofix is not None:
        kept = kept.filter(F.col("autofix") == autofix)
    return kept.orderBy("cost", "id")


def rule_stats(rules: DataFrame) -> DataFrame:
    """Totals by kind and category plus the model-assisted and automatically fixable rules."""
    return rules.groupBy("kind", "category").agg(
        F.count("*").alias("rules"),
        F.count_if("ai_enhanced").alias("ai_enhanced_rules"),
        F.count_if("autofix").alias("autofix_rules"),
    )


def enabled_rules(
    rules: DataFrame, categories: DataFrame | None = None, individual: DataFrame | None = None
) -> DataFrame:
    """Rules that are switched on: a rule's own switch, else its category's, else on."""
    switched = rules
    switch = []
    if individual is not None:
        own = individual.select(F.col("rule").alias("id"), F.col("on").alias("__rule_on"))
        switched = switched.join(own, "id", "left")
        switch.append(F.col("__rule_on"))
    if categories is not None:
        by_category = categories.select(
            F.lower("category").alias("__category"), F.col("on").alias("__category_on"))
        switched = switched.join(by_category, F.lower(switched["category"]) == F.col("__category"), "left")
        switch.append(F.col("__category_on"))
    return switched.filter(F.coalesce(*switch, F.lit(True))).select(*rules.columns)
