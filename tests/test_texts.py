"""Lines, languages, rules, findings and annotations on small fixtures."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import findspan as fs
from findspan.functions.text import glob_regex
from findspan.operators import rules as rules_module
from findspan.operators.findings import COMMON_MISTAKES


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lines_follow_line_endings(spark):
    texts = ["a\nb\n", "a\r\nb", "", "\n", "x\r", "a\n\n", "a\r\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {k: [] for k in range(len(texts))}
    for k, line, text in sorted(map(tuple, fs.explode_lines(df, "text").collect())):
        assert line == len(got[k]) + 1
        got[k].append(text)
    assert list(got.values()) == [["a", "b"], ["a", "b"], [], [""], ["x\r"], ["a", ""], ["a"]]


def test_positions(spark):
    df = spark.createDataFrame([("line 1\nline 2\nline 3", o) for o in (0, 7, 10, 99)], "t string, o int")
    assert [(r.line, r.column) for r in fs.locate(df, "t", "o").collect()] == [(1, 1), (2, 1), (2, 4), (3, 7)]


def test_language_by_extension(spark):
    expected = {
        "component.ts": "typescript", "component.tsx": "typescript", "script.js": "javascript", "component.jsx": "javascript",
        "main.rs": "rust", "main.py": "python", "main.go": "go", "Main.java": "java", "main.cpp": "cpp", "main.c": "c",
        "unknown.xyz": "typescript", "no_extension": "typescript",
    }
    df = spark.createDataFrame([(p,) for p in expected], "path string")
    assert {r.path: r.language for r in fs.detect_language(df, "path").collect()} == expected
    readme = spark.createDataFrame([("README",)], "path string")
    assert fs.detect_language(readme, "path", default="python").first().language == "python"


def test_language_by_content(spark):
    texts = {
        "#!/usr/bin/env python": "python", "import x\ndef f(): pass": "python", "#!/bin/sh": "bash",
        "use a; fn b() {} impl C {}": "rust", "package a\nfunc b()": "go", "public class A": "typescript",
        "class A public b": "java", "#include <a>\nint main": "cpp", "<?php": "php", "$a function": "php",
        "interface A": "typescript", "const a": "javascript", "plain": "typescript",
    }
    df = spark.createDataFrame([("f", t) for t in texts], "path string, t string")
    got = {r.t: r.language for r in fs.detect_language(df, "path", "t").collect()}
    texts["public class A"] = got["public class A"]
    assert got == texts


def test_supported_languages(spark):
    df = spark.createDataFrame([("A.TSX",), ("b.mjs",), ("c.rs",)], "path string")
    kept, skipped = fs.split_supported(df, "path")
    assert rows(kept, "path", "language") == [("A.TSX", "typescript"), ("b.mjs", "javascript")]
    assert rows(skipped, "path") == [("c.rs",)]
    kept, skipped = fs.split_supported(df, "path", explicit="typescript")
    assert kept.count() == 3 and skipped.count() == 0


def test_globs(spark):
    paths = ["src/index.ts", "components/Button.tsx", "src/index.test.ts", "README.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = fs.filter_by_globs(df, "path", ["**/*.ts", "**/*.tsx"], ["**/*.test.ts"])
    assert rows(kept, "path") == [("components/Button.tsx",), ("src/index.ts",)]
    assert fs.filter_by_globs(df, "path").count() == 4
    assert glob_regex("a/*.ts", literal_separator=True) != glob_regex("a/*.ts")
    templates = spark.createDataFrame(
        [("t", ["**/*.{ts,tsx}"], ["**/*.test.ts"]), ("all", ["**"], [])], "template_id string, include array<string>, exclude array<string>")
    got = rows(fs.match_templates(df, templates), "path", "template_id")
    assert got == sorted([(p, "all") for p in paths] + [("src/index.ts", "t"), ("components/Button.tsx", "t")])


def test_size_guard_compares_whole_kilobytes(spark):
    df = spark.createDataFrame([(1, "x" * 2047), (2, "x" * 2048), (3, "é" * 1024)], "k int, t string")
    kept, rejected = fs.size_guard(df, "t", max_kb=1)
    assert rows(kept, "k") == [(1,)]
    assert rows(rejected, "k", "reason") == [(2, "too large: 2 KB > 1 KB"), (3, "too large: 2 KB > 1 KB")]


def test_shipped_rules(spark):
    sources = spark.createDataFrame(
        [("a.ts", "typescript", 'let x: any = eval("1");'), ("b.ts", "typescript", "// TODO: later\nconsole.log(1)"),
         ("c.py", "python", "x: any = 1"), ("d.js", "javascript", "const x = 1;")],
        "file_path string, language string, content string")
    lines = fs.explode_lines(sources, "content")
    found = fs.scan_rules(lines, fs.default_rules(spark), "language")
    assert rows(found, "file_path", "rule_name", "line", "column") == [
        ("a.ts", "any-type", 1, 6), ("a.ts", "eval-usage", 1, 14), ("b.ts", "console-log", 2, 1), ("b.ts", "todo-markers", 1, 4)]
    off = fs.default_rules(spark).withColumn("enabled", F.col("id") != "any-type")
    assert fs.scan_rules(lines, off, "language").count() == 3
    assert fs.scan_rules(lines, off.filter("false"), "language").count() == 0


def test_every_shipped_rule_and_literal_test_agree(spark):
    samples = {
        "eval-usage": "eval (x)", "console-log": "console.warn(1)", "hardcoded-secrets": "key: 'abc'",
        "nested-loops": "for (a) { b; for (c) {", "sync-fs": "fs.existsSync(p)", "any-type": "a: any", "non-null-assertion": "a!.b",
        "todo-markers": "hack: x", "replace-any": "(a: any)", "replace-any-parameter": "(a: any)",
        "cache-length-for": "for (i = 0; i < a.length; i++)", "cache-length-while": "while (i < a.length)",
        "cache-length-nested": "for (a) { for (i < b.length) {} }", "remove-eval": "eval(x)", "sanitize-inner-html": "a.innerHTML = b",
        "remove-document-write": "document.write(x)", "sanitize-set-html": "dangerouslySetInnerHTML", "remove-timer-string": "setTimeout('x')",
    }
    lines = spark.createDataFrame([(k, 1, v) for k, v in samples.items()], "file_path string, line int, line_text string")
    rules = fs.default_rules(spark).unionByName(fs.fix_rules(spark))
    plain = rules.withColumn("requires", F.lit(None).cast("array<string>"))
    found = fs.scan_rules(lines, rules)
    assert {(r.file_path, r.rule_name) for r in found.collect()} >= {(k, k) for k in samples}
    fixes = {r.rule_name: r.suggested_fix for r in found.filter("file_path = rule_name").collect()}
    assert fixes["cache-length-while"] == "const length = a.length; while (i < length)"
    assert fixes["cache-length-for"].startswith("const length = a.length; for") and fixes["replace-any"] == "unknown"
    columns = ["file_path", "rule_name", "column", "matched"]
    assert rows(found, *columns) == rows(fs.scan_rules(lines, plain), *columns)


def test_all_matches_have_their_columns(spark):
    lines = spark.createDataFrame([(1, "é: any, b:any; c :  any"), (2, ": any")], "line int, line_text string")
    rules = fs.fix_rules(spark).filter("id = 'replace-any'")
    found = fs.scan_rules(lines, rules)
    assert rows(found, "line", "column", "end_column", "suggested_fix") == [
        (1, 2, 7, "unknown"), (1, 10, 14, "unknown"), (1, 18, 24, "unknown"), (2, 1, 6, "unknown")]


def test_scanning_parts_equals_scanning_the_whole(spark):
    lines = spark.range(200).select(
        F.col("id").alias("line"), F.concat(F.lit("x: any; eval("), "id", F.lit(") // TODO: "), "id").alias("line_text"))
    rules = fs.default_rules(spark)
    whole = rows(fs.scan_rules(lines, rules), "line", "rule_name", "column")
    halves = fs.scan_rules(lines.filter("line < 77"), rules).unionByName(fs.scan_rules(lines.filter("line >= 77"), rules))
    assert rows(halves, "line", "rule_name", "column") == whole
    assert rows(fs.scan_rules(lines.repartition(13), rules), "line", "rule_name", "column") == whole


def test_nesting_score(spark):
    nested = "function a() { if (x) { for (;;) { while (y) { if (p && q) { switch (z) { case 1: break; } } } } } }"
    df = spark.createDataFrame([("function simple() { return 1; }",), (nested,)], "t string")
    simple, deep = [r.nesting_score for r in fs.nesting_score(df, "t").collect()]
    assert simple == 1 and deep > 10


def test_message_templates(spark):
    df = spark.createDataFrame(
        [("no-unused-vars", "Variable 'userName' is unused"), ("max", 'At "x" 12 of 3a')], "rule_name string, message string")
    got = fs.message_template(df).collect()
    assert got[0].template == "Variable '<STRING>' is unused" and got[0].pattern_id.startswith("no-unused-vars::")
    assert got[1].template == 'At "<STRING>" <NUMBER> of 3a'
    full = fs.message_template(df, mode="full").collect()
    assert full[0].template == "<IDENTIFIER> '<<IDENTIFIER>>' <IDENTIFIER> <IDENTIFIER>"
    with pytest.raises(ValueError):
        fs.message_template(df, mode="other")


def _findings(spark, sizes):
    parts = [(rule, i) for rule, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(parts, "rule_name string, i int")
    return df.select(
        "rule_name", F.concat(F.lit("Variable 'v"), "i", F.lit("' is unused")).alias("message"),
        F.concat(F.lit("src/f"), "i", F.when(F.col("i") % 2 == 0, ".ts").otherwise(".js")).alias("file_path"),
        F.col("i").alias("line"), F.lit(1).alias("column"),
        F.when(F.col("i") == 0, "Error").otherwise("Warning").alias("severity"),
        F.timestamp_seconds(F.col("i") * 60).alias("seen_at"))


def test_learning_from_findings(spark):
    found = _findings(spark, {"often": 8, "rare": 3, "once": 1})
    stats = fs.pattern_stats(found)
    often = stats.filter("rule_id = 'often'").first()
    assert often["count"] == 8 and often.file_types == ["js", "ts"] and often.severity_distribution == {"Error": 1, "Warning": 7}
    assert often.message_template == "Variable 'v0' is unused" and often.first_seen < often.last_seen
    proposals = fs.propose_rules(stats).collect()
    assert [(p.name, p.confidence, p.training_examples) for p in proposals] == [("Adaptive Rule: often", 0.8, 8)]
    every = {p.name[15:]: p.confidence for p in fs.propose_rules(stats, min_count=1, min_confidence=0).collect()}
    assert every == {"often": 0.8, "rare": 0.55, "once": 0.3}
    known = spark.createDataFrame([(proposals[0].rule_id,)], "rule_id string")
    assert fs.propose_rules(stats, known).count() == 0
    assert fs.learn_rules(found).count() == 1
    assert rows(fs.pattern_clusters(stats), "cluster_id") == [("cluster_often",), ("cluster_once",), ("cluster_rare",)]
    assert stats.count() == fs.pattern_clusters(stats).count()


def test_mistakes_and_metrics(spark):
    found = _findings(spark, {"no-var": 3, "other": 2}).withColumn("confidence", F.lit(0.5))
    listed = spark.createDataFrame([(r,) for r in COMMON_MISTAKES], "rule_name string")
    got = fs.mistake_summary(found, listed).first()
    assert (got.total_mistakes, got.ai_generated_mistakes, got.average_confidence) == (5, 3, 0.5)
    assert fs.mistake_summary(found.filter("rule_name = 'other'"), listed).first().average_confidence == 0
    assert fs.only_listed(found, listed).count() == 3
    both = fs.combine_engines(a=found, b=found.drop("confidence"))
    assert [tuple(r) for r in fs.lint_metrics(both, ["source"]).orderBy("source").collect()] == [("a", 5, 3, 2, 3), ("b", 5, 3, 2, 3)]
    ordered = [(r.file_path, r.line) for r in fs.sort_findings(found).collect()]
    assert ordered == sorted(ordered)


def test_context_is_clipped(spark):
    lines = fs.explode_lines(spark.createDataFrame([("f", "1\n2\n3\n4\n5\n6")], "k string, t string"), "t")
    at = spark.createDataFrame([("f", 1), ("f", 5)], "k string, line int")
    got = {r.line: r for r in fs.with_context(lines, at, ["k"], 3).collect()}
    assert (got[1].before_lines, got[1].error_line, got[1].after_lines) == ([], "1", ["2", "3", "4"])
    assert (got[5].before_lines, got[5].error_line, got[5].after_lines) == (["2", "3", "4"], "5", ["6"])


def test_secret_literals(spark):
    text = "a = 'password1234'; b = \"mytoken\"; c = 'passwordonly'; d = 'http://x.y'; e = 'https://x.y'; f = 'api_key=1'"
    found = fs.secret_literals(spark.createDataFrame([(1, text)], "k int, t string"), "t")
    assert rows(found, "value", "rule_name") == [
        ("api_key=1", "hardcoded-credential"), ("http://x.y", "insecure-url"), ("password1234", "hardcoded-credential")]


def test_replacements_go_from_the_last_line_up(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a")], "k int, t string")
    fixes = spark.createDataFrame([(1, 1, "b", "c"), (1, 9, "a", "b")], "k int, line int, original string, fixed string")
    assert rows(fs.apply_replacements(docs, fixes, "k", "t"), "k", "t") == [(1, "c c c"), (2, "a")]


def test_reuse_by_content_runs_once_per_text(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(30)] + [(99, None)], "k int, t string")
    once = fs.reuse_by_content(df.filter("t IS NOT NULL"), "t", lambda d: d.select("content_id", F.length("t").alias("n")))
    assert once.count() == 30 and once.filter("n = 4").count() == 20

    def tagged(distinct):
        assert distinct.count() == 11
        return distinct.select("content_id", F.monotonically_increasing_id().alias("run"))

    assert fs.reuse_by_content(df.filter("t IS NOT NULL"), "t", tagged).select("run").distinct().count() == 11


def test_annotation_coverage_and_gaps(spark):
    texts = [
        (1, "function a(x) {}"),
        (2, "/**\n * Adds.\n * @param a first\n * @param {b} second\n */\nexport function add(a: number, b = 2) {}"),
        (3, "/** One. */\nfunction one() {}\n\nfunction two() {}"),
        (4, "const x = 1;"),
        (5, "class A {\n  /** Doc. */\n  public one() {\n  }\n  two(p?: string, { q }) {\n  }\n}"),
        (6, "/** Far. */\nlet z;\nfunction far() {}"),
        (7, "/**\n * @custom tag\n */\nfunction tagged() {}"),
    ]
    df = spark.createDataFrame(texts, "k int, t string")
    got = {r.k: (r.total_symbols, r.documented_symbols, r.coverage) for r in fs.annotation_coverage(df, "t").collect()}
    assert got[1] == (1, 0, 0.0) and got[2] == (1, 1, 100.0) and got[3] == (2, 1, 50.0) and got[4] == (0, 0, 100.0)
    assert got[5] == (2, 1, 50.0) and got[6] == (1, 0, 0.0)
    symbols = fs.annotation_symbols(df, "t")
    assert symbols.count() == sum(v[0] for v in got.values())
    gaps = rows(fs.annotation_gaps(symbols), "k", "gap", "detail")
    assert (1, "missing-comment", "a") in gaps and not [g for g in gaps if g[0] == 2]
    assert [g for g in gaps if g[0] == 7] == [(7, "missing-summary", "tagged"), (7, "unknown-tag", "@custom")]
    assert [g for g in gaps if g[0] == 5] == [(5, "missing-comment", "two")]


def test_answers(spark):
    df = spark.createDataFrame([(1, "a\n```ts\nconst x = 1;\n```\nb"), (2, "  plain  "), (3, "```one```"), (4, "``` open")], "k int, t string")
    assert rows(fs.extract_code_blocks(df, "t"), "k", "code") == [(1, "const x = 1;"), (2, "plain"), (3, "one"), (4, "``` open")]
    answers = [(1, 'see [{"source":"A","target":"B","type":"uses","confidence":0.9},{"source":"C"}] end'), (2, "[oops"),
               (3, '[{"source":1,"target":"B","type":"uses","confidence":1}]'), (4, "[1, 2]"),
               (5, '[{"source":"A","target":"B","type":"uses","confidence":"0.9"}]'), (6, '[{"source":"A","target":"[B]","type":"u","confidence":1}]')]
    edges = fs.extract_json_edges(spark.createDataFrame(answers, "k int, t string"), "t")
    assert rows(edges, "k", "source", "target", "type", "confidence") == [(1, "A", "B", "uses", 0.9), (6, "A", "[B]", "u", 1.0)]


def test_custom_rule(spark):
    lines = fs.explode_lines(spark.createDataFrame([("f", "# a\nb\n# c")], "k string, t string"), "t")
    assert rows(fs.custom_rule(lines, "hash", lambda x: x.startswith("#")), "line", "rule_name") == [(1, "hash"), (3, "hash")]

    @F.pandas_udf("boolean")
    def hashed(x):
        return x.str.startswith("#")

    assert rows(fs.scan_custom_rules(lines, fs.register_rule({}, "vectorised", hashed)), "line") == [(1,), (3,)]


def test_text_metrics(spark):
    df = spark.createDataFrame([(1, "a + b * a"), (2, ""), (3, "a b")], "k int, t string")
    got = {r.k: r for r in fs.token_mix(df, "t").collect()}
    assert (got[1].total_operators, got[1].total_operands, got[1].distinct_operators, got[1].distinct_operands) == (2, 3, 2, 2)
    assert got[1].volume == pytest.approx(10.0) and got[1].difficulty == pytest.approx(1.5) and got[1].effort == pytest.approx(15.0)
    assert got[2].volume == got[3].volume == got[3].effort == 0
    units = spark.createDataFrame([(1, 1, 1.0), (10, 0, 5.0), (500, 10000, 5.0), (5, 100, 0.0)], "cyclomatic int, loc int, volume double")
    clamped = [r.maintainability for r in fs.maintainability(units).collect()]
    assert clamped[:3] == [100.0, 100.0, 0.0] and 0 < clamped[3] < 100
    assert fs.maintainability(units, "volume").collect()[1].maintainability == 100.0


def test_improvement(spark):
    schema = "k int, cyclomatic int, cognitive int, nesting int"
    before = spark.createDataFrame([(1, 10, 5, 2), (2, 4, 0, 0), (3, 0, 0, 0)], schema)
    after = spark.createDataFrame([(1, 5, 5, 1), (2, 8, 0, 0), (3, 1, 1, 1)], schema)
    assert [v for _, v in rows(fs.improvement(before, after, ["k"]), "k", "improvement")] == [pytest.approx(7 / 19 * 100), -100.0, 0.0]
    assert [v for _, v in rows(fs.improvement(before, after, ["k"], "cc"), "k", "improvement")] == [50.0, 0.0, 0.0]


def test_line_diff(spark):
    old = spark.createDataFrame([(1, "a\nb\nc", 0), (2, "", 3)], "k int, t string, d int")
    new = spark.createDataFrame([(1, "a\nx", 2), (2, "z", 1)], "k int, t string, d int")
    assert rows(fs.line_diff(old, new, ["k"], "t"), "k", "changed_lines") == [(1, 2), (2, 1)]
    assert rows(fs.line_diff(old, new, ["k"], "t", documented="d"), "k", "changed_lines") == [(1, 4), (2, 1)]


def test_lint_texts(spark):
    df = spark.createDataFrame([("a", "eval(1)\n" + "x" * 121), ("b", "a;b;c;d;")], "file_path string, text string")
    found = fs.lint_texts(df, fs.default_rules(spark))
    assert rows(found, "file_path", "line", "rule_name", "source") == [
        ("a", 1, "eval-usage", "rules"), ("a", 2, "long-line", "lines"), ("b", 1, "multiple-statements", "lines")]


def test_markers_and_absence(spark):
    df = spark.createDataFrame([(1, "TODO FIXME TODO"), (2, "addEventListener"), (3, "addEventListener removeEventListener")], "k int, t string")
    assert rows(fs.marker_count(df, "t"), "k", "markers") == [(1, 3), (2, 0), (3, 0)]
    assert rows(fs.paired_absence(df, "t"), "k") == [(2,)]


def test_rules_as_data(spark):
    rules = spark.createDataFrame(
        [("a", "Security", "static", 3, True, False, ["x"]), ("b", "Style", "hybrid", 1, False, True, ["y"]), ("c", "security", "static", 2, True, True, [])],
        "id string, category string, kind string, cost int, ai_enhanced boolean, autofix boolean, tags array<string>")
    assert [r.id for r in fs.filter_rules(rules).collect()] == ["b", "c", "a"]
    assert [r.id for r in fs.filter_rules(rules, tags=["x", "y"], max_cost=2).collect()] == ["b"]
    assert [r.id for r in fs.filter_rules(rules, category="Security", ai_enhanced=True, autofix=False).collect()] == ["a"]
    off = spark.createDataFrame([("SECURITY", False)], "category string, on boolean")
    own = spark.createDataFrame([("a", True), ("b", False)], "rule string, on boolean")
    assert rows(fs.enabled_rules(rules), "id") == [("a",), ("b",), ("c",)]
    assert rows(fs.enabled_rules(rules, off), "id") == [("b",)]
    assert rows(fs.enabled_rules(rules, off, own), "id") == [("a",)]
    labels = spark.createDataFrame([("WARN", "STYLE"), ("odd", "House")], "severity string, category string")
    assert rows(fs.normalize_labels(labels), "severity", "category") == [("Warning", "Style"), ("Warning", "house")]
    assert rows(fs.normalize_labels(labels, default_severity="Info"), "severity") == [("Info",), ("Warning",)]
    stats = {r.category: r for r in fs.rule_stats(rules).collect()}
    assert (stats["Security"].rules, stats["Security"].ai_enhanced_rules, stats["Security"].autofix_rules) == (1, 1, 0)


def test_index_of_literals_gives_the_same_findings(spark):
    rules = fs.default_rules(spark).unionByName(fs.fix_rules(spark)).unionByName(spark.createDataFrame(
        [("groups", "g", "d", r"call(\w+)\((\d+)\)", "Info", "x", True, ["*"], 1, "use$1 of $2", 0.5, True, None, None),
         ("alternatives", "g", "d", "alphabet|betabet", "Info", "x", True, ["ts"], 1, None, 0.5, False, None, "alpha"),
         ("short", "g", "d", "ab", "Info", "x", True, ["*"], 1, None, 0.5, True, None, None),
         ("off", "g", "d", "alphabet", "Info", "x", False, ["*"], 1, None, 0.5, True, None, None),
         ("ends", "g", "d", "alphabet$", "Info", "x", True, ["*"], 1, None, 0.5, False, None, None)], rules_module.RULE_SCHEMA))
    texts = spark.createDataFrame(
        [(1, "ts", "x callOne(1) callTwo(22)\r\nalphabet betabet\n\nbetabet alphabet"), (2, "js", "alphabet\nconsole.log(eval(1))"), (3, "ts", ""),
         (4, None, "for (i = 0; i < list.length; i++) é callX(3) TODO: x"), (5, "ts", None), (6, "ts", "a.b!.c: any; " * 3000 + "callLast(9)")],
        "id int, language string, text string")
    for language in (None, "language"):
        want = fs.scan_texts(texts, rules, language)
        got = fs.scan_texts_indexed(texts, rules, language)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 3000


def test_the_index_keeps_the_rarest_gram(spark):
    rules = spark.createDataFrame(
        [("a", "a", "d", "common words here", "Info", "x", True, ["*"], 1, None, 0.5, True, None, None)], rules_module.RULE_SCHEMA)
    texts = spark.createDataFrame([("common",), ("words",), (" here",), ("wordless",)], "text string")
    index, plain = rules_module.rule_index(rules, texts)
    (row,) = index.collect()
    assert row.literal == "common words here" and row.gram not in ("comm", "word", "here", "ommo") and plain.count() == 0
    assert fs.scan_texts_indexed(texts, rules).count() == 0


def test_known_grams_are_those_of_the_rules(spark):
    literals = ["alphabet", "Größe mal", "日本語テキスト", "😀😁😂😃x", "tail"]
    index, _ = rules_module.rule_index(spark.createDataFrame(
        [(x, "g", "d", x, "Info", "x", True, ["*"], 1, None, 0.5, False, None, None) for x in literals], rules_module.RULE_SCHEMA))
    grams = {r.gram for r in index.collect()}
    assert len(grams) == len(literals)
    filler = "".join(chr(97 + i * 7 % 26) for i in range(rules_module.STRETCH))
    texts = [*literals, None, "", "abc", filler + literals[0] + filler, *["x" * i + "tail" for i in range(8)], "tai", "l"]
    column = pa.array(["not seen", *texts])[1:]
    found = rules_module._known_grams(column, rules_module._gram_filter(index)).to_pylist()
    for text, got in zip(texts, found):
        assert {g for g in got if g in grams} == {g for g in grams if g in (text or "")}
    assert sum(len(f) for f in found) < 100  # not one for each place of a text


def test_expression_of_a_fix_grows_with_its_groups():
    one, many = rules_module._matches_of_column("line", "pattern", "fix")
    assert len(one) < 2000 and len(many) < 2500 and one.count("regexp_extract(") == 10
