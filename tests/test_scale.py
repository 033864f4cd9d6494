"""No limits: long rule tables, templates, chains and talks; hot keys; literal values of the fixed tables."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import findspan as fs
from findspan.functions.patterns import required_literals
from findspan.operators import calls, corpus, rules


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_rules_beyond_one_pass(spark, monkeypatch):
    monkeypatch.setattr(rules, "RULES_PER_PASS", 900)
    table = [(f"r{i}", "n", "d", f"word{i}x", "Info", "c", True, ["*"], 1, None, 1.0, False, None, None) for i in range(2500)]
    many = spark.createDataFrame(table, rules.RULE_SCHEMA)
    texts = spark.createDataFrame([(1, "word0x\nword2499x word77x"), (2, "none")], "k int, text string")
    want = [("r0", 1), ("r2499", 2), ("r77", 2)]
    assert rows(fs.scan_texts(texts, many), "rule_name", "line") == want
    assert rows(fs.scan_rules(fs.explode_lines(texts, "text"), many), "rule_name", "line") == want
    assert fs.scan_texts(texts, many.limit(0)).count() == 0


def test_templates_beyond_one_pass(spark):
    table = [(f"t{i}", [f"**/{i}/*.ts"], []) for i in range(2500)]
    many = spark.createDataFrame(table, "template_id string, include array<string>, exclude array<string>")
    files = spark.createDataFrame([("a/7/x.ts",), ("2499/y.ts",), ("z.ts",)], "path string")
    assert rows(fs.match_templates(files, many), "path", "template_id") == [("2499/y.ts", "t2499"), ("a/7/x.ts", "t7")]


def test_twenty_thousand_templates_through_the_index(spark):
    from findspan.operators.templates import _glob_key

    many = spark.range(20_000).select(
        F.concat(F.lit("t"), F.col("id")).alias("template_id"),
        F.when(F.col("id") % 2 == 0, F.array(F.concat(F.lit("src/m"), F.col("id"), F.lit("/**"))))
        .otherwise(F.array(F.concat(F.lit("**/*.x"), F.col("id")), F.lit("nowhere/*"))).alias("include"),
        F.array(F.lit("**/skip*")).alias("exclude"))
    paths = [(f"src/m{i}/a.x{i + 1}",) for i in range(0, 4000, 2)] + [("src/m2/skip.x3",), ("src/m2",), ("",), ("src/m2/é.ts",), (None,)]
    found = fs.match_templates_indexed(spark.createDataFrame(paths, "path string"), many)
    want = [(p, f"t{i + k}") for i, (p,) in zip(range(0, 4000, 2), paths) for k in (0, 1)] + [("src/m2/é.ts", "t2")]
    assert rows(found, "path", "template_id") == sorted(want, key=repr)
    assert [_glob_key(g) for g in ("a/b/*.ts", "*/a.ts", "**/*", "x*y", "[ab].c", "plain", "a.b")] == ["in a/b/", "by ts", "any", "any", "by c", "any", "by b"]


def test_indexed_templates_equal_the_others(spark):
    globs = ["**/*.ts", "src/**", "src/*/x?.{ts,js}", "*", "**/test*/**", "a.b", "[ab]*.js", "{src,lib}/**/*.js", "**"]
    templates = spark.createDataFrame([(f"t{i}", [g, globs[i - 1]], [globs[i - 3]] if i % 2 else []) for i, g in enumerate(globs)],
                                      "template_id string, include array<string>, exclude array<string>")
    paths = ["src/a.ts", "src/q/x1.ts", "src/q/x12.js", "lib/a/b.js", "a.b", "b.js", "x/tests/y.md", "", "deep/er/a.ts", "src/", "no ext/f"]
    files = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, n int")
    assert rows(fs.match_templates_indexed(files, templates), "n", "template_id") == rows(fs.match_templates(files, templates), "n", "template_id")


def test_intermediate_tables_can_be_deleted(spark):
    from findspan.session import cut_lineage, delete_work, work_so_far

    mark = work_so_far()
    first, second = cut_lineage(spark.range(3)), cut_lineage(spark.range(4))
    kept = second.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert delete_work(spark, mark, [p for p in (kept, "file:" + kept)]) == 1
    assert second.count() == 4 and delete_work(spark, mark) == 1
    with pytest.raises(Exception, match="(?i)not.exist|no such file"):
        first.count()


def test_many_candidates_and_no_examples(spark):
    many = spark.range(6000).select(F.lit("p").alias("predictor"), F.col("id").cast("string").alias("candidate"))
    examples = spark.createDataFrame([(1,), (2,)], "x int")
    args = (lambda c, part: [int(c)] * len(part), lambda part, answers: [float(a == x) for a, x in zip(answers, part["x"])])
    best = fs.search_candidates(many, examples, *args).filter("score > 0")
    assert rows(best, "candidate", "score") == [("1", 0.5), ("2", 0.5)]
    none = fs.search_candidates(many.limit(3), examples.limit(0), *args)
    assert none.count() == 3 and none.filter("score <> 0").count() == 0


def test_many_providers(spark):
    table = [(f"p{i:04}", i / 2000, 0.1, 0.1, 0.1, 1000, True) for i in range(1500)]
    providers = spark.createDataFrame(table, calls.PROVIDER_SCHEMA)
    requests = spark.createDataFrame([("analysis", "x", [])], "kind string, content string, preferred array<string>")
    ranked = fs.ranked_providers(requests, providers).first().ranked
    assert len(ranked) == 1500 and ranked[0].provider == "p1499" and ranked[0].reason == "analysis, reasoning"


def test_long_chain_of_parents(spark):
    n = 1500
    chain = spark.range(n).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    ended, circular = fs.ancestry(chain)
    got = {r.child: r.chain for r in ended.collect()}
    assert circular.count() == 0 and all(got[k] == list(range(k + 1, n + 1)) for k in range(n))


def test_circles_end_where_a_node_comes_again(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 2), (5, 5), (6, 1), (7, 8)]
    ended, circular = fs.ancestry(spark.createDataFrame(pairs, "child int, parent int"))
    assert rows(ended, "child", "chain") == [(7, [8])]
    assert rows(circular, "child", "chain") == [
        (1, [2, 3, 4, 2]), (2, [3, 4, 2]), (3, [4, 2, 3]), (4, [2, 3, 4]), (5, [5]), (6, [1, 2, 3, 4, 2])]


def test_long_talks_come_back_in_order(spark):
    turns = spark.range(5).select(F.lit("c").alias("c"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    parts = fs.assemble_conversations(turns, ["c"], part_size=2)
    assert parts.count() == 3
    back = fs.parse_conversations(parts.select("c", "part", "json"), ["c"], part="part")
    assert rows(back, "turn", "content") == [(k, f"t{k}") for k in range(5)]


def test_groups_of_every_match_and_fixed_texts(spark):
    table = [("len", "len", "d", r"(\w+)\.(length)", "Info", "c", True, ["*"], 1, "use $1/$2", 1.0, True, None, None)]
    rule = spark.createDataFrame(table, rules.RULE_SCHEMA)
    lines = spark.createDataFrame([(1, "a.length + bb.length")], "line int, line_text string")
    assert rows(fs.scan_rules(lines, rule), "matched", "suggested_fix") == [("a.length", "use a/length"), ("bb.length", "use bb/length")]
    texts = spark.createDataFrame([(1, "let x: any = 1\nf(y : any)")], "k int, text string")
    found = fs.scan_texts(texts, fs.fix_rules(spark)).select(
        "k", "line", F.col("original_text").alias("original"), F.col("suggested_fix").alias("fixed"))
    assert fs.apply_replacements(texts, found, "k", "text").first().text == "let x: unknown = 1\nf(y : unknown)"


def test_context_comes_from_the_row(spark):
    texts = spark.createDataFrame([(1, "a\nb\neval(x)\nc")], "k int, text string")
    got = fs.scan_texts(texts, fs.default_rules(spark), context=1).first()
    assert (got.line, got.before_lines, got.error_line, got.after_lines) == (3, ["b"], "eval(x)", ["c"])


def test_required_literals():
    assert required_literals(r"eval\s*\(") == ["eval"] and required_literals("abc|def\\.x+") == ["abc", "def.x"]
    assert required_literals("(?i)abc") is None and required_literals("(abc|d)e?") is None and required_literals("ab?c") is None


def test_calls_without_a_time_are_rejected_and_hot_keys_are_exact(spark):
    rng = np.random.default_rng(4)
    n = 60_000
    at = np.sort(rng.integers(0, 10 * 86_400, n))
    keys = np.where(rng.random(n) < 0.4, "hot", np.char.add("k", rng.integers(0, 50, n).astype(str)))
    frame = pd.DataFrame({"id": np.arange(n), "key": keys, "ts": pd.to_datetime(at, unit="s")})
    frame.loc[5, "ts"] = pd.NaT
    table = spark.createDataFrame(frame)
    got = fs.throttle(table, ["key"], "ts", "id", 3, 3600, 5 * 3600).toPandas().set_index("id").sort_index()
    assert len(got) == n and not got.loc[5, "accepted"] and pd.isna(got.loc[5, "window_start"])
    for _, part in frame[frame.ts.notna()].groupby("key"):
        opened, used, want = None, 0, []
        for t in part.ts:
            if opened is None or (t - opened).total_seconds() >= 3600:
                opened, used = t, 0
            want.append(used < 3)
            used += 1
        assert got.loc[part.id, "accepted"].tolist() == want
    aligned = fs.throttle_aligned(table, ["key"], "ts", "id", 3, "1 hour")
    assert aligned.count() == n and aligned.filter("id = 5 AND NOT accepted AND window_start IS NULL").count() == 1


def test_failed_requests_carry_their_errors(spark):
    attempts = spark.createDataFrame(
        [(1, 1, 0.5, False, "slow"), (1, 2, 0.9, False, "down"), (2, 1, 0.5, True, None), (2, 2, 0.9, False, "down")],
        "request int, n int, score double, ok boolean, why string")
    got = fs.first_success(attempts, ["request"], "score", "ok", "n", error="why")
    assert rows(got, "request", "failures_before", "errors") == [(1, 2, ["down", "slow"]), (2, 1, None)]


def test_settings_from_extends(spark):
    from findspan.operators.settings import effective_settings

    files = spark.createDataFrame([("base", None), ("a", ["base"]), ("b", ["base"]), ("app", ["a", "b"]), ("x", ["y"]), ("y", ["x"]), ("z", ["x"])],
                                  "file string, extends array<string>")
    values = [("base", "t", "1"), ("base", "u", "1"), ("a", "t", "2"), ("a", "v^w", "2"), ("b", "u", "3"), ("app", "o", "4"), ("x", "t", "9")]
    merged, loops = effective_settings(files, spark.createDataFrame(values, "file string, path string, value string"), separator="^")
    # The later entry of the list goes over the earlier one, with what it builds on.
    assert rows(merged.filter("file = 'app'"), "path", "value") == [("o", "4"), ("t", "1"), ("u", "3"), ("v^w", "2")]
    assert rows(loops, "file") == [("x",), ("y",), ("z",)]


def test_values_of_the_fixed_tables():
    """Pinned as text, so that a slip in a table shows although queries and SQL share it."""
    assert ("openai", 0.88, 0.95, 0.85, 0.85, 200000, True) in calls.PROVIDERS and len(calls.PROVIDERS) == 3
    assert calls.REQUIREMENTS["fix"] == (True, True, True, False, None, False)
    assert calls.REQUIREMENTS["optimization"] == (False, False, True, False, 50000, True)
    assert ("Wasm", False, "Critical", "wasm") in calls.ERROR_KINDS and len(calls.ERROR_KINDS) == 22
    assert [r[0] for r in rules.PATTERN_RULES] == [
        "eval-usage", "console-log", "hardcoded-secrets", "nested-loops", "sync-fs", "any-type", "non-null-assertion", "todo-markers"]
    assert rules.PATTERN_RULES[2][3] == r"(password|secret|key|token)\s*[:=]\s*['\"][^'\"]+['\"]"
    assert corpus.NESTING_NEEDLES == ("{", "if ", "else if", "switch", "case ", "for ", "while ", "do ", " && ", " || ")
    assert [s[0] for s in corpus.LINE_SMELLS] == ["long-line", "multiple-statements"]


def test_worker_functions_need_no_package_on_the_path(tmp_path):
    """Only the driver knows where the library is; its workers start in an empty folder."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(fs.__file__).resolve().parents[1])!r})
import findspan as fs
from findspan.session import builder
spark = builder("ship").master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
calls = spark.sql("SELECT id, 'k' AS key, timestamp_seconds(id * 40) AS ts FROM range(4)")
print(fs.throttle(calls, ["key"], "ts", "id", 1, 60).filter("accepted").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240, check=True)
    assert done.stdout.split()[-1] == "2"


def test_candidates_see_a_bounded_number_of_examples(spark):
    candidates = spark.createDataFrame([("p", "a")], "predictor string, candidate string")
    examples = spark.range(0, 5000, 1, 1).select(F.col("id").alias("x"))
    # The score is the mean number of examples that a call gets.
    found = fs.search_candidates(candidates, examples, lambda c, part: [len(part)] * len(part), lambda part, answers: answers)
    assert found.first().score <= 1000
