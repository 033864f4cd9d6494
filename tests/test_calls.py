"""Calls, versions, settings, candidates and graphs: fixtures and brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import findspan as fs
from findspan.functions.ordered import first_at_least
from findspan.operators.calls import PROVIDER_SCHEMA
from findspan.operators.running import in_ranges
from findspan.operators.versions import PROMPTS_SCHEMA


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_provider_ranking(spark):
    requests = spark.createDataFrame(
        [("fix", "x", []), ("generation", "x", []), ("general", "x", []), ("analysis", "x", ["google"]),
         ("fix", "x" * 600000, []), ("optimization", "x", [])], "kind string, content string, preferred array<string>"
    ).withColumn("request_id", F.monotonically_increasing_id()).withColumn("size", F.length("content"))
    ranked = fs.rank_providers(requests, fs.default_providers(spark)).orderBy("kind", "size", "rank").collect()
    got = {}
    for r in ranked:
        got.setdefault((r.kind, r["size"]), []).append((r.provider, round(r.score, 4)))
    assert got[("fix", 1)] == [("claude", 0.825), ("openai", 0.804), ("google", 0.735)]
    assert got[("generation", 1)] == [("openai", 0.455), ("google", 0.42), ("claude", 0.405)]
    assert got[("general", 1)] == [("claude", 0.9167), ("openai", 0.8933), ("google", 0.8167)]
    assert got[("analysis", 1)][0] == ("google", 1.595)
    assert got[("fix", 600000)][2] == ("google", 0.3675)
    assert got[("optimization", 1)] == [("claude", 0.285), ("google", 0.255), ("openai", 0.255)]
    alone = spark.createDataFrame([("p", 1.0, 1.0, 1.0, 1.0, 10, False)], PROVIDER_SCHEMA)
    assert fs.rank_providers(requests.filter("kind = 'optimization'"), alone).first().score == pytest.approx(0.3 * 0.5 * 0.7)


def sequential(calls, cap, width):
    """Window openings and verdicts call by call."""
    state, verdicts = {}, {}
    for ident, key, at in sorted(calls, key=lambda c: (c[2], c[0])):
        opened, used = state.get(key, (None, 0))
        if opened is None or at - opened >= timedelta(seconds=width):
            opened, used = at, 0
        verdicts[ident] = (opened, used < cap)
        state[key] = (opened, used + (used < cap))
    return verdicts


def test_throttle_example(spark):
    start = datetime(2024, 1, 1)
    calls = [(i, "k", start + timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 61, 62, 63))]
    df = spark.createDataFrame(calls, "id int, key string, ts timestamp")
    got = {r.id: r.accepted for r in fs.throttle(df, ["key"], "ts", "id", 2, 60).collect()}
    assert [got[i] for i in range(6)] == [True, True, False, True, True, False]


@pytest.mark.parametrize("seed, spread", [(1, 400), (2, 4000), (3, 100_000)])
def test_throttle_equals_call_by_call(spark, seed, spread):
    rnd, start = random.Random(seed), datetime(2024, 3, 1, 11, 58)
    keys = ["hot"] * 6 + ["a", "b", None]
    calls = [(i, rnd.choice(keys), start + timedelta(milliseconds=rnd.randrange(spread * 1000) // 500 * 500)) for i in range(1500)]
    df = spark.createDataFrame(calls, "id int, key string, ts timestamp").repartition(7)
    got = {r.id: (r.window_start, r.accepted) for r in fs.throttle(df, ["key"], "ts", "id", 3, 60, 150).collect()}
    assert got == sequential(calls, 3, 60)


@pytest.mark.parametrize("fan", [2, 3])
def test_throttle_composes_many_stretches(spark, monkeypatch, fan):
    """A long history of few calls: functions are composed over several levels."""
    monkeypatch.setattr(fs.operators.calls, "FAN", fan)
    rnd, start = random.Random(fan), datetime(2020, 1, 1)
    calls = [(i, rnd.choice("ab"), start + timedelta(seconds=rnd.randrange(40_000))) for i in range(900)]
    calls += [(1000 + i, "late", start + timedelta(seconds=39_000 + i)) for i in range(200)] + [(2000, "once", start)]
    df = spark.createDataFrame(calls, "id int, key string, ts timestamp").repartition(5)
    got = {r.id: (r.window_start, r.accepted) for r in fs.throttle(df, ["key"], "ts", "id", 2, 60, 130).collect()}
    assert got == sequential(calls, 2, 60)


def test_throttle_with_many_keys_over_thirty_years(spark):
    """The third call of each key comes ten seconds after the second, across the end of a stretch: always rejected."""
    keys, day = 100_000, 86_400
    calls = spark.range(3 * keys).select(
        "id", (F.col("id") % keys).alias("key"),
        F.timestamp_seconds(
            F.pmod(F.xxhash64(F.col("id") % keys), F.lit(30 * 365)) * day + F.when(F.col("id") < keys, 0).when(F.col("id") < 2 * keys, 3595).otherwise(3605)
        ).alias("ts"))
    got = fs.throttle(calls, ["key"], "ts", "id", 1, 60).groupBy((F.col("id") / keys).cast("int").alias("turn"), "accepted").count()
    assert rows(got, "turn", "accepted", "count") == [(0, True, keys), (1, True, keys), (2, False, keys)]


def test_first_at_least_equals_search():
    rnd = np.random.default_rng(7)
    big = 1 << 61
    groups = np.sort(rnd.integers(0, 9, 300))
    at = rnd.integers(0, 60, 300) * (big // 30) - big
    order = np.lexsort((at, groups))
    groups, at = groups[order], at[order]
    asked = rnd.integers(0, 10, 400)
    wanted = rnd.integers(0, 62, 400) * (big // 30) - big
    found = first_at_least(groups, at, asked, wanted)
    for g, w, k in zip(asked, wanted, found):
        fits = [i for i in range(300) if groups[i] == g and at[i] >= w]
        assert k == (fits[0] if fits else -1)


def test_aligned_throttle_never_exceeds_the_cap(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("key"), F.timestamp_seconds(F.col("id") * 7 % 600).alias("ts"))
    got = fs.throttle_aligned(df, ["key"], "ts", "id", 5)
    assert got.count() == 500
    assert got.filter("accepted").groupBy("key", "window_start").count().agg(F.max("count")).first()[0] == 5


def test_first_success_with_ties_of_text_and_missing_scores(spark):
    df = spark.createDataFrame(
        [(1, "b", 0.9, True), (1, "a", 0.9, True), (1, "c", 0.9, False), (2, "z", None, True), (2, "y", 0.1, False)],
        "request int, name string, score double, ok boolean")
    got = fs.first_success(df, ["request"], "score", "ok", "name")
    assert rows(got, "request", "name", "failures_before") == [(1, "a", 0), (2, "z", 1)]


def test_first_success(spark):
    df = spark.createDataFrame(
        [(1, 1, "a", 0.8, False), (1, 2, "b", 0.7, True), (1, 3, "c", 0.6, True), (2, 4, "a", 0.8, False), (2, 5, "b", 0.7, False),
         (None, 6, "a", 0.5, True)], "request_id int, n int, provider string, score double, success boolean")
    got = {r.request_id: r for r in fs.first_success(df, ["request_id"], "score", "success", "n", ["provider"]).collect()}
    assert (got[1].provider, got[1].score, got[1].failures_before, got[1].succeeded) == ("b", 0.7, 1, True)
    assert (got[2].provider, got[2].failures_before, got[2].succeeded) == (None, 2, False)
    assert got[None].provider == "a"


def test_usage(spark):
    schema = ("g string, ord int, provider string, input_tokens long, output_tokens long, reasoning_tokens long, "
              "execution_time_ms long")
    calls = spark.createDataFrame(
        [("a", 1, "claude", 100, 50, 10, 1000), ("a", 2, "gpt4", 200, 75, 15, 1500), ("b", 1, None, 0, 5, 10, None),
         ("b", 2, "gemini", 0, 5, None, 7), ("c", 1, "x", 100, 50, None, 1)], schema)
    got = {r.g: r for r in fs.usage_rollup(fs.with_total_tokens(calls), ["g"]).collect()}
    assert (got["a"].input_tokens, got["a"].output_tokens, got["a"].reasoning_tokens, got["a"].provider) == (300, 125, 25, "claude")
    assert (got["a"].execution_time_ms, got["a"].total_tokens) == (2500, 450)
    assert (got["b"].provider, got["b"].reasoning_tokens, got["b"].efficiency) == ("gemini", 10, 0.0)
    assert (got["c"].reasoning_tokens, got["c"].total_tokens, got["c"].efficiency) == (None, 150, 0.5)
    plain = fs.usage_rollup(fs.with_total_tokens(calls, count_reasoning=False)).first()
    assert plain.total_tokens == 585


def test_runs_hits_and_errors(spark):
    runs = spark.createDataFrame([("t", 1000, True, 1), ("t", 2000, False, 2)], "id string, execution_time int, success boolean, at int")
    got = fs.run_summary(runs, ["id"]).first()
    assert (got.usage_count, got.avg_execution_time, got.success_rate, got.last_used) == (2, 1500.0, 0.5, 2)
    assert fs.hit_rate(runs, F.col("success")).first().hit_rate == 0.5
    assert fs.hit_rate(runs.filter("false"), F.col("success"), percent=True).first().hit_rate == 0.0
    errors = spark.createDataFrame([("Timeout",), ("Timeout",), ("Config",), ("Odd",)], "kind string")
    rolled = {r.kind: r for r in fs.error_rollup(errors, fs.error_kinds(spark)).collect()}
    assert (rolled["Timeout"].errors, rolled["Timeout"].recoverable, rolled["Config"].severity) == (2, True, "Error")
    assert rolled["Odd"].category is None and fs.error_kinds(spark).count() == 22


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 1, "tool", "x"), (1, 0, "user", "hi"), (1, 2, None, "y")], "c int, turn int, role string, text string")
    got = fs.assemble_conversations(turns, ["c"]).first()
    assert [(m.role, m.content) for m in got.messages] == [
        ("user", "hi"), ("user", "Invalid role 'tool', defaulting to user: x"), ("user", "Invalid role '', defaulting to user: y")]
    parts = fs.assemble_conversations(turns, ["c"], part_size=2)
    assert [(r.part, len(r.messages)) for r in parts.orderBy("part").collect()] == [(0, 2), (1, 1)]
    raw = spark.createDataFrame([(1, '[{"role":"user","content":"a"},{"role":"user"},{"role":"bot","content":"b"}]')], "c int, json string")
    assert rows(fs.parse_conversations(raw, ["c"]), "role", "content") == [
        ("user", "Invalid role 'bot', defaulting to user: b"), ("user", "a")]


def test_versions(spark):
    steps = ["patch", "minor", "patch", "major"]
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate(steps)], "key string, seq int, change string")
    got = fs.version_timeline(df, ["key"], ["seq"], F.floor(F.col("seq") / 2)).orderBy("seq").collect()
    assert [r.version for r in got] == ["1.0.1", "1.1.0", "1.1.1", "2.0.0"]
    bumps = spark.createDataFrame([("1.2.3", c) for c in ("patch", "minor", "major")] + [("odd", c) for c in ("patch", "minor", "major")], "v string, c string")
    assert [r[0] for r in bumps.select(fs.next_version(F.col("v"), F.col("c"))).collect()] == [
        "1.2.4", "1.3.0", "2.0.0", "1.0.1", "1.1.0", "1.0.0"]


def test_version_timeline_equals_replay(spark):
    rnd = random.Random(5)
    changes = [(rnd.choice(["hot", "hot", "x", None]), i, rnd.choice(["patch", "patch", "minor", "major"])) for i in range(400)]
    df = spark.createDataFrame(changes, "key string, seq int, change string")
    got = {r.seq: r.version for r in fs.version_timeline(df, ["key"], ["seq"], F.floor(F.col("seq") / 30)).collect()}
    now, expected = {}, {}
    for key, seq, change in changes:
        a, b, c = now.get(key, (1, 0, 0))
        now[key] = {"major": (a + 1, 0, 0), "minor": (a, b + 1, 0), "patch": (a, b, c + 1)}[change]
        expected[seq] = ".".join(map(str, now[key]))
    assert got == expected


def test_ranges_split_one_key_at_one_hour(spark):
    """All rows of a key within one hour, and no bucket given: ranges deal them to many tasks."""
    df = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise("hot").alias("k"), F.xxhash64("id").alias("i"),
                                  (F.col("id") % 7).cast("double").alias("v"), F.when(F.col("id") % 5 == 0, "minor").otherwise("patch").alias("change"))
    sizes = [r["count"] for r in in_ranges(df, ["k"], ["i"]).filter("k = 'hot'").groupBy("__range").count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 1500
    total, n, minor, patch = {}, {}, {}, {}
    want = []
    for r in sorted(df.collect(), key=lambda r: r.i):
        total[r.k], n[r.k] = total.get(r.k, 0) + r.v, n.get(r.k, 0) + 1
        minor[r.k], patch[r.k] = (minor.get(r.k, 0) + 1, 0) if r.change == "minor" else (minor.get(r.k, 0), patch.get(r.k, 0) + 1)
        want.append((r.i, total[r.k] / n[r.k], f"1.{minor[r.k]}.{patch[r.k]}"))
    means = {r.i: r.running_mean for r in fs.running_mean(df, ["k"], ["i"], "v").collect()}
    versions = {r.i: r.version for r in fs.version_timeline(df, ["k"], ["i"]).collect()}
    assert [(i, pytest.approx(means[i]), versions[i]) for i, _, _ in want] == want
    assert fs.running_mean(df.limit(0), ["k"], ["i"], "v").count() == 0


def test_running_mean(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((4, 2, 9, 1))] + [("a", 4, None)], "k string, i int, v double")
    got = fs.running_mean(df, ["k"], ["i"], "v", F.floor(F.col("i") / 2)).orderBy("i").collect()
    assert [r.running_mean for r in got] == [4.0, 3.0, 5.0, 4.0, 4.0]


def test_latest_changed_and_top(spark):
    schema = "k string, ts int, v string"
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old"), (None, 1, "old")], schema)
    new = spark.createDataFrame([("a", 1, "new"), ("b", 4, "new"), ("c", 1, "new"), (None, 2, "new")], schema)
    assert rows(fs.upsert_latest(old, new, ["k"], "ts"), "k", "v") == [("a", "new"), ("b", "old"), ("c", "new"), (None, "new")]
    assert rows(fs.changed_since(new.filter("k IS NOT NULL"), old, ["k"], "ts"), "k") == [("c",)]
    many = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    assert rows(fs.top_n(many, ["k"], [F.desc("v")], 3), "v", "rank") == [(97, 3), (98, 2), (99, 1)]


def test_templates(spark):
    base = spark.createDataFrame([("t", "base"), ("u", "base")], "id string, content string")
    history = spark.createDataFrame(
        [("t", 1, "one", False), ("t", 2, "two", True), ("u", 1, "one", True), ("u", 2, "two", False)], "id string, seq int, content string, success boolean")
    assert rows(fs.effective_template(base, history), "id", "content") == [("t", "two"), ("u", "base")]
    undone = fs.rollback(history, base)
    assert undone.count() == 4 and rows(fs.effective_template(base, undone), "id", "content") == [("t", "base"), ("u", "base")]
    templates = spark.createDataFrame([("hi", "Hello {name}, you are {age} years old! {name}"), ("bye", "Bye {name} {{x}}")], "name string, template string")
    contexts = spark.createDataFrame(
        [(1, "hi", {"name": "Alice", "age": "25"}), (2, "hi", {"age": "1"}), (3, "bye", {"name": "Bo", "x": "y"})], "c int, name string, vars map<string,string>")
    done, failed = fs.render_templates(templates, contexts)
    assert rows(done, "c", "rendered") == [(1, "Hello Alice, you are 25 years old! Alice"), (3, "Bye Bo {y}")]
    assert rows(failed, "c", "missing") == [(2, "name")]


def test_prompts(spark):
    doc = ("1.0.0", {"a": {"template": "A"}}, {"active": [{"name": "b", "template": "B", "score": 0.9}, {"name": "c", "template": "C", "score": 0.8}]},
           {n: {"template": n} for n in "abcd"})
    docs = spark.createDataFrame([doc, ("2.0.0", *doc[1:])], PROMPTS_SCHEMA)
    assert rows(fs.effective_prompts(docs), "name") == [("a_optimized",), ("b_copro",), ("c",), ("d",)]


def test_names(spark):
    def names(*n):
        return spark.createDataFrame([(x,) for x in n], "name string")

    assert [r.name for r in fs.available_names(names("b", "a"), names("a"), fallback=names("z")).collect()] == ["a", "b"]
    assert [r.name for r in fs.available_names(names("x").filter("false"), fallback=names("z", "y")).collect()] == ["y", "z"]


def test_layers_example(spark):
    layers = spark.createDataFrame(
        [("t", 0, "o.strict", "true"), ("t", 0, "o.target", "ES2022"), ("t", 1, "o.module", "ESNext"), ("u", 0, "o.target", "a"), ("u", 1, "o.target", "b")],
        "tenant string, layer int, path string, value string")
    assert rows(fs.merge_layers(layers), "tenant", "path", "value") == [
        ("t", "o.module", "ESNext"), ("t", "o.strict", "true"), ("t", "o.target", "ES2022"), ("u", "o.target", "b")]


def test_layers_equal_nested_merge(spark):
    rnd = random.Random(9)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.randrange(1000)
        return {rnd.choice("abc"): tree(depth - 1) for _ in range(2)}

    def merge(base, over):
        if not (isinstance(base, dict) and isinstance(over, dict)):
            return over
        return {**base, **{k: merge(base[k], v) if k in base else v for k, v in over.items()}}

    def flat(node, path=()):
        if not isinstance(node, dict):
            return {".".join(path): str(node)}
        return {p: v for k, n in node.items() for p, v in flat(n, (*path, k)).items()}

    data, expected = [], []
    for tenant in range(12):
        merged = {}
        for layer in range(4):
            config = {"r": tree(3)}
            merged = merge(merged, config)
            data += [(tenant, layer, p, v) for p, v in flat(config).items()]
        expected += [(tenant, p, v) for p, v in flat(merged).items()]
    df = spark.createDataFrame(data, "tenant int, layer int, path string, value string")
    assert rows(fs.merge_layers(df), "tenant", "path", "value") == sorted(expected, key=repr)


def test_roll_ups(spark):
    schema = ("file_path string, findings int, warnings int, task_success boolean, model_success boolean, model_resolved int, "
              "linter_success boolean, linter_fixed int")
    outcomes = spark.createDataFrame(
        [("a", 2, 1, True, True, 2, True, 5), ("b", 2, 0, True, False, 9, True, 1), ("c", 0, 0, True, None, None, None, None)], schema)
    got = rows(fs.response_summary(outcomes), "file_path", "issues_found", "issues_fixed", "success", "patterns_learned")
    assert got == [("a", 3, 2, True, 1), ("b", 2, 1, False, 0), ("c", 0, 0, True, 0)]
    learned = outcomes.withColumn("learned_patterns", F.create_map(F.lit("x"), F.lit("y"))).withColumn("custom_prompts", F.lit(None).cast("map<string,string>"))
    assert rows(fs.response_summary(learned), "patterns_learned", "prompts_optimized") == [(1, 0)] * 3
    files = spark.createDataFrame([("f", 40.9), ("g", 10.5), ("h", -3.0)], "file_path string, improvement double")
    findings = spark.createDataFrame([("no-any",)] * 11, "rule_name string")
    summary, suggestions = fs.project_rollup(files, findings)
    assert summary.first().complexity_improvement == pytest.approx(50 / 3)
    assert rows(suggestions, "suggestion", "estimated_reduction") == [("ExtractMethod", 40), ("ReplaceWithInterface", 5)]


def test_candidates(spark):
    evals = spark.createDataFrame(
        [("p", "x", 0.5), ("p", "y", 0.9), ("p", "z", float("nan")), ("q", "u", 0.6), ("q", "i", float("inf"))], "predictor string, candidate string, score double")
    assert rows(fs.best_candidate(evals), "predictor", "candidate", "score", "global_choice") == [("p", "y", 0.9, True), ("q", "u", 0.6, False)]
    many = spark.range(30).select(F.lit("p").alias("predictor"), F.col("id").cast("string").alias("candidate"), F.col("id").cast("double").alias("score"))
    assert fs.best_candidate(many).first().top_mean == 24.5
    assert fs.best_candidate(evals.filter("false")).count() == 0


def test_predictions(spark):
    examples = spark.createDataFrame([(i, str(i % 2)) for i in range(4)], "ex_id long, expected string")
    predictions = spark.createDataFrame([(0, "0"), (1, "0"), (2, "0")], "ex_id long, actual string")
    assert fs.score_predictions(examples, predictions, ["ex_id"], F.col("actual") == F.col("expected")).first().score == 0.5

    def half(part):
        if (part["ex_id"] == 3).any():
            raise ValueError("three")
        return part["ex_id"] * 2

    got = {r.ex_id: (r.prediction, r.error) for r in fs.predict(examples, half, batch=2, result_type="long").collect()}
    assert got == {0: (0, None), 1: (2, None), 2: (4, None), 3: (None, "ValueError: three")}


def test_search(spark):
    examples = spark.range(10).select(F.col("id").alias("x"))
    candidates = spark.createDataFrame([("p", "even"), ("p", "none"), ("p", "done")], "predictor string, candidate string")
    scored = spark.createDataFrame([("p", "done", 0.1)], "predictor string, candidate string, score double")

    def answer(candidate, part):
        if candidate == "none" and (part["x"] == 4).any():
            raise ValueError
        return part["x"] % 2 == 0 if candidate == "even" else part["x"] < 0

    def metric(part, answers):
        return [float(a == (x % 2 == 0)) for a, x in zip(answers, part["x"])]

    found = fs.search_candidates(candidates, examples, answer, metric, scored)
    assert rows(found, "candidate", "score") == [("done", 0.1), ("even", 1.0), ("none", 0.5)]
    assert rows(fs.best_candidate(found), "candidate") == [("even",)]


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "d")]


def test_graph_example(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    got = {r.node: (r.fan_in, r.fan_out, r.instability) for r in fs.coupling(edges.union(edges)).collect()}
    assert got["d"] == (2, 0, 0.0) and got["c"] == (1, 2, pytest.approx(2 / 3))
    assert rows(fs.cycles(edges), "component", "node", "size") == [("a", "a", 3), ("a", "b", 3), ("a", "c", 3)]
    placed, problems = fs.levels(edges.filter("src <> 'c' OR dst <> 'a'"))
    assert rows(placed, "node", "level") == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 0)] and problems.count() == 0
    nodes = spark.createDataFrame([(n,) for n in "aabcd"], "node string")
    placed, problems = fs.levels(edges, nodes)
    assert placed.count() == 0
    assert rows(problems, "node", "problem") == [("a", "cyclic"), ("a", "duplicate"), ("b", "cyclic"), ("c", "cyclic"), ("d", "cyclic"), ("e", "unknown")]
    assert fs.cycles(edges.filter("false")).count() == 0


def test_long_paths_and_rings_take_few_rounds(spark, monkeypatch):
    """Rounds grow with the logarithm of the longest chain: counted by the tables that are written."""
    from findspan.operators import graph

    written, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(1) or cut(df))
    n = 5000
    path = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    placed, problems = fs.levels(path)
    assert placed.filter("level <> node").count() == 0 and placed.count() == n and problems.count() == 0 and len(written) < 30
    written.clear()
    ring = spark.range(300).select((F.col("id") + 10_000).alias("src"), ((F.col("id") + 1) % 300 + 10_000).alias("dst"))
    assert fs.cycles(path).count() == 0
    assert len(written) < 45
    # From the end of the path back to its middle, and a ring with nothing in or out.
    back = spark.createDataFrame([(n - 1, 2500)], "src long, dst long")
    found = fs.cycles(path.unionByName(back).unionByName(ring))
    assert rows(found.groupBy("component", "size").count(), "component", "size", "count") == [(10_000, 300, 300), (2500, 2500, 2500)]


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_equal_mutual_reachability(spark, seed):
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(24), rnd.randrange(24)) for _ in range(34)} | {(0, n) for n in range(24)}
    reach = {n: {n} for n in range(24)}
    for _ in range(24):
        for a, b in pairs:
            for seen in reach.values():
                if a in seen:
                    seen.add(b)
    expected = sorted((min(m), n, len(m)) for n in range(24) if len(m := {x for x in reach[n] if n in reach[x]}) > 1)
    got = fs.cycles(spark.createDataFrame(sorted(pairs), "src int, dst int"))
    assert sorted(tuple(r) for r in got.select("component", "node", "size").collect()) == expected


def test_references(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b.ts",), ("src/b.js",), ("lib/c.tsx",), ("src/d",), ("src/d.ts",)], "path string")
    refs = spark.createDataFrame(
        [("src/a.ts", r) for r in ("./b", "./missing", "../lib/c", "./d", "react")] + [("lib/c.tsx", "../src/a")], "path string, ref string")
    edges, unresolved = fs.resolve_edges(files, refs)
    assert rows(edges, "src", "ref", "dst") == [
        ("lib/c.tsx", "../src/a", "src/a.ts"), ("src/a.ts", "../lib/c", "lib/c.tsx"), ("src/a.ts", "./b", "src/b.ts"), ("src/a.ts", "./d", "src/d")]
    assert rows(unresolved, "ref") == [("./missing",), ("react",)]


def test_ancestry(spark):
    parents = spark.createDataFrame([("x", "y"), ("y", "z"), ("p", "q"), ("q", "p"), ("r", "p"), ("z", None)], "child string, parent string")
    chains, circular = fs.ancestry(parents)
    assert rows(chains, "child", F.array_join("chain", ">")) == [("x", "y>z"), ("y", "z")]
    assert rows(circular, "child", F.array_join("chain", ">")) == [("p", "q>p"), ("q", "p>q"), ("r", "p>q>p")]
