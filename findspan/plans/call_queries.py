"""Registered queries over events, conversations and orders: findings tables, calls, versions, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.operators import calls as C
from findspan.operators import findings as N
from findspan.operators import metrics as M
from findspan.operators import rules as R
from findspan.operators import search as S
from findspan.operators import settings as G
from findspan.operators import versions as V
from findspan.operators.running import running_mean as mean_so_far
from findspan.plans.registry import query, quoted, table


def event_findings(spark, sf) -> DataFrame:
    """Every event as a finding: its type is the rule, its user the file."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    size = F.when(F.col("value") >= 100, "large").otherwise("small")
    ext = F.when(F.col("value") < 20, ".ts").when(F.col("value") < 80, ".js").otherwise("")
    return e.select(
        kind.alias("rule_name"),
        F.concat(F.lit("User 'u"), F.col("user_id"), F.lit("' made a "), size, F.lit(" step "), F.col("event_id"),
                 F.lit(" with "), F.col("props")).alias("message"),
        F.concat(F.lit("src/u"), F.col("user_id"), ext).alias("file_path"),
        F.col("event_id").cast("int").alias("line"),
        F.lit(1).alias("column"),
        F.when(kind == "error", "Error").when(kind.isin("purchase", "signup"), "Warning").otherwise("Info").alias("severity"),
        (F.col("value") / 500.0).alias("confidence"),
        F.col("ts").alias("seen_at"),
        "event_id",
        "user_id",
    )


EVENT_FINDINGS = """(
    SELECT event_type AS rule_name,
           'User ''u' || user_id || ''' made a ' || CASE WHEN value >= 100 THEN 'large' ELSE 'small' END || ' step ' || event_id
               || ' with ' || props AS message,
           'src/u' || user_id || CASE WHEN value < 20 THEN '.ts' WHEN value < 80 THEN '.js' ELSE '' END AS file_path,
           CASE WHEN value < 20 THEN 'ts' WHEN value < 80 THEN 'js' ELSE 'unknown' END AS file_type,
           event_id AS line, 1 AS "column",
           CASE WHEN event_type = 'error' THEN 'Error' WHEN event_type IN ('purchase', 'signup') THEN 'Warning' ELSE 'Info' END AS severity,
           value / 500.0 AS confidence, ts AS seen_at, event_id, user_id
    FROM events)"""

_LITERALS = r"""regexp_replace(regexp_replace(regexp_replace(message, '''[^'']*''', '''<STRING>''', 'g'),
    '"[^"]*"', '"<STRING>"', 'g'), '\b\d+\b', '<NUMBER>', 'g')"""
TEMPLATED = f"(SELECT *, {_LITERALS} AS template, rule_name || '::' || {_LITERALS} AS pattern_id FROM {EVENT_FINDINGS})"


@query("message_template", f"SELECT event_id, template, pattern_id FROM {TEMPLATED}")
def message_template(spark, sf):
    return N.message_template(event_findings(spark, sf)).select("event_id", "template", "pattern_id")


@query("message_template_full", rf"""
SELECT event_id, rule_name || '::' || regexp_replace(template, '\b[a-zA-Z_][a-zA-Z0-9_]*\b', '<IDENTIFIER>', 'g') AS pattern_id
FROM {TEMPLATED}""")
def message_template_full(spark, sf):
    return N.message_template(event_findings(spark, sf), mode="full").select("event_id", "pattern_id")


STATS = f"""(
    SELECT pattern_id, rule_name AS rule_id, count(*) AS count, min(seen_at) AS first_seen, max(seen_at) AS last_seen,
           arg_min(message, seen_at) AS message_template, string_agg(DISTINCT file_type, ',' ORDER BY file_type) AS file_types
    FROM {TEMPLATED} GROUP BY pattern_id, rule_name)"""


@query("pattern_stats", f"""
SELECT s.*, d.severities FROM {STATS} s JOIN (
    SELECT pattern_id, string_agg(severity || '=' || n, ',' ORDER BY severity) AS severities
    FROM (SELECT pattern_id, severity, count(*) AS n FROM {TEMPLATED} GROUP BY ALL) GROUP BY pattern_id) d USING (pattern_id)""")
def pattern_stats(spark, sf):
    stats = N.pattern_stats(event_findings(spark, sf))
    pairs = F.transform(F.map_entries("severity_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return stats.withColumn("severities", F.array_join(F.array_sort(pairs), ",")).withColumn(
        "file_types", F.array_join("file_types", ",")).drop("severity_distribution")


@query("pattern_clusters", f"SELECT 'cluster_' || rule_id AS cluster_id, rule_id, pattern_id FROM {STATS}")
def pattern_clusters(spark, sf):
    return N.pattern_clusters(N.pattern_stats(event_findings(spark, sf)))


@query("propose_rules", f"""
SELECT 'adaptive_' || pattern_id AS rule_id, 'Adaptive Rule: ' || rule_id AS name,
       'AI-generated rule for pattern detected ' || count || ' times: ' || message_template AS description,
       'warning' AS severity, round((least(count / 10.0, 1) + CASE WHEN count > 1 THEN 0.8 ELSE 0.5 END) / 2, 9)::DOUBLE AS confidence,
       count AS training_examples
FROM {STATS} WHERE count >= 3 AND (least(count / 10.0, 1) + CASE WHEN count > 1 THEN 0.8 ELSE 0.5 END) / 2 >= 0.8
  AND rule_id <> 'view'""")
def propose_rules(spark, sf):
    """Patterns of the rule ``view`` are known already."""
    stats = N.pattern_stats(event_findings(spark, sf))
    known = stats.filter("rule_id = 'view'").select(F.concat(F.lit("adaptive_"), "pattern_id").alias("rule_id"))
    return N.propose_rules(stats, known)


@query("lint_metrics", f"""
SELECT rule_name, count(*) AS findings, count(DISTINCT file_path) AS files_processed,
       count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings
FROM {EVENT_FINDINGS} GROUP BY rule_name""")
def lint_metrics(spark, sf):
    return N.lint_metrics(event_findings(spark, sf), ["rule_name"])


@query("sort_findings", f"""
SELECT file_path, line, "column", rule_name FROM {EVENT_FINDINGS} ORDER BY file_path, line, "column", rule_name""")
def sort_findings(spark, sf):
    return N.sort_findings(event_findings(spark, sf)).select("file_path", "line", "column", "rule_name")


@query("combine_engines", f"""
SELECT 'first' AS source, event_id, rule_name, confidence, NULL::VARCHAR AS note FROM {EVENT_FINDINGS} WHERE severity = 'Error'
UNION ALL SELECT 'second', event_id, rule_name, NULL, message FROM {EVENT_FINDINGS} WHERE confidence > 0.5""")
def combine_engines(spark, sf):
    found = event_findings(spark, sf)
    first = found.filter("severity = 'Error'").select("event_id", "rule_name", "confidence")
    second = found.filter("confidence > 0.5").select("event_id", "rule_name", F.col("message").alias("note"))
    return N.combine_engines(first=first, second=second)


@query("only_listed", f"SELECT event_id, rule_name FROM {EVENT_FINDINGS} WHERE rule_name IN ('error', 'purchase')")
def only_listed(spark, sf):
    """Rules that ever report an error or follow an expensive event are listed."""
    found = event_findings(spark, sf)
    listed = found.filter("rule_name IN ('error', 'purchase')").select("rule_name")
    return R.only_listed(found, listed).select("event_id", "rule_name")


@query("not_yet_known", """
SELECT DISTINCT 'adaptive_' || user_id || '_' || event_type AS rule_id FROM events
EXCEPT SELECT 'adaptive_' || user_id || '_' || event_type FROM events WHERE value > 100""")
def not_yet_known(spark, sf):
    rule_id = F.concat(F.lit("adaptive_"), F.col("user_id"), F.lit("_"), F.col("event_type")).alias("rule_id")
    e = table(spark, sf, "events")
    return R.not_yet_known(e.select(rule_id).distinct(), e.filter("value > 100").select(rule_id).distinct())


@query("mistake_summary", f"""
SELECT count(*) AS total_mistakes, count(*) FILTER (rule_name IN ('error', 'click')) AS ai_generated_mistakes,
       round(coalesce(avg(confidence) FILTER (rule_name IN ('error', 'click')), 0), 6) AS average_confidence
FROM {EVENT_FINDINGS}""")
def mistake_summary(spark, sf):
    listed = spark.createDataFrame([("error",), ("click",), ("unused",)], "rule_name string")
    return N.mistake_summary(event_findings(spark, sf), listed).withColumn(
        "average_confidence", F.round("average_confidence", 6))


@query("confident", f"""
SELECT event_id, pattern_id FROM (SELECT event_id, rule_name AS pattern_id, confidence FROM {EVENT_FINDINGS})
WHERE confidence >= CASE pattern_id WHEN 'error' THEN 0.1 WHEN 'click' THEN 0.5 ELSE 0.8 END""")
def confident(spark, sf):
    predictions = event_findings(spark, sf).select("event_id", F.col("rule_name").alias("pattern_id"), "confidence")
    limits = spark.createDataFrame([("error", 0.1), ("click", 0.5)], "pattern_id string, threshold double")
    return N.confident(predictions, limits).select("event_id", "pattern_id")


@query("confident_fixes", f"SELECT event_id FROM {EVENT_FINDINGS} WHERE confidence >= 0.9")
def confident_fixes(spark, sf):
    return N.confident_fixes(event_findings(spark, sf)).select("event_id")


@query("enrich", f"""
SELECT event_id, rule_name, CASE WHEN rule_name <> 'view' THEN upper(rule_name) END AS category,
       CASE WHEN rule_name <> 'view' THEN length(rule_name) END AS cost FROM {EVENT_FINDINGS}""")
def enrich(spark, sf):
    rules = table(spark, sf, "events").filter("event_type <> 'view'").select(F.col("event_type").alias("id")).distinct().select(
        "id", F.upper("id").alias("category"), F.length("id").alias("cost"))
    return R.enrich(event_findings(spark, sf), rules, ["category", "cost"]).select("event_id", "rule_name", "category", "cost")


@query("normalize_labels", """
SELECT event_id,
       CASE event_type WHEN 'error' THEN 'Error' WHEN 'click' THEN 'Warning' WHEN 'view' THEN 'Info' WHEN 'signup' THEN 'Hint' ELSE 'Info' END AS severity,
       CASE event_type WHEN 'error' THEN 'Security' WHEN 'click' THEN 'Performance' ELSE 'house style' END AS category
FROM events""")
def normalize_labels(spark, sf):
    kind = F.col("event_type")
    raw = table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "error", "ERROR").when(kind == "click", "warn").when(kind == "view", "Info")
        .when(kind == "signup", "hint").otherwise("odd").alias("severity"),
        F.when(kind == "error", "SECURITY").when(kind == "click", "performance").otherwise("House Style").alias("category"),
    )
    return R.normalize_labels(raw, default_severity="Info")


def part_rules(spark, sf) -> DataFrame:
    """Every part as a rule of a catalogue."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_brand").alias("category"),
        F.when(F.col("p_size") < 10, "static").when(F.col("p_size") < 30, "behavioral").otherwise("hybrid").alias("kind"),
        F.col("p_size").alias("cost"),
        (F.col("p_size") > 25).alias("ai_enhanced"),
        (F.col("p_retailprice") > 950).alias("autofix"),
        F.split("p_type", " ").alias("tags"),
    )


PART_RULES = """(
    SELECT p_partkey::VARCHAR AS id, p_brand AS category, p_type, p_retailprice,
           CASE WHEN p_size < 10 THEN 'static' WHEN p_size < 30 THEN 'behavioral' ELSE 'hybrid' END AS kind,
           p_size AS cost, p_size > 25 AS ai_enhanced, p_retailprice > 950 AS autofix, string_split(p_type, ' ') AS tags
    FROM part)"""


@query("filter_rules", f"""
SELECT id, cost FROM {PART_RULES} WHERE category = 'Brand#1' AND cost <= 40 AND autofix AND list_has_any(tags, ['STANDARD', 'none'])""")
def filter_rules(spark, sf):
    kept = R.filter_rules(part_rules(spark, sf), category="Brand#1", tags=["STANDARD", "none"], max_cost=40, autofix=True)
    return kept.select("id", "cost")


@query("rule_stats", f"""
SELECT kind, category, count(*) AS rules, count(*) FILTER (ai_enhanced) AS ai_enhanced_rules,
       count(*) FILTER (autofix) AS autofix_rules FROM {PART_RULES} GROUP BY kind, category""")
def rule_stats(spark, sf):
    return R.rule_stats(part_rules(spark, sf))


@query("enabled_rules", f"""
SELECT r.id, r.category FROM {PART_RULES} r
LEFT JOIN (SELECT p_partkey::VARCHAR AS id, p_retailprice > 985 AS switched FROM part WHERE p_retailprice > 970 OR p_size = 1) i USING (id)
LEFT JOIN (SELECT p_brand AS category, avg(p_size) > 25 AS switched FROM part GROUP BY p_brand HAVING count(*) > 60) c USING (category)
WHERE coalesce(i.switched, c.switched, true)""")
def enabled_rules(spark, sf):
    part = table(spark, sf, "part")
    individual = part.filter("p_retailprice > 970 OR p_size = 1").select(
        F.col("p_partkey").cast("string").alias("rule"), (F.col("p_retailprice") > 985).alias("on"))
    by_brand = part.groupBy("p_brand").agg(F.avg("p_size").alias("size"), F.count("*").alias("n")).filter("n > 60").select(
        F.upper("p_brand").alias("category"), (F.col("size") > 25).alias("on"))
    return R.enabled_rules(part_rules(spark, sf), by_brand, individual).select("id", "category")


_KIND_BY_ROLE = "CASE role WHEN 'user' THEN 'fix' WHEN 'assistant' THEN 'analysis' WHEN 'system' THEN 'general' END"


def _provider_values() -> str:
    return ", ".join(f"({quoted(n)}, {a}, {g}, {r}, {s}, {c}, {b})" for n, a, g, r, s, c, b in C.PROVIDERS) + \
        ", ('tiny', 0.5, 0.99, 0.6, 1.0, 40, false)"


def _need(flag: int) -> str:
    kinds = [quoted(k) for k, v in C.REQUIREMENTS.items() if v[flag]]
    return f"kind IN ({', '.join(kinds)})" if kinds else "false"


@query("rank_providers", f"""
WITH requests AS (
    SELECT conv_id, turn, kind, length(text) > 400 AS google_first,
           CASE kind WHEN 'general' THEN 10000 WHEN 'optimization' THEN 50000 ELSE strlen(text) // 4 END AS context
    FROM (SELECT *, CASE WHEN turn > 4 THEN 'optimization' WHEN turn = 4 THEN 'generation' ELSE {_KIND_BY_ROLE} END AS kind FROM conversations)),
providers(provider, analysis, generation, reasoning, speed, context_length, sessions) AS (VALUES {_provider_values()}),
base AS (
    SELECT *, (CASE WHEN {_need(0)} THEN analysis * 0.3 ELSE 0 END + CASE WHEN {_need(1)} THEN generation * 0.3 ELSE 0 END
             + CASE WHEN {_need(2)} THEN reasoning * 0.3 ELSE 0 END + CASE WHEN {_need(3)} THEN speed * 0.2 ELSE 0 END)
             * CASE WHEN context > context_length THEN 0.5 ELSE 1 END
             * CASE WHEN {_need(5)} AND NOT sessions THEN 0.7 ELSE 1 END AS needed
    FROM requests, providers),
scored AS (
    SELECT *, round(CASE WHEN kind = 'general' THEN (analysis + generation + reasoning) / 3.0 ELSE needed END
              + CASE WHEN google_first AND provider = 'google' THEN 1.2 WHEN google_first AND provider = 'openai' THEN 1.1 ELSE 0 END, 6)::DOUBLE AS score
    FROM base)
SELECT conv_id, turn, provider, score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, provider)::INT AS rank,
       concat_ws(', ', CASE WHEN {_need(0)} THEN 'analysis' END, CASE WHEN {_need(1)} THEN 'generation' END,
                 CASE WHEN {_need(2)} THEN 'reasoning' END, CASE WHEN {_need(3)} THEN 'speed' END,
                 CASE WHEN NOT ({_need(0)} OR {_need(1)} OR {_need(2)}) THEN 'all-round' END,
                 CASE WHEN context > context_length THEN 'short context' END, CASE WHEN {_need(5)} AND NOT sessions THEN 'no sessions' END,
                 CASE WHEN google_first AND provider = 'google' THEN 'choice 1' WHEN google_first AND provider = 'openai' THEN 'choice 2' END) AS reason
FROM scored""")
def rank_providers(spark, sf):
    talks = table(spark, sf, "conversations")
    by_role = F.when(F.col("role") == "user", "fix").when(F.col("role") == "assistant", "analysis").otherwise("general")
    requests = talks.select(
        "conv_id", "turn",
        F.when(F.col("turn") > 4, "optimization").when(F.col("turn") == 4, "generation").otherwise(by_role).alias("kind"),
        F.col("text").alias("content"),
        F.when(F.length("text") > 400, F.array(F.lit("google"), F.lit("openai")))
        .otherwise(F.array().cast("array<string>")).alias("preferred"),
    )
    more = spark.createDataFrame(
        [("tiny", 0.5, 0.99, 0.6, 1.0, 40, False, True), ("closed", 1.0, 1.0, 1.0, 1.0, 10**6, True, False)],
        C.PROVIDER_SCHEMA + ", available boolean")
    ranked = C.rank_providers(requests, C.default_providers(spark).unionByName(more, allowMissingColumns=True))
    return ranked.select("conv_id", "turn", "provider", F.round("score", 6).alias("score"), "rank", "reason")


@query("throttle", """
WITH RECURSIVE opened AS (
    SELECT user_id, min(ts) AS window_start FROM events GROUP BY user_id
    UNION ALL
    SELECT o.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = o.user_id AND e.ts >= o.window_start + INTERVAL 1 DAY)
    FROM opened o WHERE o.window_start IS NOT NULL),
placed AS (SELECT e.event_id, e.user_id, e.ts, max(o.window_start) AS window_start
           FROM events e JOIN opened o ON o.user_id = e.user_id AND o.window_start <= e.ts GROUP BY ALL)
SELECT event_id, window_start, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) <= 2 AS accepted
FROM placed""")
def throttle(spark, sf):
    calls = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return C.throttle(calls, ["user_id"], "ts", "event_id", 2, 86400, 3 * 86400).select("event_id", "window_start", "accepted")


@query("throttle_aligned", """
SELECT event_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start,
       row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) <= 2 AS accepted FROM events""")
def throttle_aligned(spark, sf):
    calls = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return C.throttle_aligned(calls, ["user_id"], "ts", "event_id", 2, "1 day").select("event_id", "window_start", "accepted")


@query("first_success", """
WITH a AS (SELECT *, event_type <> 'error' AS success FROM events),
w AS (SELECT user_id, props, arg_max(event_id, (value, -event_id)) FILTER (success) AS winner FROM a GROUP BY user_id, props),
t AS (SELECT w.*, e.value FROM w LEFT JOIN events e ON e.event_id = w.winner)
SELECT t.user_id, t.props, t.value, t.winner AS event_id, t.winner IS NOT NULL AS succeeded,
       count(*) FILTER (NOT a.success AND (t.winner IS NULL OR a.value > t.value OR (a.value = t.value AND a.event_id < t.winner))) AS failures_before,
       CASE WHEN t.winner IS NULL THEN string_agg(a.event_type || a.event_id, '|' ORDER BY a.value DESC, a.event_id) END AS errors
FROM t JOIN a ON a.user_id = t.user_id AND a.props = t.props GROUP BY t.user_id, t.props, t.value, t.winner""")
def first_success(spark, sf):
    """Events of a user with the same properties are attempts at one request."""
    attempts = table(spark, sf, "events").withColumns(
        {"success": F.col("event_type") != "error", "message": F.concat("event_type", "event_id")})
    tried = C.first_success(attempts, ["user_id", "props"], "value", "success", "event_id", error="message")
    return tried.withColumn("errors", F.array_join("errors", "|"))


@query("usage_rollup", """
WITH c AS (SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN strlen(text) // 4 ELSE 0 END AS i,
                  CASE WHEN role = 'assistant' THEN strlen(text) // 4 ELSE 0 END AS o,
                  CASE WHEN role = 'assistant' AND turn > 2 THEN length(text) END AS r,
                  CASE role WHEN 'assistant' THEN 'claude' WHEN 'system' THEN 'gpt4' END AS provider FROM conversations)
SELECT conv_id, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(i + o + coalesce(r, 0))::BIGINT AS total_tokens,
       sum(r)::BIGINT AS reasoning_tokens, arg_min(provider, turn) FILTER (provider IS NOT NULL) AS provider,
       sum(10 * turn)::BIGINT AS execution_time_ms, round(coalesce(sum(o) / nullif(sum(i), 0), 0), 9) AS efficiency
FROM c GROUP BY conv_id""")
def usage_rollup(spark, sf):
    talks = table(spark, sf, "conversations")
    tokens = F.floor(F.octet_length("text") / 4)
    answer = F.col("role") == "assistant"
    calls = talks.select(
        "conv_id", F.col("turn").alias("ord"),
        F.when(answer, 0).otherwise(tokens).alias("input_tokens"),
        F.when(answer, tokens).otherwise(0).alias("output_tokens"),
        F.when(answer & (F.col("turn") > 2), F.length("text").cast("long")).alias("reasoning_tokens"),
        F.when(answer, "claude").when(F.col("role") == "system", "gpt4").alias("provider"),
        (F.col("turn") * 10).alias("execution_time_ms"),
    )
    rolled = C.usage_rollup(C.with_total_tokens(calls), ["conv_id"])
    return rolled.withColumn("efficiency", F.round("efficiency", 9))


@query("run_summary", """
SELECT user_id, count(*) AS usage_count, round(avg(value), 6) AS avg_execution_time,
       round(count(*) FILTER (event_type <> 'error') / count(*), 9) AS success_rate, max(ts) AS last_used
FROM events GROUP BY user_id""")
def run_summary(spark, sf):
    runs = table(spark, sf, "events").select(
        "user_id", F.col("value").alias("execution_time"), (F.col("event_type") != "error").alias("success"), F.col("ts").alias("at"))
    return C.run_summary(runs, ["user_id"]).withColumns(
        {"avg_execution_time": F.round("avg_execution_time", 6), "success_rate": F.round("success_rate", 9)})


@query("hit_rate", """
SELECT user_id, count(*) AS operations, count(*) FILTER (event_type IN ('view', 'click')) AS hits,
       round(count(*) FILTER (event_type IN ('view', 'click')) * 100.0 / count(*), 6) AS hit_rate FROM events GROUP BY user_id""")
def hit_rate(spark, sf):
    rate = C.hit_rate(table(spark, sf, "events"), F.col("event_type").isin("view", "click"), ["user_id"], percent=True)
    return rate.withColumn("hit_rate", F.round("hit_rate", 6))


_KINDS = ", ".join(f"({i}, {quoted(k)}, {str(r).lower()}, {quoted(s)}, {quoted(c)})" for i, (k, r, s, c) in enumerate(C.ERROR_KINDS))


@query("error_rollup", f"""
WITH kinds(i, kind, recoverable, severity, category) AS (VALUES {_KINDS})
SELECT event_type, kind, count(*) AS errors, recoverable, severity, category
FROM events JOIN kinds ON i = least(floor(value * 22 / 500)::INT, 21) GROUP BY ALL""")
def error_rollup(spark, sf):
    names = F.array(*[F.lit(k) for k, *_ in C.ERROR_KINDS])
    errors = table(spark, sf, "events").select(
        "event_type", F.get(names, F.least(F.floor(F.col("value") * 22 / 500).cast("int"), F.lit(21))).alias("kind"))
    return C.error_rollup(errors, C.error_kinds(spark), ["event_type"])


_MESSAGES = """(SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role,
    CASE WHEN role = 'system' THEN 'Invalid role ''tool'', defaulting to user: ' || text ELSE text END AS content FROM conversations)"""


def _tool_talks(spark, sf):
    """Conversations whose system turns come as an unknown role."""
    return table(spark, sf, "conversations").withColumn(
        "role", F.when(F.col("role") == "system", "tool").otherwise(F.col("role")))


@query("assemble_conversations", f"""
SELECT conv_id, turn // 2 AS part, count(*) AS turns,
       to_json(list({{'role': role, 'content': content}} ORDER BY turn))::VARCHAR AS json FROM {_MESSAGES} GROUP BY conv_id, turn // 2""")
def assemble_conversations(spark, sf):
    """Every row holds two turns."""
    done = C.assemble_conversations(_tool_talks(spark, sf), ["conv_id"], part_size=2)
    return done.select("conv_id", "part", F.size("messages").cast("long").alias("turns"), "json")


@query("parse_conversations", f"""
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, role, content FROM {_MESSAGES}""")
def parse_conversations(spark, sf):
    """To JSON, in rows of three turns, and back in order."""
    done = C.assemble_conversations(_tool_talks(spark, sf), ["conv_id"], part_size=3)
    return C.parse_conversations(done.select("conv_id", "part", "json"), ["conv_id"], part="part")


@query("best_candidate", """
WITH e AS (SELECT event_type AS predictor, user_id::VARCHAR AS candidate,
                  CASE WHEN count(*) < 5 THEN 'nan'::DOUBLE WHEN event_type = 'view' THEN max(value) ELSE max(value) / 2 END AS score
           FROM events GROUP BY event_type, user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY predictor ORDER BY score DESC, candidate) AS k FROM e WHERE NOT isnan(score)),
b AS (SELECT predictor, max(candidate) FILTER (k = 1) AS candidate, max(score) AS score, avg(score) AS top_mean
      FROM r WHERE k <= 10 GROUP BY predictor)
SELECT predictor, candidate, score, round(top_mean, 6) AS top_mean,
       score > (SELECT avg(score) FROM b) * 1.1 AND predictor = (SELECT predictor FROM b ORDER BY score DESC, predictor LIMIT 1) AS global_choice
FROM b""")
def best_candidate(spark, sf):
    best = F.when(F.count("*") < 5, float("nan")).when(F.col("event_type") == "view", F.max("value")).otherwise(F.max("value") / 2)
    evals = table(spark, sf, "events").groupBy("event_type", "user_id").agg(best.alias("score")).select(
        F.col("event_type").alias("predictor"), F.col("user_id").cast("string").alias("candidate"), "score")
    return S.best_candidate(evals).withColumn("top_mean", F.round("top_mean", 6))


_FILES = """(SELECT o_orderkey::VARCHAR AS file_path, o_totalprice / 5000 - 20 AS improvement, o_orderstatus AS project FROM orders)"""


@query("project_rollup", f"""
SELECT project, count(*) AS files_analyzed, round(sum(greatest(trunc(improvement), 0)) / count(*), 6) AS complexity_improvement
FROM {_FILES} GROUP BY project""")
def project_rollup(spark, sf):
    summary, _ = M.project_rollup(*_project(spark, sf), ["project"])
    return summary.withColumn("complexity_improvement", F.round("complexity_improvement", 6))


@query("project_suggestions", f"""
SELECT project, 'ExtractMethod' AS suggestion, file_path, trunc(improvement)::BIGINT AS estimated_reduction, 0.85::DOUBLE AS confidence
FROM {_FILES} WHERE improvement > 30
UNION ALL
SELECT project, 'ReplaceWithInterface', NULL, floor(n * 0.5)::BIGINT, 0.9 FROM (
    SELECT o_orderstatus AS project, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1-%' GROUP BY 1) WHERE n > 10""")
def project_suggestions(spark, sf):
    _, suggestions = M.project_rollup(*_project(spark, sf), ["project"])
    return suggestions


def _project(spark, sf):
    """Orders as files, urgent orders as findings about ``any``."""
    o = table(spark, sf, "orders")
    files = o.select(F.col("o_orderkey").cast("string").alias("file_path"), (F.col("o_totalprice") / 5000 - 20).alias("improvement"),
                     F.col("o_orderstatus").alias("project"))
    rule = F.when(F.col("o_orderpriority").startswith("1-"), "no-explicit-any").otherwise("other")
    return files, o.select(F.col("o_orderstatus").alias("project"), rule.alias("rule_name"))


@query("response_summary", """
SELECT l_orderkey, findings + warnings AS issues_found,
       CASE WHEN model_success THEN resolved WHEN linter_success THEN fixed ELSE 0 END AS issues_fixed,
       task_success AND CASE WHEN model_success THEN resolved WHEN linter_success THEN fixed ELSE 0 END >= findings AS success
FROM (SELECT l_orderkey, count(*) AS findings, count(*) FILTER (l_returnflag = 'R') AS warnings, bool_or(l_linestatus = 'F') AS task_success,
             max(l_discount) > 0.08 AS model_success, sum(l_linenumber)::BIGINT AS resolved, min(l_tax) < 0.02 AS linter_success,
             count(DISTINCT l_suppkey) AS fixed FROM lineitem GROUP BY l_orderkey)""")
def response_summary(spark, sf):
    outcomes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("findings"), F.count_if(F.col("l_returnflag") == "R").alias("warnings"),
        F.bool_or(F.col("l_linestatus") == "F").alias("task_success"), (F.max("l_discount") > 0.08).alias("model_success"),
        F.sum("l_linenumber").alias("model_resolved"), (F.min("l_tax") < 0.02).alias("linter_success"),
        F.countDistinct("l_suppkey").alias("linter_fixed"),
    )
    return M.response_summary(outcomes).select("l_orderkey", "issues_found", "issues_fixed", "success")


@query("top_n", """
SELECT event_type, event_id, value, k::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 10""")
def top_n(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "value")
    return V.top_n(e, ["event_type"], [F.desc("value"), F.asc("event_id")], 10)


def _changes(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "major").when(F.col("event_type") == "signup", "minor").otherwise("patch")
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value", kind.alias("change"))


TIMELINE_SQL = """
WITH c AS (SELECT event_id, user_id, ts, sum((event_type = 'purchase')::INT) OVER w AS majors,
                  (event_type = 'signup')::INT AS minor, (event_type NOT IN ('purchase', 'signup'))::INT AS patch
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, sum(minor) OVER (PARTITION BY user_id, majors ORDER BY ts, event_id) AS minors FROM c)
SELECT event_id, user_id, (majors + 1) || '.' || minors || '.' ||
       sum(patch) OVER (PARTITION BY user_id, majors, minors ORDER BY ts, event_id) AS version FROM m"""


@query("version_timeline", TIMELINE_SQL)
def version_timeline(spark, sf):
    timeline = V.version_timeline(_changes(spark, sf), ["user_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"))
    return timeline.select("event_id", "user_id", "version")


@query("version_timeline_ranges", TIMELINE_SQL)
def version_timeline_ranges(spark, sf):
    """Without a bucket: the rows are dealt by range."""
    return V.version_timeline(_changes(spark, sf), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "version")


MEAN_SQL = """
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1e-9, 6) AS running_mean FROM events"""


@query("running_mean", MEAN_SQL)
def running_mean(spark, sf):
    means = mean_so_far(_changes(spark, sf), ["user_id"], ["ts", "event_id"], "value", F.date_trunc("hour", "ts"))
    return means.select("event_id", F.round(F.col("running_mean") + 1e-9, 6).alias("running_mean"))


@query("running_mean_ranges", MEAN_SQL)
def running_mean_ranges(spark, sf):
    """Without a bucket: the rows are dealt by range."""
    means = mean_so_far(_changes(spark, sf), ["user_id"], ["ts", "event_id"], "value")
    return means.select("event_id", F.round(F.col("running_mean") + 1e-9, 6).alias("running_mean"))


def _history(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("props").alias("content"), (F.col("value") > 20).alias("success"))


def _base(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("content"))


@query("effective_template", """
SELECT c_custkey AS id, CASE WHEN h.success THEN h.props ELSE c_name END AS content, coalesce(h.success, false) AS optimized
FROM customer LEFT JOIN (SELECT user_id, arg_max(props, event_id) AS props, arg_max(value, event_id) > 20 AS success FROM events GROUP BY 1) h
  ON h.user_id = c_custkey""")
def effective_template(spark, sf):
    return V.effective_template(_base(spark, sf), _history(spark, sf))


@query("rollback", """
SELECT c_custkey AS id, CASE WHEN h.success THEN h.props ELSE c_name END AS content, coalesce(h.success, false) AS optimized
FROM customer LEFT JOIN (
    SELECT user_id, arg_max(props, event_id) AS props, arg_max(value, event_id) > 20 AND max(value) <= 200 AS success FROM events GROUP BY 1) h
  ON h.user_id = c_custkey""")
def rollback(spark, sf):
    """Users who ever spent more than 200 are rolled back."""
    ids = table(spark, sf, "events").filter("value > 200").select(F.col("user_id").alias("id"))
    return V.effective_template(_base(spark, sf), V.rollback(_history(spark, sf), ids))


@query("upsert_latest", """
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY user_id, event_type""")
def upsert_latest(spark, sf):
    """Cheap events are the table, dear ones the updates."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    merged = V.upsert_latest(e.filter("value <= 50"), e.filter("value > 50"), ["user_id", "event_type"], "ts")
    return merged.select("user_id", "event_type", "event_id", "value")


@query("changed_since", """
SELECT e.event_id FROM events e LEFT JOIN (
    SELECT user_id, event_type, max(ts) AS seen FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type <> 'view' GROUP BY 1, 2) s USING (user_id, event_type)
WHERE s.seen IS NULL OR e.ts > s.seen""")
def changed_since(spark, sf):
    e = table(spark, sf, "events")
    snapshot = e.filter("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00' AND event_type <> 'view'")
    return V.changed_since(e, snapshot, ["user_id", "event_type"], "ts").select("event_id")


@query("available_names", """
SELECT event_type AS name FROM events UNION SELECT lang FROM documents UNION SELECT role FROM conversations""")
def available_names(spark, sf):
    layers = [table(spark, sf, t).select(F.col(c).alias("name")) for t, c in
              (("events", "event_type"), ("documents", "lang"), ("conversations", "role"))]
    return V.available_names(*layers, fallback=table(spark, sf, "nation").select(F.col("n_name").alias("name")))


@query("available_names_fallback", "SELECT DISTINCT n_name AS name FROM nation")
def available_names_fallback(spark, sf):
    none = table(spark, sf, "events").filter("value < 0").select(F.col("event_type").alias("name"))
    return V.available_names(none, fallback=table(spark, sf, "nation").select(F.col("n_name").alias("name")))


@query("effective_prompts", """
WITH u AS (SELECT user_id, event_type AS name, max(value) AS best, max(value) / 500 AS score,
                  max(props) AS props FROM events GROUP BY 1, 2)
SELECT user_id, name || '_optimized' AS name, 'opt ' || props AS template FROM u WHERE best > 200
UNION ALL SELECT user_id, name || '_copro', 'cand ' || props FROM u WHERE score > 0.8
UNION ALL SELECT user_id, name, 'base ' || props FROM u WHERE best <= 200 AND score <= 0.8""")
def effective_prompts(spark, sf):
    """One prompt document per user."""
    best = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.max("value").alias("best"), F.max("props").alias("props"))

    def prompts(prefix, condition=None):
        entry = F.struct(F.col("event_type"), F.struct(F.concat(F.lit(prefix), F.col("props")).alias("template")))
        return F.map_from_entries(F.collect_list(entry if condition is None else F.when(condition, entry)))

    candidate = F.struct(F.col("event_type").alias("name"), F.concat(F.lit("cand "), F.col("props")).alias("template"),
                         (F.col("best") / 500).alias("score"))
    docs = best.groupBy("user_id").agg(
        F.lit("1.2.0").alias("version"),
        prompts("opt ", F.col("best") > 200).alias("optimized_prompts"),
        F.struct(F.collect_list(candidate).alias("active")).alias("copro_candidates"),
        prompts("base ").alias("base_prompts"),
    )
    return V.effective_prompts(docs, ["user_id"])


@query("render_templates", """
SELECT event_id, CASE WHEN event_type <> 'view' THEN
           'Hello u' || user_id || ', ' || event_type || ' worth ' || props || '! u' || user_id END AS rendered,
       CASE WHEN event_type = 'view' THEN 'value' END AS missing FROM events""")
def render_templates(spark, sf):
    e = table(spark, sf, "events")
    templates = e.select(F.col("event_type").alias("name")).distinct().withColumn(
        "template", F.concat(F.lit("Hello {user}, "), F.col("name"), F.lit(" worth {value}! {user}")))
    user = F.create_map(F.lit("user"), F.concat(F.lit("u"), F.col("user_id")))
    both = F.map_concat(user, F.create_map(F.lit("value"), F.col("props")))
    contexts = e.select("event_id", F.col("event_type").alias("name"),
                        F.when(F.col("event_type") == "view", user).otherwise(both).alias("vars"))
    rendered, failed = V.render_templates(templates, contexts)
    return rendered.select("event_id", "rendered", F.lit(None).cast("string").alias("missing")).unionByName(
        failed.select("event_id", F.lit(None).cast("string").alias("rendered"), "missing"))


_SETTINGS = r"""(
    SELECT user_id AS tenant, event_id AS layer, value::VARCHAR AS value,
           CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'view.' || regexp_extract(props, '\d+')
                WHEN 'error' THEN 'view.' || regexp_extract(props, '\d+') || '.deep' ELSE event_type || '.' || regexp_extract(props, '\d') END AS path
    FROM events)"""


@query("merge_layers", f"""
WITH s AS (SELECT tenant, path, arg_max(value, layer) AS value, max(layer) AS layer FROM {_SETTINGS} GROUP BY tenant, path)
SELECT tenant, path, value, layer FROM s WHERE NOT EXISTS (
    SELECT 1 FROM s o WHERE o.tenant = s.tenant AND o.layer > s.layer
       AND (starts_with(s.path, o.path || '.') OR starts_with(o.path, s.path || '.')))""")
def merge_layers(spark, sf):
    """Every event sets one path of its user's settings, later events in higher layers."""
    e, kind = table(spark, sf, "events"), F.col("event_type")
    number = F.regexp_extract("props", r"\d+", 0)
    path = (
        F.when(kind == "view", "view")
        .when(kind == "click", F.concat(F.lit("view."), number))
        .when(kind == "error", F.concat(F.lit("view."), number, F.lit(".deep")))
        .otherwise(F.concat(kind, F.lit("."), F.regexp_extract("props", r"\d", 0)))
    )
    layers = e.select(F.col("user_id").alias("tenant"), F.col("event_id").alias("layer"), path.alias("path"),
                      F.col("value").cast("string").alias("value"))
    return G.merge_layers(layers)


@query("effective_settings", """
SELECT 'region/' || r_regionkey AS file, 'a' AS path, r_name AS value FROM region
UNION ALL SELECT 'region/' || r_regionkey, 'b|x', r_regionkey::VARCHAR FROM region
UNION ALL SELECT 'nation/' || n_nationkey, 'a', r_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'nation/' || n_nationkey, 'b', n_name FROM nation
UNION ALL SELECT 'customer/' || c_custkey, 'a', r_name FROM customer JOIN region ON r_regionkey = c_custkey % 5
UNION ALL SELECT 'customer/' || c_custkey, 'b|x', (c_custkey % 5)::VARCHAR FROM customer
UNION ALL SELECT 'customer/' || c_custkey, 'b|y', c_mktsegment FROM customer WHERE c_custkey % 2 = 0""")
def effective_settings(spark, sf):
    """Customers build on their nation, which builds on its region, and then on another region."""
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))

    def name(kind, key):
        return F.concat(F.lit(kind + "/"), key)

    r, n, c = name("region", F.col("r_regionkey")), name("nation", F.col("n_nationkey")), name("customer", F.col("c_custkey"))
    none = F.array().cast("array<string>")
    files = (
        region.select(r.alias("file"), none.alias("extends"))
        .unionByName(nation.select(n.alias("file"), F.array(name("region", F.col("n_regionkey"))).alias("extends")))
        .unionByName(customer.select(
            c.alias("file"), F.array(name("nation", F.col("c_nationkey")), name("region", F.col("c_custkey") % 5)).alias("extends")))
    )

    def setting(df, file, path, value):
        return df.select(file.alias("file"), F.lit(path).alias("path"), F.col(value).cast("string").alias("value"))

    settings = (
        setting(region, r, "a", "r_name").unionByName(setting(region, r, "b|x", "r_regionkey"))
        .unionByName(setting(nation, n, "b", "n_name"))
        .unionByName(setting(customer.filter("c_custkey % 2 = 0"), c, "b|y", "c_mktsegment"))
    )
    merged, _ = G.effective_settings(files, settings, separator="|")
    return merged
