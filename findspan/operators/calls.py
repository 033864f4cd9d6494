"""Model calls: provider ranking, rate limits, fallbacks, usage, runs, errors and conversations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findspan.functions.ordered import first_at_least, window_starts
from findspan.functions.scoring import ratio
from findspan.functions.text import sql_text
from findspan.session import cut_lineage

PROVIDER_SCHEMA = (
    "name string, code_analysis double, code_generation double, complex_reasoning double, "
    "speed double, context_length long, supports_sessions boolean"
)

# The shipped provider table.
PROVIDERS = [
    ("claude", 0.95, 0.85, 0.95, 0.75, 200000, True),
    ("google", 0.80, 0.80, 0.85, 0.90, 100000, True),
    ("openai", 0.88, 0.95, 0.85, 0.85, 200000, True),
]

# What a request of each kind needs.
# kind: analysis, generation, reasoning, speed, fixed context size (None = from the content), sessions
REQUIREMENTS = {
    "fix": (True, True, True, False, None, False),
    "optimization": (False, False, True, False, 50000, True),
    "generation": (False, True, False, True, None, False),
    "analysis": (True, False, True, False, None, False),
    "general": (False, False, False, True, 10000, False),
}

# Error kind -> recoverable, severity, category.
ERROR_KINDS = [
    ("ClaudeCli", True, "Warning", "claude_cli"),
    ("AIExecution", True, "Warning", "ai_execution"),
    ("Serialization", False, "Error", "serialization"),
    ("Io", True, "Warning", "io"),
    ("MoonHost", False, "Critical", "moon_host"),
    ("Config", False, "Error", "config"),
    ("Analysis", True, "Info", "analysis"),
    ("Wasm", False, "Critical", "wasm"),
    ("MoonPdk", True, "Warning", "moon_pdk"),
    ("PatternDetection", True, "Info", "pattern_detection"),
    ("CoproOptimization", True, "Info", "copro_optimization"),
    ("Timeout", True, "Warning", "timeout"),
    ("Validation", False, "Error", "validation"),
    ("Multiple", True, "Warning", "multiple"),
    ("DataAccess", True, "Warning", "data_access"),
    ("DataParsing", False, "Error", "data_parsing"),
    ("DataSerialization", False, "Error", "data_serialization"),
    ("DataValidation", False, "Error", "data_validation"),
    ("StdError", True, "Warning", "std_error"),
    ("Processing", True, "Warning", "processing"),
    ("Storage", True, "Error", "storage"),
    ("WorkflowError", True, "Warning", "workflow"),
]

# Known roles, and the note about another one.
ROLES = ("system", "user", "assistant")
ROLE_NOTE = ("Invalid role '", "', defaulting to user: ")


def default_providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, PROVIDER_SCHEMA)


def error_kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERROR_KINDS, "kind string, recoverable boolean, severity string, category string")


_KIND = "coalesce(kind, 'general')"


def _needs(which: int) -> str:
    """SQL condition for a requirement of a request; unknown kinds count as general."""
    by_flag = {flag: [sql_text(k) for k, needs in REQUIREMENTS.items() if needs[which] is flag] for flag in (True, False)}
    if sql_text("general") in by_flag[True]:
        return f"{_KIND} NOT IN ({', '.join(by_flag[False])})"
    return f"{_KIND} IN ({', '.join(by_flag[True])})"


def _context_size() -> str:
    fixed = {k: needs[4] for k, needs in REQUIREMENTS.items()}
    cases = " ".join(
        f"WHEN {sql_text(k)} THEN {'floor(octet_length(content) / 4)' if size is None else size}" for k, size in fixed.items())
    return f"(CASE {_KIND} {cases} ELSE {fixed['general']} END)"


def ranked_providers(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Add ``ranked``: the providers for a request, best first, as (``provider``, ``score``, ``reason``).

    The provider table becomes one array (a scalar subquery) that each request scores in its own
    row: one sort of that array, without a cross join, window or shuffle, whatever the number of
    providers. A provider whose ``available`` is false is not a choice; the table may lack the column.
    ``requests`` has ``kind``, ``content`` and ``preferred`` (names, best first).
    """
    usable = providers if "available" not in providers.columns else providers.filter(F.coalesce("available", F.lit(True)))
    fields = ("name", "code_analysis", "code_generation", "complex_reasoning", "speed", "context_length", "supports_sessions")
    every = usable.agg(F.array_sort(F.collect_list(F.struct(*fields)))).scalar()
    analysis, generation, reasoning, speed, sessions = (_needs(i) for i in (0, 1, 2, 3, 5))

    def scored(p: str, of: str) -> str:
        def when(condition: str, value: str, otherwise: str = "0.0D") -> str:
            return f"IF({condition}, {value}, {otherwise})"

        capable = " + ".join(
            (when(f"{of}.analysis", f"{p}.code_analysis * 0.3D"), when(f"{of}.generation", f"{p}.code_generation * 0.3D"),
             when(f"{of}.reasoning", f"{p}.complex_reasoning * 0.3D"), when(f"{of}.speed", f"{p}.speed * 0.2D")))
        short = f"{of}.context > {p}.context_length"
        unkept = f"{of}.sessions AND NOT {p}.supports_sessions"
        score = f"({capable}) * {when(short, '0.5D', '1.0D')} * {when(unkept, '0.7D', '1.0D')}"
        average = f"({p}.code_analysis + {p}.code_generation + {p}.complex_reasoning) / 3.0D"
        place = f"coalesce(array_position({of}.preferred, {p}.name), 0)"
        boost = f"IF({place} > 0, 1.0D + (size({of}.preferred) - {place} + 1) * 0.1D, 0.0D)"
        why = ", ".join(
            (when(f"{of}.analysis", "'analysis'", "NULL"), when(f"{of}.generation", "'generation'", "NULL"),
             when(f"{of}.reasoning", "'reasoning'", "NULL"), when(f"{of}.speed", "'speed'", "NULL"),
             when(f"NOT {of}.needed", "'all-round'", "NULL"), when(short, "'short context'", "NULL"),
             when(unkept, "'no sessions'", "NULL"), f"IF({place} > 0, concat('choice ', {place}), NULL)"))
        return (f"named_struct('order', -round(IF({of}.needed, {score}, {average}) + {boost}, 9), "
                f"'provider', {p}.name, 'reason', concat_ws(', ', {why}))")

    needs = (f"named_struct('analysis', {analysis}, 'generation', {generation}, 'reasoning', {reasoning}, 'speed', {speed}, "
             f"'sessions', {sessions}, 'context', {_context_size()}, 'preferred', preferred, "
             f"'needed', ({analysis}) OR ({generation}) OR ({reasoning}))")
    sorted_choices = f"array_sort(transform(__every, p -> {scored('p', '__needs')}))"
    return (
        requests.withColumns({"__every": every, "__needs": F.expr(needs)})
        .withColumn("__choices", F.expr(sorted_choices))
        .withColumn("ranked", F.expr(
            "transform(__choices, c -> named_struct('provider', c.provider, 'score', -c.order, 'reason', c.reason))"))
        .drop("__every", "__needs", "__choices")
    )


def rank_providers(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """One row per request and usable provider with ``score``, ``rank`` and ``reason``: :func:`ranked_providers`
    laid out. Where the best few are enough, take them from the array instead."""
    ranked = ranked_providers(requests, providers).select("*", F.posexplode("ranked").alias("__place", "__choice"))
    return ranked.select(
        *requests.columns, "__choice.provider", "__choice.score", (F.col("__place") + 1).alias("rank"), "__choice.reason"
    )


def micros_of(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column, without time-zone shifts for zone-less ones."""
    at = F.col(ts)
    if df.schema[ts].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(at)
    clock = F.hour(at) * 3600 + F.minute(at) * 60
    seconds = F.unix_date(F.to_date(at)).cast("long") * 86400 + clock
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


# Calls of one pandas frame, about.
FRAME_ROWS = 250_000
# Stretches of time that are composed to one.
FAN = 64


def _ordered_moments(part: pd.DataFrame, width: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Moments by key, stretch and time; the number of each one's group; where groups begin; and for each moment the index of
    the first one of its group at least ``width`` later (-1 if none)."""
    part = part.sort_values(["__id", "__stretch", "__at"], ignore_index=True)
    ids, number, at = part["__id"].to_numpy(), part["__stretch"].to_numpy(), part["__at"].to_numpy()
    first = np.append(True, (ids[1:] != ids[:-1]) | (number[1:] != number[:-1]))
    group = np.cumsum(first) - 1
    return part, group, first, first_at_least(group, at, group, at + width)


def _accept_first(calls: DataFrame, window: str, at: str, tie: str, per_window: int) -> DataFrame:
    """Add ``accepted`` for the first calls of each window, and ``__opening``, its first ``at``.

    Only the first few calls of a window are ranked (each task passes on that many per window);
    every other call is compared with the last accepted one. A window may hold any share of all
    calls: its rows stay spread over the tasks.
    """
    order = W.partitionBy(window).orderBy(at, tie)
    early = calls.select(window, at, tie).withColumn("__place", F.row_number().over(order))
    cuts = early.filter(F.col("__place") <= max(per_window, 1)).groupBy(window).agg(
        F.max(F.struct(at, tie)).alias("__cut"), F.min(at).alias("__opening"))
    inside = F.struct(at, tie) <= F.col("__cut")
    return calls.join(cuts, window).withColumn("accepted", inside & F.lit(per_window > 0)).drop("__cut")


def throttle_aligned(
    calls: DataFrame, keys: Sequence[str], ts: str, tie: str, per_window: int = 20, window: str = "60 seconds"
) -> DataFrame:
    """Accept the first ``per_window`` calls of each clock-aligned window per key; ``tie`` tells calls of a key apart.
    Calls without a time are rejected and have no window."""
    opened = calls.filter(F.col(ts).isNotNull()).withColumn("window_start", F.window(F.col(ts), window)["start"])
    start_type = opened.schema["window_start"].dataType
    untimed = calls.filter(F.col(ts).isNull()).select("*", F.lit(None).cast(start_type).alias("window_start"), F.lit(False).alias("accepted"))
    marked = _accept_first(opened.withColumn("__window", F.struct(*keys, "window_start")), "__window", ts, tie, per_window)
    return marked.select(*calls.columns, "window_start", "accepted").unionByName(untimed)


def throttle(
    calls: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    per_window: int = 20,
    window_seconds: int = 60,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Accept at most ``per_window`` calls per window, where a window opens at the first call at
    least ``window_seconds`` after the last window opened. ``tie`` tells calls of a key apart.

    Where windows open depends on the whole past of a key, but a stretch of time is a small
    function of it: given when the last window before the stretch opened, which one is the last
    inside? Each (key, stretch) is summarised to that function in parallel. Neighbouring functions of a key are
    composed, ``FAN`` at a time, until one function is left, and on the way back each part of a composition gets the window that is open
    before it; so the longest history takes a few rounds, and no task walks through a key. The windows inside each
    stretch then follow independently. Many stretches share one pandas frame of about ``FRAME_ROWS`` calls. Calls without a
    time are rejected and have no window.
    """
    width = int(window_seconds * 1_000_000)
    stretch = int((bucket_seconds or max(window_seconds * 60, 1)) * 1_000_000)
    # The key travels as text so that any key type passes through pandas unchanged.
    timed = calls.withColumns({"__id": F.to_json(F.struct(*keys)), "__at": micros_of(calls, ts)})
    size, begin, end = timed.agg(F.count("__at"), F.min("__at"), F.max("__at")).first()
    chunks = max(4 * int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // FRAME_ROWS + 1)
    begin = begin or 0
    number = F.expr(f"(__at - {begin}L) div {stretch}L")
    moments = timed.filter("__at is not null").select("__id", "__at").distinct().withColumn("__stretch", number)

    def chunk(*columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(chunks)).alias("__chunk")

    def steps(part: pd.DataFrame, leave: np.ndarray, group: np.ndarray, first: np.ndarray, length: int) -> pd.DataFrame:
        # Only moments that can follow a window from before the stretch are entries: those of
        # its first window length and one more.
        early = part["entry"].to_numpy() - begin - part["__stretch"].to_numpy() * length < width
        entry = early | first | np.append(False, early[:-1])
        part, leave, group = part[entry], leave[entry], group[entry]
        # Neighbouring entries with the same outcome are one step of the function, kept as its last.
        step = np.append((leave[1:] != leave[:-1]) | (group[1:] != group[:-1]), True)
        return part.assign(leave=leave)[step][["__id", "__stretch", "entry", "leave"]]

    def summarise(part: pd.DataFrame) -> pd.DataFrame:
        part, group, first, after = _ordered_moments(part, width)
        at = part["__at"].to_numpy()
        last = np.where(after < 0, np.arange(len(part)), after)
        while not np.array_equal(last[last], last):
            last = last[last]
        return steps(part.rename(columns={"__at": "entry"}), at[last], group, first, stretch)

    def compose(part: pd.DataFrame, length: int) -> pd.DataFrame:
        """The functions of neighbouring stretches as one of the stretch of ``length`` that they make up."""
        part = part.assign(__stretch=part["__stretch"] // FAN).sort_values(["__id", "__stretch", "entry"], ignore_index=True)
        ids, number = part["__id"].to_numpy(), part["__stretch"].to_numpy()
        first = np.append(True, (ids[1:] != ids[:-1]) | (number[1:] != number[:-1]))
        group, entry, leave = np.cumsum(first) - 1, part["entry"].to_numpy(), part["leave"].to_numpy()
        after = first_at_least(group, entry, group, leave + width)
        last = np.where(after < 0, np.arange(len(part)), after)
        while not np.array_equal(last[last], last):
            last = last[last]
        return steps(part, leave[last], group, first, length)

    def enter(part: pd.DataFrame) -> pd.DataFrame:
        """The window that is open before each of the parts of a composition, from the one open before all (``opened``, null for none)."""
        part = part.assign(__above=part["__stretch"] // FAN).sort_values(["__id", "__above", "entry"], ignore_index=True)
        ids, above, number = (part[c].to_numpy() for c in ("__id", "__above", "__stretch"))
        first = np.append(True, (ids[1:] != ids[:-1]) | (above[1:] != above[:-1]))
        group, entry, leave = np.cumsum(first) - 1, part["entry"].to_numpy(), part["leave"].to_numpy()
        known = part["opened"].notna().to_numpy()
        opened = part["opened"].fillna(0).to_numpy("int64")
        begins = np.flatnonzero(first)
        front = np.where(known[begins], first_at_least(group, entry, group[begins], opened[begins] + width), begins)
        after = first_at_least(group, entry, group, leave + width)
        passed = np.zeros(len(part), dtype=bool)
        front = front[front >= 0]
        while len(front):  # all groups go on by one part, at most FAN times
            passed[front] = True
            front = after[front]
            front = front[front >= 0]
        part_first = np.append(True, (group[1:] != group[:-1]) | (number[1:] != number[:-1]))
        ends = np.flatnonzero(part_first)
        # A part is entered with the outcome of the last step passed before it in its group, else with the group's own.
        index = np.where(passed, np.arange(len(part)), -1)
        latest = np.append(-1, np.maximum.accumulate(index)[:-1])[ends]
        inside = (latest >= 0) & (group[np.maximum(latest, 0)] == group[ends])
        value = pd.array(np.where(inside, leave[np.maximum(latest, 0)], opened[ends]), dtype="Int64")
        value[~(inside | known[ends])] = pd.NA
        return pd.DataFrame({"__id": ids[ends], "__stretch": number[ends], "opened": value})

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part, group, first, _ = _ordered_moments(part, width)
        before = part["opened"][first]
        starts = window_starts(
            group, part["__at"].to_numpy(), before.fillna(0).to_numpy("int64"), before.notna().to_numpy(), width)
        return part[["__id", "__at"]].assign(__opened=starts)

    def composed(length: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(part: pd.DataFrame) -> pd.DataFrame:
            return compose(part, length)

        return run

    function = "__id string, __stretch long, entry long, leave long"
    levels = [moments.groupBy(chunk("__id", "__stretch")).applyInPandas(summarise, function)]
    length, top = stretch, (end - begin) // stretch if size else 0
    while top > 0:
        levels[-1] = cut_lineage(levels[-1])
        length, top = length * FAN, top // FAN
        above = levels[-1].withColumn("__above", F.expr(f"__stretch div {FAN}")).groupBy(chunk("__id", "__above"))
        levels.append(above.applyInPandas(composed(length), function))
    nothing = F.lit(None).cast("long").alias("opened")
    states = None
    for level in reversed(levels[:-1]):
        group = F.expr(f"__stretch div {FAN}").alias("__above")
        parts = level.select("*", group)
        if states is None:
            parts = parts.withColumn("opened", nothing)
        else:
            parts = parts.join(states.select("__id", F.col("__stretch").alias("__above"), "opened"), ["__id", "__above"])
        states = cut_lineage(parts.groupBy(chunk("__id", "__above")).applyInPandas(enter, "__id string, __stretch long, opened long"))
    known = moments.withColumn("opened", nothing) if states is None else moments.join(states, ["__id", "__stretch"])
    placed = known.groupBy(chunk("__id", "__stretch")).applyInPandas(place, "__id string, __at long, __opened long")
    marked = timed.join(placed, ["__id", "__at"])
    untimed = calls.filter(F.col(ts).isNull()).select("*", F.col(ts).alias("window_start"), F.lit(False).alias("accepted"))
    # A window opens at a call, so its first call gives its start in the column's own type.
    return (
        _accept_first(marked.withColumn("__window", F.struct("__id", "__opened")), "__window", ts, tie, per_window)
        .select(*calls.columns, F.col("__opening").alias("window_start"), "accepted")
        .unionByName(untimed)
    )


def first_success(attempts: DataFrame, keys: Sequence[str], score: str, success: str, tie: str,
                  keep: Sequence[str] = (), error: str | None = None) -> DataFrame:
    """Attempts are tried by descending score: the first that succeeds and how many failed before it.

    Requests without a success have a null winner and all their attempts as failures. The winner
    is a mergeable maximum; failures are counted against it in a second mergeable pass. With ``error`` a request
    that failed altogether carries ``errors``, those of its attempts in order (null for others).
    """
    # The least of these is the first: higher scores, then smaller ties of any type, missing scores last.
    place = F.struct(F.col(score).isNull().alias("unscored"), (-F.col(score)).alias("minus"), F.col(tie).alias("order"))
    best = F.struct(place.alias("place"), *[F.col(c) for c in (score, tie, *keep)])
    tried = attempts.withColumn("__request", F.struct(*keys)).withColumn("__place", place)
    winners = tried.groupBy("__request").agg(F.min(F.when(F.col(success), best)).alias("__won"))
    message = F.struct((-F.col(score)).alias("at"), F.col(tie), (F.lit(None) if error is None else F.col(error)).cast("string").alias("error"))
    failed = ~F.col(success) & (F.col("__won").isNull() | (F.col("__place") < F.col("__won")["place"]))
    listed = F.when(F.col("__won").isNull(), F.transform(F.array_sort("__errors"), lambda e: e["error"]))
    return (
        tried.join(winners, "__request")
        .groupBy("__request", "__won")
        .agg(
            F.count_if(failed).alias("failures_before"),
            F.collect_list(F.when(F.col("__won").isNull(), message)).alias("__errors"),
        )
        .select(
            *[F.col("__request")[k].alias(k) for k in keys],
            *[F.col("__won")[c].alias(c) for c in (score, tie, *keep)],
            F.col("__won").isNotNull().alias("succeeded"),
            "failures_before",
            *([] if error is None else [listed.alias("errors")]),
        )
    )


def usage_rollup(calls: DataFrame, keys: Sequence[str] = (), order: str = "ord") -> DataFrame:
    """Token totals per key; optional sums stay null only if all are null; first known provider."""
    provider = F.min(F.when(F.col("provider").isNotNull(), F.struct(order, "provider")))["provider"]
    return calls.groupBy(*keys).agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("reasoning_tokens").alias("reasoning_tokens"),
        provider.alias("provider"),
        F.sum("execution_time_ms").alias("execution_time_ms"),
        ratio(F.sum("output_tokens"), F.sum("input_tokens")).alias("efficiency"),
    )


def with_total_tokens(calls: DataFrame, count_reasoning: bool = True) -> DataFrame:
    """Add ``total_tokens``; reasoning tokens count where they are known, unless switched off."""
    total = F.col("input_tokens") + F.col("output_tokens")
    if count_reasoning:
        total = total + F.coalesce("reasoning_tokens", F.lit(0))
    return calls.withColumn("total_tokens", total)


def run_summary(
    runs: DataFrame, keys: Sequence[str], duration: str = "execution_time", success: str = "success", at: str = "at"
) -> DataFrame:
    """Runs, success rate, mean duration and last use per key."""
    return runs.groupBy(*keys).agg(
        F.count("*").alias("usage_count"),
        F.avg(duration).alias("avg_execution_time"),
        ratio(F.count_if(success), F.count("*")).alias("success_rate"),
        F.max(at).alias("last_used"),
    )


def hit_rate(events: DataFrame, hit: Column, keys: Sequence[str] = (), percent: bool = False) -> DataFrame:
    """Hits per operation, 0 when there are none, as ratio or percent."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("operations"),
        F.count_if(hit).alias("hits"),
        ratio(F.count_if(hit), F.count("*"), percent).alias("hit_rate"),
    )


def error_rollup(errors: DataFrame, kinds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Errors per kind with what the kind implies; counts come first, so the join sees one row per kind."""
    counted = errors.groupBy(*keys, "kind").agg(F.count("*").alias("errors"))
    return counted.join(kinds, "kind", "left")


def conversation_role(role: Column, content: Column) -> tuple[Column, Column]:
    """Known roles pass; others become user messages that say so."""
    known = F.coalesce(role.isin(*ROLES), F.lit(False))
    note = F.concat(
        F.lit(ROLE_NOTE[0]), F.coalesce(role, F.lit("")), F.lit(ROLE_NOTE[1]), F.coalesce(content, F.lit(""))
    )
    return F.when(known, role).otherwise("user"), F.when(known, content).otherwise(note)


def assemble_conversations(
    turns: DataFrame, keys: Sequence[str], turn: str = "turn", role: str = "role", content: str = "text",
    part_size: int = 10_000,
) -> DataFrame:
    """Ordered ``messages`` per conversation and the same as JSON.

    A conversation continues in further rows (``part`` 1, 2, …) after every ``part_size`` turn numbers, so
    no row has to hold an unbounded list; :func:`parse_conversations` puts parts together again.
    """
    clean_role, clean_content = conversation_role(F.col(role), F.col(content))
    message = F.struct(
        F.col(turn).alias("turn"), clean_role.alias("role"), clean_content.alias("content")
    )
    part = F.floor(F.col(turn) / part_size).alias("part")
    gathered = turns.groupBy(*keys, part).agg(F.array_sort(F.collect_list(message)).alias("__messages"))
    messages = F.transform("__messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return gathered.withColumn("messages", messages).withColumn("json", F.to_json("messages")).drop("__messages")


def parse_conversations(df: DataFrame, keys: Sequence[str], json: str = "json", part: str | None = None) -> DataFrame:
    """Turns from a JSON array; items without a text role or content are dropped, unknown roles become user.

    ``part`` names the column that orders the rows of one conversation; turns count on through them.
    """
    items = F.from_json(F.col(json), "array<struct<role: string, content: string>>")
    earlier = F.lit(0)
    if part is not None:
        sizes = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
        counted = df.select(*keys, part, F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0)).alias("__n"))
        before = counted.select(*keys, part, F.coalesce(F.sum("__n").over(sizes), F.lit(0)).alias("__before"))
        df, earlier = df.join(before, [*keys, part]), F.col("__before")
    turns = df.select(*keys, earlier.cast("long").alias("__before"), F.posexplode(items).alias("__at", "message")).filter(
        F.col("message.role").isNotNull() & F.col("message.content").isNotNull()
    )
    role, content = conversation_role(F.col("message.role"), F.col("message.content"))
    return turns.select(*keys, (F.col("__before") + F.col("__at")).cast("int").alias("turn"), role.alias("role"), content.alias("content"))
