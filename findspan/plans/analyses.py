"""The three analyses a user runs end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.operators import calls as C
from findspan.operators import corpus as X
from findspan.operators import findings as N
from findspan.operators import rules as R


def lint_texts(
    texts: DataFrame, rules: DataFrame, text: str = "text", language: str | None = None
) -> DataFrame:
    """Findings of the rules and of the line heuristics on a table of texts: one pass over the lines."""
    found = R.scan_rules(X.explode_lines(texts, text), rules, language, smells=True)
    smell = F.col("rule_name").isin([name for name, *_ in X.LINE_SMELLS])
    return found.withColumn("source", F.when(smell, "lines").otherwise("rules"))


def learn_rules(findings: DataFrame, known: DataFrame | None = None, seen_at: str = "seen_at") -> DataFrame:
    """Proposed rules from recurring findings."""
    return N.propose_rules(N.pattern_stats(findings, seen_at), known)


def route_calls(requests: DataFrame, providers: DataFrame, keys: Sequence[str], ts: str, tie: str,
                per_window: int = 20, window_seconds: int = 60) -> DataFrame:
    """Accepted requests with their ranked providers."""
    admitted = C.throttle(requests, keys, ts, tie, per_window, window_seconds).filter("accepted")
    return C.rank_providers(admitted, providers)
