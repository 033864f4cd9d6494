"""Findings, patterns and call accounting over large text corpora, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from findspan.operators.calls import (
    assemble_conversations,
    default_providers,
    error_kinds,
    error_rollup,
    first_success,
    hit_rate,
    parse_conversations,
    rank_providers,
    ranked_providers,
    run_summary,
    throttle,
    throttle_aligned,
    usage_rollup,
    with_total_tokens,
)
from findspan.operators.corpus import (
    detect_language,
    explode_lines,
    filter_by_globs,
    line_smells,
    locate,
    marker_count,
    nesting_score,
    paired_absence,
    reuse_by_content,
    size_guard,
    split_supported,
)
from findspan.operators.docs import (
    annotation_coverage,
    annotation_gaps,
    annotation_symbols,
    extract_code_blocks,
    extract_json_edges,
)
from findspan.operators.findings import (
    apply_replacements,
    combine_engines,
    confident,
    confident_fixes,
    lint_metrics,
    message_template,
    mistake_summary,
    pattern_clusters,
    pattern_contexts,
    pattern_stats,
    propose_rules,
    secret_literals,
    sort_findings,
    with_context,
)
from findspan.operators.graph import ancestry, coupling, cycles, levels, resolve_edges
from findspan.operators.metrics import (
    branch_count,
    improvement,
    line_diff,
    maintainability,
    project_rollup,
    response_summary,
    token_mix,
)
from findspan.operators.rules import (
    custom_rule,
    default_rules,
    enabled_rules,
    enrich,
    filter_rules,
    fix_rules,
    normalize_labels,
    not_yet_known,
    only_listed,
    register_rule,
    rule_stats,
    scan_custom_rules,
    scan_rules,
    scan_texts,
    scan_texts_indexed,
)
from findspan.operators.running import running, running_mean
from findspan.operators.search import best_candidate, predict, score_predictions, search_candidates
from findspan.operators.settings import merge_layers
from findspan.operators.templates import match_templates, match_templates_indexed
from findspan.operators.versions import (
    available_names,
    changed_since,
    effective_prompts,
    effective_template,
    latest_per_key,
    next_version,
    render_templates,
    rollback,
    top_n,
    upsert_latest,
    version_timeline,
)
from findspan.plans.analyses import learn_rules, lint_texts, route_calls
from findspan.sources.files import append_run_log, read_findings, read_rules, read_run_log, scan_corpus, write_folders
from findspan.sources.stored import (
    changed_rows,
    keep_snapshot,
    read_stored,
    read_stored_log,
    reuse_results,
    stream_to_run_log,
    upsert_stored,
)
from findspan.streaming.streams import (
    stream_corpus,
    stream_dedup,
    stream_findings,
    stream_pattern_stats,
    stream_run_summary,
    stream_throttle,
    stream_throttle_exact,
)

__all__ = sorted(name for name in globals() if not name.startswith("_") and callable(globals()[name]))

# Functions of this package travel to Python workers by value: a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
