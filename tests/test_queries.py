"""Registered queries: equal to their SQL, and planned for large inputs."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import findspan as fs  # noqa: E402
from findspan.plans import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert name in entry.oracle_sql()
    assert oracle.compare(entry.queries()[name](spark, DATA), con, entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Queries that write files, run loops or return an ordered result are left out.
PLANNED = [
    "scan_rules", "lint_by_source", "explode_lines", "line_smells", "detect_language", "nesting_score", "reuse_by_content", "token_mix",
    "maintainability", "line_diff", "annotation_coverage", "secret_literals", "with_context", "message_template", "pattern_stats",
    "propose_rules", "enrich", "rank_providers", "throttle", "first_success", "usage_rollup", "version_timeline", "running_mean",
    "upsert_latest", "changed_since", "effective_template", "merge_layers", "match_templates", "coupling", "resolve_edges",
    "score_predictions", "search_candidates", "best_candidate",
]


# One row from a global aggregate (of the bests, of the provider table) that every task prepares.
GLOBAL = ["best_candidate", "rank_providers"]


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join_and_no_window_in_one_task(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text or name in GLOBAL


@pytest.mark.parametrize("name", ["scan_rules", "line_smells", "token_mix", "annotation_coverage", "rank_providers", "secret_literals"])
def test_row_by_row_work_needs_no_shuffle(spark, name):
    """The only exchange allowed is that of the provider table's one row, a scalar subquery."""
    exchanges = [line for line in plan(entry.queries()[name](spark, DATA)).splitlines() if "Exchange" in line]
    assert all("SinglePartition" in line for line in exchanges) and (name == "rank_providers" or not exchanges)


def test_scan_reads_only_the_needed_columns(spark):
    text = plan(entry.queries()["nesting_score"](spark, DATA))
    assert "n_chars" not in text and "url" not in text
    text = plan(entry.queries()["top_n"](spark, DATA))
    assert text.count("WindowGroupLimit") == 2 and "props" not in text


def test_no_broadcast_hint_in_the_library():
    for file in Path(fs.__file__).parent.rglob("*.py"):
        if "llm" in file.parts:
            continue  # broadcasts models and samples of a bounded size
        code = file.read_text()
        assert "F.broadcast(" not in code and "localCheckpoint(" not in code and "crossJoin(" not in code, file


def test_hot_keys_give_the_same_rows(spark):
    """A key with most rows: joins sort-merged, hot keys split."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                          "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "10KB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "10KB")
    try:
        found = spark.range(40_000).repartition(8).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 500)).alias("rule_name"),
            F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        rules = found.select(F.col("rule_name").alias("id")).distinct().withColumn("category", F.upper("id"))
        joined = fs.enrich(found, rules, ["category"])
        assert joined.count() == 40_000 and joined.filter("category = upper(rule_name)").count() == 40_000
        joined.write.format("noop").mode("overwrite").save()
        texts = found.select(F.when(F.col("rule_name") == "hot", F.repeat(F.lit("copy "), 40)).otherwise(F.col("pad")).alias("t"))
        counted = fs.reuse_by_content(texts, "t", lambda d: d.select("content_id", F.length("t").alias("n")))
        assert counted.groupBy("n").count().orderBy("n").collect() == texts.groupBy(F.length("t").alias("n")).count().orderBy("n").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
