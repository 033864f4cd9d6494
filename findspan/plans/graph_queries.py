"""Registered queries over graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from findspan.operators import graph as G
from findspan.plans.registry import query, table


def _visits(spark, sf):
    """A user's event leads from the user to the number in its properties, per event type."""
    e = table(spark, sf, "events")
    kind = F.concat(F.col("event_type"), F.lit(":"))
    return e.select(F.concat(kind, F.col("user_id")).alias("src"),
                    F.concat(kind, F.regexp_extract("props", r"\d+", 0)).alias("dst")).distinct()


VISITS = r"""(SELECT DISTINCT event_type || ':' || user_id AS src, event_type || ':' || regexp_extract(props, '\d+') AS dst FROM events)"""


@query("coupling", f"""
WITH e AS {VISITS}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, i AS fan_in, o AS fan_out, round(coalesce(o / nullif(i + o, 0), 0), 9) AS instability
FROM (SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS i, (SELECT count(*) FROM e WHERE src = node) AS o FROM n)""")
def coupling(spark, sf):
    return G.coupling(_visits(spark, sf)).withColumn("instability", F.round("instability", 9))


@query("cycles", f"""
WITH RECURSIVE e AS {VISITS},
reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b),
pairs AS (SELECT x.a AS node, x.b AS other FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a),
parts AS (SELECT node, least(min(other), node) AS component, count(DISTINCT other) AS size FROM pairs GROUP BY node HAVING count(DISTINCT other) > 1)
SELECT component, node, size FROM parts""")
def cycles(spark, sf):
    return G.cycles(_visits(spark, sf))


def _supply(spark, sf):
    """Orders depend on customers, customers and suppliers on nations, nations on regions."""
    def edge(name, kind, key, on_kind, on_key):
        return table(spark, sf, name).select(
            F.concat(F.lit(on_kind), F.col(on_key)).alias("src"), F.concat(F.lit(kind), F.col(key)).alias("dst"))

    return (
        edge("nation", "nation", "n_nationkey", "region", "n_regionkey")
        .unionByName(edge("customer", "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(edge("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"))
        .unionByName(edge("orders", "order", "o_orderkey", "customer", "o_custkey"))
    )


SUPPLY = """(
    SELECT 'region' || n_regionkey AS src, 'nation' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'nation' || c_nationkey, 'customer' || c_custkey FROM customer
    UNION ALL SELECT 'nation' || s_nationkey, 'supplier' || s_suppkey FROM supplier
    UNION ALL SELECT 'customer' || o_custkey, 'order' || o_orderkey FROM orders)"""


@query("levels", f"""
WITH RECURSIVE e AS {SUPPLY},
reached AS (
    SELECT DISTINCT src AS node, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e)
    UNION SELECT e.dst, r.level + 1 FROM reached r JOIN e ON e.src = r.node)
SELECT node, max(level) AS level FROM reached GROUP BY node""")
def levels(spark, sf):
    placed, _ = G.levels(_supply(spark, sf))
    return placed


@query("level_problems", f"""
WITH RECURSIVE e AS {SUPPLY.replace("UNION ALL SELECT 'nation' || s", "UNION ALL SELECT 'region9', 'region8' UNION ALL SELECT 'region8', 'region9' UNION ALL SELECT 'nation' || s")}
SELECT 'region' || n AS node, 'cyclic' AS problem FROM (VALUES (8), (9)) v(n)
UNION ALL SELECT DISTINCT 'order' || o_orderkey, 'unknown' FROM orders
UNION ALL SELECT 'region' || r_regionkey, 'duplicate' FROM region""")
def level_problems(spark, sf):
    """Orders are not declared, regions are declared twice, and two made-up regions depend on each other."""
    edges = _supply(spark, sf)
    loop = spark.createDataFrame([("region9", "region8"), ("region8", "region9")], "src string, dst string")
    nodes = edges.filter(~F.col("dst").startswith("order")).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    regions = table(spark, sf, "region").select(F.concat(F.lit("region"), F.col("r_regionkey")).alias("node"))
    declared = nodes.unionByName(loop.select(F.col("src").alias("node"))).unionByName(regions)
    customers = table(spark, sf, "customer").select(F.concat(F.lit("customer"), F.col("c_custkey")).alias("node"))
    declared = declared.unionByName(customers.join(declared, "node", "left_anti"))
    _, problems = G.levels(edges.unionByName(loop), declared)
    return problems


@query("ancestry", f"""
WITH RECURSIVE e AS {SUPPLY},
chains AS (SELECT dst AS child, src AS at, src AS chain, 1 AS depth FROM e
           UNION ALL SELECT c.child, e.src, c.chain || '>' || e.src, c.depth + 1 FROM chains c JOIN e ON e.dst = c.at)
SELECT child, arg_max(chain, depth) AS chain FROM chains GROUP BY child""")
def ancestry(spark, sf):
    chains, _ = G.ancestry(_supply(spark, sf).select(F.col("dst").alias("child"), F.col("src").alias("parent")))
    return chains.select("child", F.array_join("chain", ">").alias("chain"))


@query("ancestry_circular", """
WITH RECURSIVE p AS (SELECT user_id AS child, arg_min(k, event_id) AS parent FROM (
    SELECT user_id, event_id, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events) GROUP BY user_id),
chains AS (SELECT child, parent AS at, [parent] AS chain FROM p WHERE parent IS NOT NULL
           UNION ALL SELECT c.child, p.parent, list_append(c.chain, p.parent) FROM chains c JOIN p ON p.child = c.at
           WHERE c.at <> c.child AND len(list_distinct(c.chain)) = len(c.chain))
SELECT child, array_to_string(chain, '>') AS chain FROM chains WHERE chains."at" = child OR len(list_distinct(chain)) < len(chain)""")
def ancestry_circular(spark, sf):
    """A user's parent is the number in their first event: every chain ends in a circle."""
    number = F.regexp_extract("props", r"\d+", 0).cast("long")
    parents = table(spark, sf, "events").groupBy(F.col("user_id").alias("child")).agg(F.min_by(number, "event_id").alias("parent"))
    _, circular = G.ancestry(parents)
    return circular.select("child", F.array_join("chain", ">").alias("chain"))


def _refs(spark, sf):
    """Every document refers to its neighbour in its own folder and to one in another folder."""
    docs = table(spark, sf, "documents")
    ext = F.when(F.col("lang") == "en", ".ts").when(F.col("lang") == "fr", ".jsx").otherwise("")
    files = docs.select(F.concat(F.lit("src/"), F.col("source"), F.lit("/d"), F.col("doc_id"), ext).alias("path"), "doc_id")
    near = F.concat(F.lit("./d"), F.col("doc_id") + 20)
    far = F.concat(F.lit("../src1/../src3/d"), F.col("doc_id") + 3)
    refs = files.select("path", F.explode(F.array(near, far, F.lit("package"))).alias("ref"))
    return files.select("path"), refs


_REFS = """
WITH f AS (SELECT 'src/' || source || '/d' || doc_id || CASE lang WHEN 'en' THEN '.ts' WHEN 'fr' THEN '.jsx' ELSE '' END AS path, source, doc_id FROM documents),
r AS (SELECT path AS src, './d' || (doc_id + 20) AS ref, 'src/' || source || '/d' || (doc_id + 20) AS target FROM f
      UNION ALL SELECT path, '../src1/../src3/d' || (doc_id + 3), 'src/src3/d' || (doc_id + 3) FROM f
      UNION ALL SELECT path, 'package', 'package' FROM f),
hit AS (SELECT src, ref, path AS dst FROM r JOIN f ON path IN (target, target || '.ts', target || '.tsx', target || '.js', target || '.jsx'))
"""


@query("resolve_edges", _REFS + "SELECT src, ref, dst FROM hit UNION ALL SELECT src, ref, NULL FROM r WHERE (src, ref) NOT IN (SELECT src, ref FROM hit)")
def resolve_edges(spark, sf):
    edges, unresolved = G.resolve_edges(*_refs(spark, sf))
    return edges.unionByName(unresolved.withColumn("dst", F.lit(None).cast("string")))
