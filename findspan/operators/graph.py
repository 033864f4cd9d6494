"""Graphs of references: resolving, coupling, cycles, levels and ancestry.

The loops write their state to the shared folder (once per round), run until nothing changes
and ask the driver only whether anything is left to do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findspan.session import cut_lineage

# Extensions tried for a reference, in this order.
REFERENCE_EXTENSIONS = ("", ".ts", ".tsx", ".js", ".jsx", ".json")


def normal_path(path: Column) -> Column:
    """Path without ``.`` and ``..`` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    root = F.array().cast("array<string>")
    kept = F.aggregate(
        parts, root,
        lambda done, part: F.when(
            (part == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        ).when(part == "..", done).otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def resolve_edges(
    files: DataFrame, refs: DataFrame, extensions: Sequence[str] = REFERENCE_EXTENSIONS
) -> tuple[DataFrame, DataFrame]:
    """References to files: (``src``, ``ref``, ``dst``) edges and the unresolved (``src``, ``ref``).

    The path as written is tried first, then with each extension. References that start with a dot
    are relative to the referring file, others to the root of the corpus; all files count, whether
    they come before or after the referring one.
    """
    asked = refs.select(F.col("path").alias("src"), "ref").distinct()
    folder = F.regexp_extract("src", r"^(.*)/[^/]*\z", 1)
    target = normal_path(F.when(F.col("ref").startswith("."), F.concat(folder, F.lit("/"), F.col("ref"))).otherwise(F.col("ref")))
    tries = F.array(*[F.lit(e) for e in extensions])
    tried = asked.withColumn("__target", target).select(
        "src", "ref", "__target", F.posexplode(tries).alias("__order", "__ext")
    ).select("src", "ref", "__order", F.concat("__target", "__ext").alias("dst"))
    hits = tried.join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    edges = hits.groupBy("src", "ref").agg(F.min_by("dst", "__order").alias("dst"))
    return edges, asked.join(edges, ["src", "ref"], "left_anti")


def coupling(edges: DataFrame) -> DataFrame:
    """Distinct fan-in and fan-out per node and instability = out / (in + out)."""
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )
    )
    return (
        edges.select("src", "dst").distinct().select(ends.alias("e")).groupBy("e.node")
        .agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
        .withColumn(
            "instability",
            F.coalesce(F.try_divide(F.col("fan_out").cast("double"), F.col("fan_in") + F.col("fan_out")), F.lit(0.0)),
        )
    )


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest label that reaches each node along the edges, to the fixed point.

    Labels only fall, so the rounds end. Only labels that fell in the last round travel on; a hub is a
    skewed key of the edge side, which adaptive execution splits, and labels meet in a mergeable
    minimum.
    """
    state = labels.withColumn("moved", F.lit(True))
    while True:
        fresh = state.filter("moved").select(F.col("node").alias("src"), "label")
        pushed = edges.join(fresh, "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("pushed"))
        state = cut_lineage(
            state.join(pushed, "node", "left").select(
                "node",
                F.least("label", "pushed").alias("label"),
                F.coalesce(F.col("pushed") < F.col("label"), F.lit(False)).alias("moved"),
            )
        )
        if state.filter("moved").isEmpty():
            return state.select("node", "label")


def _trim(edges: DataFrame) -> DataFrame:
    """Drop edges that cannot lie on a cycle because an end has no way in or no way out.

    One round only: what is left is found by the sweeps, in fewer jobs than long tails take here.
    """
    return cut_lineage(
        edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        .join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        .select("src", "dst")
    )


def _chain_nodes(edges: DataFrame) -> DataFrame:
    """Nodes with one way in and one way out (``node``, ``up``, ``down``); the edges are distinct."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("up")).filter("n = 1").drop("n")
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("down")).filter("n = 1").drop("n")
    return cut_lineage(into.join(out, "node"))


def _chain_ends(nodes: DataFrame, towards: str) -> tuple[DataFrame, DataFrame]:
    """The first node in a direction that is no chain node (``node``, ``end``, ``steps``), and rings of chain nodes (``node``, ``component``).

    Each round doubles the way that a node has looked, so the rounds grow with the logarithm of the longest chain.
    A node that has looked past all of them is in a ring.
    """
    linked = nodes.select("node", F.col(towards).alias("end"))
    state = linked.join(linked.select(F.col("node").alias("end"), F.lit(True).alias("open")), "end", "left")
    state = cut_lineage(state.select("node", "end", F.lit(1).cast("long").alias("steps"), F.least("node", "end").alias("least"),
                                     F.coalesce("open", F.lit(False)).alias("open")))
    size, rounds = nodes.count(), 0
    while (1 << rounds) <= size and not state.filter("open").isEmpty():
        further = state.select(F.col("node").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"),
                               F.col("least").alias("lower"), F.col("open").alias("still"))
        moved = state.filter("open").join(further, "end").select(
            "node", F.col("next").alias("end"), (F.col("steps") + F.col("more")).alias("steps"),
            F.least("least", "lower").alias("least"), F.col("still").alias("open"))
        state, rounds = cut_lineage(state.filter("NOT open").unionByName(moved)), rounds + 1
    return state.filter("NOT open").select("node", "end", "steps"), state.filter("open").select("node", F.col("least").alias("component"))


def _contracted(edges: DataFrame, nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """The edges (src, dst, length) between the nodes that are no chain nodes; a chain is one edge, of parallel ones the longest stays."""
    ends = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti")
    begun = ends.join(heads.select(F.col("node").alias("src"), F.col("end").alias("head"), "steps"), "src", "left")
    short = begun.select(F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("steps", F.lit(0)) + 1).alias("length"))
    return cut_lineage(short.groupBy("src", "dst").agg(F.max("length").alias("length")))


def cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected components of more than one node: (``component``, ``node``, ``size``).

    Chains are edges at first, so that rounds follow the branchings and not the length of paths. Each sweep colours every node with
    the smallest node that reaches it. The node a colour is named after and everything of that colour that reaches it form one
    component; edges between colours can be on no cycle. Components leave the graph and the sweep repeats until no edge is left;
    each sweep takes the component of at least one colour away. A chain belongs to the component that both its ends are in. A
    component is named after its smallest node.
    """
    links = cut_lineage(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    chain = _chain_nodes(links)
    heads, rings = _chain_ends(chain, "up")
    tails, _ = _chain_ends(chain, "down")
    short = _contracted(links, chain, heads)
    left = _trim(short.filter(F.col("src") != F.col("dst")).select("src", "dst"))
    found = None
    while not left.isEmpty():
        colours = _spread(left, _nodes(left).withColumn("label", F.col("node")))
        source = colours.select(F.col("node").alias("src"), F.col("label").alias("src_colour"))
        target = colours.select(F.col("node").alias("dst"), F.col("label").alias("dst_colour"))
        inside = left.join(source, "src").join(target, "dst").filter("src_colour = dst_colour")
        inside = cut_lineage(inside.select("src", "dst", F.col("src_colour").alias("colour")))
        # Backwards from the node that names the colour: 0 = reaches it, 1 = not known to.
        backwards = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        start = colours.select("node", F.when(F.col("node") == F.col("label"), 0).otherwise(1).alias("label"))
        reach = _spread(backwards, start).filter("label = 0").select("node")
        members = cut_lineage(colours.join(reach, "node").select(F.col("label").alias("component"), "node"))
        found = members if found is None else found.union(members)
        left = inside.select("src", "dst")
        done = members.select("node")
        left = left.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(
            done.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = _trim(left.select("src", "dst"))
    if found is None:
        found = links.limit(0).select(F.col("src").alias("component"), F.col("dst").alias("node"))
    # A chain is in the component that both its ends are in; one that comes back to where it began makes that node a component.
    on = heads.select("node", F.col("end").alias("head")).join(tails.select("node", F.col("end").alias("tail")), "node")
    looped = on.filter("head = tail").select(F.col("head").alias("component"), F.col("head").alias("node")).distinct()
    known = cut_lineage(found.unionByName(looped.join(found.select("node"), "node", "left_anti").select("component", "node")))
    closed = on.join(known.select(F.col("node").alias("head"), "component"), "head").join(
        known.select(F.col("node").alias("tail"), F.col("component").alias("other")), "tail").filter("component = other")
    whole = cut_lineage(known.unionByName(closed.select("component", "node")).unionByName(rings.select("component", "node")))
    named = whole.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("size")).filter("size > 1")
    return whole.join(named, "component").select(F.col("least").alias("component"), "node", "size")


#: Written levels that one plan reads before they are put together.
LEVELS_PER_TABLE = 50


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Dependency level of each node where ``dst`` depends on ``src``, and the problems.

    Level 0 depends on nothing; a node is one above its highest dependency. Problems name
    endpoints missing from ``nodes``, ids given twice, and nodes on or behind cycles. Chains are single edges of their length, so
    rounds follow the branchings; a round settles the nodes all of whose dependencies have their level, and carries on only those
    that still wait; it ends when none settles. The nodes of a chain are counted from its head.
    """
    links = edges.select("src", "dst").distinct()
    known = _nodes(links) if nodes is None else nodes.select("node").distinct()
    problems = []
    if nodes is not None:
        twice = nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        problems.append(twice.select("node", F.lit("duplicate").alias("problem")))
        unknown = _nodes(links).join(known, "node", "left_anti")
        problems.append(unknown.select("node", F.lit("unknown").alias("problem")))
        links = links.join(known.select(F.col("node").alias("src")), "src", "left_semi").join(
            known.select(F.col("node").alias("dst")), "dst", "left_semi")
    links = cut_lineage(links.select("src", "dst"))
    chain = _chain_nodes(links)
    heads, _ = _chain_ends(chain, "up")
    short = _contracted(links, chain, heads)
    waits = short.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("missing"))
    # Nodes that settle in the current round have nothing missing, the others wait.
    state = known.join(chain.select("node"), "node", "left_anti").join(waits, "node", "left")
    state = cut_lineage(state.select("node", F.coalesce("missing", F.lit(0)).alias("missing"), F.lit(0).cast("long").alias("level")))
    done: list[DataFrame] = []
    while True:
        placed, waiting = state.filter("missing = 0").select("node", "level"), state.filter("missing > 0")
        done.append(placed)
        if len(done) >= LEVELS_PER_TABLE:
            done = [cut_lineage(_union(done))]
        settled, open_ones = state.agg(F.count_if(F.col("missing") == 0), F.count_if(F.col("missing") > 0)).first()
        if not settled or not open_ones:
            break
        met = short.join(placed.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(
            F.count("*").alias("met"), F.max(F.col("level") + F.col("length")).alias("least"))
        state = cut_lineage(waiting.join(met, "node", "left").select(
            "node", (F.col("missing") - F.coalesce("met", F.lit(0))).alias("missing"), F.greatest("level", F.coalesce("least", F.lit(0))).alias("level")))
    settled = cut_lineage(_union(done).select("node", F.col("level").cast("int").alias("level")))
    on = heads.join(settled.select(F.col("node").alias("end"), "level"), "end").select("node", (F.col("level") + F.col("steps")).cast("int").alias("level"))
    done = [settled, on]
    waiting = known.join(settled, "node", "left_anti").join(on, "node", "left_anti")
    problems.append(waiting.select("node", F.lit("cyclic").alias("problem")))
    return _union(done), _union(problems)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def ancestry(children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chain of parents of every child, nearest first, and the children whose chain is circular.

    A circular chain ends with the first node that comes again (or is the child). Each round joins the
    open chains with the chains of their last nodes, so chains double and the rounds grow with
    the logarithm of the longest one.
    """
    step = children.filter(F.col("parent").isNotNull())
    # Whether a chain goes on, has ended at a node without a parent, or turns in a circle.
    start = F.when(F.col("parent") == F.col("child"), "circular").otherwise("open")
    state = cut_lineage(step.select("child", F.array("parent").alias("chain"), start.alias("state")))
    while not state.filter("state = 'open'").isEmpty():
        tail = state.select(F.col("child").alias("__last"), F.col("chain").alias("__more"), F.col("state").alias("__then"))
        grown = state.filter("state = 'open'").withColumn("__last", F.element_at("chain", -1)).join(tail, "__last", "left")
        grown = grown.select(
            "child", F.concat("chain", F.coalesce("__more", F.expr("slice(chain, 1, 0)"))).alias("chain"),
            F.coalesce("__then", F.lit("ended")).alias("state"))
        with_child = F.concat(F.array("child"), F.col("chain"))
        turns = F.size(F.array_distinct(with_child)) < F.size(with_child)
        # Place of the first node that was there before.
        first = F.expr("array_min(filter(sequence(2, size(__all)), i -> array_position(__all, element_at(__all, i)) < i))")
        closed = grown.withColumn("__all", F.when(turns, with_child)).select(
            "child",
            F.when(turns, F.slice("chain", F.lit(1), first - 1)).otherwise(F.col("chain")).alias("chain"),
            F.when(turns, "circular").otherwise(F.col("state")).alias("state"))
        state = cut_lineage(state.filter("state <> 'open'").unionByName(closed))
    return tuple(state.filter(F.col("state") == s).select("child", "chain") for s in ("ended", "circular"))
