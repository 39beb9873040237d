"""Bounded walks over the graph: caller trees, traces, call trees, breadth-first search.

Every walk is a loop of one join per level whose levels are written to the shared folder,
so a level is computed once and lineage stays short. Fan-out is bounded before the walk
(per-node rankings, reachability), never by cutting rows afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from typegraph.plans.scratch import Scratch
from typegraph.schema import MESSAGE_RELATIONS, is_test_double, relation_weight

FAN_OUT = 20


def dominant_relations(edges: DataFrame) -> DataFrame:
    """(src, dst, relation): the weightiest relation of each pair, the first among equals."""
    best = F.max_by("relation", F.struct(relation_weight(F.col("relation")).alias("w"), (-F.col("ord")).alias("o"), "relation"))
    return edges.groupBy("src", "dst").agg(best.alias("relation"))


def _levels(first: DataFrame, step: Callable[[DataFrame], DataFrame], more: int, scratch: Scratch) -> DataFrame:
    """Union of ``first`` and up to ``more`` further levels."""
    level = scratch.save(first)
    out = level
    for _ in range(more):
        level = scratch.save(step(level))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def ranked_callers(edges: DataFrame, ranks: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(dst, src, relation, rn): the callers of each type that are shown, in order."""
    pairs = dominant_relations(edges).filter(~is_test_double(F.col("src")))
    pairs = pairs.join(ranks.select(F.col("key").alias("src"), "rank"), "src", "left")
    w = W.partitionBy("dst").orderBy(F.coalesce("rank", F.lit(0.0)).desc(), "src")
    return pairs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= fan_out).select("dst", "src", "relation", "rn")


def caller_tree(callers: DataFrame, start: DataFrame, depth: int, spark: SparkSession) -> DataFrame:
    """Backward tree from start (key): (key, parent, relation, depth, pos, path).

    pos orders rows as printed (one rank per level). A type already on its own path is
    shown once more but not expanded.
    """
    depth = min(max(depth, 1), 6)
    scratch = Scratch(spark, "callers")
    c = scratch.save(callers)

    def grow(at: DataFrame) -> DataFrame:
        live = at.filter("open").select("key", "depth", "pos", "path")
        return live.join(c, live["key"] == c["dst"]).select(
            F.col("src").alias("key"), F.col("key").alias("parent"), "relation",
            (F.col("depth") + 1).alias("depth"), F.concat("pos", F.array("rn")).alias("pos"),
            F.concat("path", F.array("src")).alias("path"), (~F.array_contains("path", F.col("src"))).alias("open"),
        )

    root = start.select(
        "key", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("relation"), F.lit(0).alias("depth"),
        F.array().cast("array<int>").alias("pos"), F.array("key").alias("path"), F.lit(True).alias("open"),
    )
    return _levels(grow(root), grow, depth - 1, scratch).drop("open")


def _trace_steps(edges: DataFrame, pivots: bool) -> DataFrame:
    """(at, to, mark): the steps of a trace; ``=>`` over messages, ``<->`` for a pivot."""
    dom = dominant_relations(edges)
    message = F.col("relation").isin(*MESSAGE_RELATIONS)
    back = dom.filter(~is_test_double(F.col("src"))).select(
        F.col("dst").alias("at"), F.col("src").alias("to"), F.when(message, F.lit("=>")).otherwise(F.lit("->")).alias("mark")
    )
    if not pivots:
        return back
    used = edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n")).filter("n >= 2")
    side = dom.filter(~message).join(used, "dst", "left_semi")
    return back.unionByName(side.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit("<->").alias("mark")))


def reaching(step: DataFrame, ends: DataFrame, more: int, scratch: Scratch) -> DataFrame:
    """(key, dist): types from which an end (key) is at most ``more`` steps (at, to) away."""
    near = front = scratch.save(ends.select("key", F.lit(0).alias("dist")))
    for k in range(1, more + 1):
        ahead = step.join(front, step["to"] == front["key"]).select(F.col("at").alias("key")).distinct()
        front = scratch.save(ahead.join(near, "key", "left_anti").withColumn("dist", F.lit(k)))
        if front.isEmpty():
            break
        near = near.unionByName(front)
    return scratch.save(near)


def _grown(at: DataFrame, step: DataFrame) -> DataFrame:
    """One more step of every open path; step: (at, to, mark, dist of to)."""
    nxt = at.filter("dist > 0").select("node", "path", "marks", "pivoted").join(step, F.col("node") == F.col("at"))
    nxt = nxt.filter(~F.array_contains("path", F.col("to")) & (~F.col("pivoted") | (F.col("mark") != "<->")))
    return nxt.select(
        F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path"),
        F.concat("marks", F.array("mark")).alias("marks"), (F.col("pivoted") | (F.col("mark") == "<->")).alias("pivoted"), "dist",
    )


def _first(start: DataFrame, near: DataFrame) -> DataFrame:
    return start.select("key").join(near, "key").select(
        F.col("key").alias("node"), F.array("key").alias("path"), F.array().cast("array<string>").alias("marks"), F.lit(False).alias("pivoted"), "dist"
    )


def _labelled(found: DataFrame) -> DataFrame:
    label = (
        F.when(F.array_contains("marks", "<->"), "heuristic").when(F.array_contains("marks", "=>"), "exact-message")
        .when(F.size("path") <= 3, "direct").otherwise("nearby")
    )
    return found.select(F.col("node").alias("endpoint"), "path", "marks").distinct().withColumn("label", label)


def traces(
    edges: DataFrame, endpoints: DataFrame, start: DataFrame, max_nodes: int, spark: SparkSession, pivots: bool = True
) -> DataFrame:
    """All backward simple paths from start (key) to types with endpoints (key).

    Returns (endpoint, path, marks, label). A hop over a message relation is marked
    ``=>``. Once per path a pivot may follow an outgoing edge to a type that at least two
    others use (``<->``). A path ends at the first type with an endpoint and has at most
    max_nodes nodes. Only steps from which an endpoint is still within reach are taken.
    Their number may grow as a power of max_nodes; :func:`best_traces` is bounded.
    """
    max_nodes = min(max(max_nodes, 1), 12)
    scratch = Scratch(spark, "trace")
    step = scratch.save(_trace_steps(edges, pivots))
    near = reaching(step, endpoints.select("key").distinct(), max_nodes - 1, scratch)
    step = scratch.save(step.join(near.select(F.col("key").alias("to"), "dist"), "to"))
    within = F.size("path") + F.col("dist") <= max_nodes
    found = _levels(_first(start, near), lambda at: _grown(at, step).filter(within), max_nodes - 1, scratch)
    return _labelled(found.filter("dist = 0"))


#: Paths that a trace shows.
TRACES = 15


def best_traces(
    edges: DataFrame, endpoints: DataFrame, start: DataFrame, max_nodes: int, spark: SparkSession, top: int = TRACES
) -> DataFrame:
    """The ``top`` shortest paths of :func:`traces` from one start, without doubtful ones.

    Ordered by length, path and marks. Heuristic paths to endpoints that a path without
    pivots reaches do not count. Paths are grown in order of the least length they can
    end with, so nothing longer than the last path shown is ever built: from a hub that
    endpoints use, one step is enough, however many paths of eight types there are.
    """
    max_nodes = min(max(max_nodes, 1), 12)
    scratch = Scratch(spark, "trace")
    step = scratch.save(_trace_steps(edges, True))
    ends = scratch.save(endpoints.select("key").distinct())
    # endpoints that a path without pivots reaches: a shortest walk repeats no type
    plain = step.filter("mark <> '<->'").select("at", "to").join(ends, F.col("at") == F.col("key"), "left_anti")
    sure = bfs(plain, start, max_nodes - 1, spark).select("key").unionByName(start.select("key")).join(ends, "key", "left_semi").distinct()
    sure = scratch.save(sure.select(F.col("key").alias("node"), F.lit(True).alias("sure")))
    near = reaching(step, ends, max_nodes - 1, scratch)
    step = scratch.save(step.join(near.select(F.col("key").alias("to"), "dist"), "to"))
    open_ = scratch.save(_first(start, near))
    found = scratch.save(open_.filter("dist = 0"))
    open_ = open_.filter("dist > 0")
    for length in range(1, max_nodes + 1):
        later = []
        while True:
            ripe = scratch.save(open_.filter(F.size("path") + F.col("dist") <= length))
            later.append(open_.filter(F.size("path") + F.col("dist") > length))
            if ripe.isEmpty():
                break
            grown = scratch.save(_grown(ripe, step))
            ended = grown.filter("dist = 0").join(sure, "node", "left").filter("not pivoted or sure is null").drop("sure")
            found = found.unionByName(ended)
            open_ = grown.filter("dist > 0")
        found = scratch.save(found)
        if found.distinct().count() >= top:
            break
        open_ = later[0]
        for more in later[1:]:
            open_ = open_.unionByName(more)
        open_ = scratch.save(open_)
        if open_.isEmpty():
            break
    return _labelled(found).orderBy(F.size("path"), "path", "marks").limit(top)


def trace_fallbacks(edges: DataFrame, di: DataFrame, endpoints: DataFrame, max_nodes: int, spark: SparkSession) -> DataFrame:
    """(key, kind, other, rn): what is shown of types without a trace: ten callers, then implementations.

    Types are both ends of edges and the services of ``di`` (service, impl).
    """
    scratch = Scratch(spark, "fallback")
    step = scratch.save(_trace_steps(edges, True))
    near = reaching(step, endpoints.select("key").distinct(), max_nodes - 1, scratch)
    pairs = edges.select(F.col("dst").alias("key"), F.col("src").alias("other")).distinct().join(near, "key", "left_anti")
    w = W.partitionBy("key").orderBy("other")
    callers = pairs.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").withColumn("kind", F.lit("caller"))
    bound = di.select(F.col("service").alias("key"), F.col("impl").alias("other")).distinct().join(near, "key", "left_anti")
    impls = bound.withColumn("rn", F.row_number().over(w)).withColumn("kind", F.lit("implementation"))
    cols = ["key", "kind", "other", "rn"]
    return callers.select(*cols).unionByName(impls.select(*cols))


def dedupe_traces(found: DataFrame) -> DataFrame:
    """Without heuristic paths to endpoints that another path reaches as well."""
    sure = found.filter("label <> 'heuristic'").select("endpoint").distinct()
    return found.filter("label <> 'heuristic'").unionByName(found.filter("label = 'heuristic'").join(sure, "endpoint", "left_anti"))


def bfs(steps: DataFrame, start: DataFrame, depth: int, spark: SparkSession) -> DataFrame:
    """(seed, key, dist, path): every type within ``depth`` steps (at, to) of start (key).

    path is one shortest chain from the seed, the smallest by name.
    """
    scratch = Scratch(spark, "bfs")
    s = scratch.save(steps.select("at", "to").distinct())
    front = scratch.save(start.select(F.col("key").alias("seed"), "key", F.lit(0).alias("dist"), F.array("key").alias("path")))
    seen = front
    for k in range(1, depth + 1):
        nxt = front.join(s, front["key"] == s["at"]).select("seed", F.col("to").alias("key"), F.concat("path", F.array("to")).alias("path"))
        nxt = nxt.groupBy("seed", "key").agg(F.min("path").alias("path"))
        front = scratch.save(nxt.join(seen, ["seed", "key"], "left_anti").select("seed", "key", F.lit(k).alias("dist"), "path"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("dist > 0")


def call_steps(calls: DataFrame, di: DataFrame) -> DataFrame:
    """Calls with the type whose calls they lead to.

    calls: (caller, member, callee, callee_member, line, ord); di: (service, impl, ord).
    A callee without own calls for the member is replaced by its first bound
    implementation that has some, else by its first implementation.
    """
    has = calls.select(F.col("caller").alias("h_type"), F.col("member").alias("h_member")).distinct()
    want = calls.select("callee", "callee_member").distinct()
    own = want.join(has, (F.col("callee") == F.col("h_type")) & (F.col("callee_member") == F.col("h_member")), "left_semi")
    bare = want.join(own, ["callee", "callee_member"], "left_anti")
    impl = bare.join(di.select(F.col("service").alias("callee"), "impl", F.col("ord").alias("d")), "callee")
    impl = impl.join(has.withColumn("able", F.lit(1)), (F.col("impl") == F.col("h_type")) & (F.col("callee_member") == F.col("h_member")), "left")
    pick = F.min_by("impl", F.struct((1 - F.coalesce("able", F.lit(0))).alias("a"), F.col("d"), F.col("impl").alias("i")))
    impl = impl.groupBy("callee", "callee_member").agg(pick.alias("via"))
    return calls.join(impl, ["callee", "callee_member"], "left").withColumn("into", F.coalesce("via", "callee"))


def call_tree(steps: DataFrame, start: DataFrame, depth: int, spark: SparkSession) -> DataFrame:
    """Preorder call tree from start (type, member): (callee, callee_member, via, depth, pos).

    pos orders rows as printed. A (type, member) already on the path is shown but not
    expanded; the root is not on the path, so a circle shows once more.
    """
    depth = min(max(depth, 1), 5)
    scratch = Scratch(spark, "flow")
    w = W.partitionBy("caller", "member").orderBy("line", "ord")
    s = scratch.save(steps.withColumn("rn", F.row_number().over(w)))

    def grow(at: DataFrame) -> DataFrame:
        live = at.filter("open").select("type", "mem", "seen", "pos", "depth")
        return live.join(s, (F.col("type") == F.col("caller")) & (F.col("mem") == F.col("member"))).select(
            "callee", "callee_member", "via", "line", (F.col("depth") + 1).alias("depth"), F.concat("pos", F.array("rn")).alias("pos"),
            F.col("into").alias("type"), F.col("callee_member").alias("mem"),
            F.concat("seen", F.array(F.concat_ws(".", "into", "callee_member"))).alias("seen"),
            (~F.array_contains("seen", F.concat_ws(".", "into", "callee_member"))).alias("open"),
        )

    root = start.select(
        "type", F.col("member").alias("mem"), F.array().cast("array<string>").alias("seen"),
        F.array().cast("array<int>").alias("pos"), F.lit(0).alias("depth"), F.lit(True).alias("open"),
    )
    return _levels(grow(root), grow, depth - 1, scratch).select("callee", "callee_member", "via", "line", "depth", "pos")


def within_budget(rows: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` rows of a printed tree (a display limit), with their number."""
    w = W.orderBy("pos")
    return rows.orderBy("pos").limit(budget).withColumn("n", F.row_number().over(w))
