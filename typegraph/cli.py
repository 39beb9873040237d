"""Command line over a scanned folder: python -m typegraph.cli STORE COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from typegraph.operators import text, traverse
from typegraph.operators.rank import pagerank
from typegraph.operators.slices import longest_spans, read_numbered, slice_spans
from typegraph.plans.index import Graph, build_graph, resolve_input
from typegraph.schema import is_test_double
from typegraph.sources.files import FragmentStore, read_sources, scan


def _one(graph: Graph, name: str) -> DataFrame:
    """The type a user means; an error with the candidates if it is not one type."""
    found = resolve_input(graph, name).limit(20).collect()
    if found[0]["status"] != "ok":
        raise SystemExit(f"{name} is {found[0]['status']}: " + ", ".join(sorted(r["key"] or "" for r in found)))
    return graph.nodes.sparkSession.createDataFrame([(found[0]["key"],)], "key string")


def _documents(graph: Graph) -> DataFrame:
    """(key, text) of the public types: name, summary, public members and the first forty targets."""
    own = graph.members.filter("is_public").groupBy(F.col("type_key").alias("key"))
    own = own.agg(F.array_join(F.sort_array(F.collect_set("member_name")), " ").alias("own"))
    w = W.partitionBy("src").orderBy("file_path", "ord", "dst")
    first = graph.edges.withColumn("rn", F.row_number().over(w)).filter("rn <= 40").groupBy(F.col("src").alias("key"))
    first = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "dst"))), lambda x: F.substring_index(x["dst"], ".", -1)), " ").alias("uses"))
    docs = graph.nodes.filter("is_public").join(own, "key", "left").join(first, "key", "left")
    return docs.select("key", F.concat_ws(" ", "name", "summary", "own", "uses").alias("text"))


def answer(spark: SparkSession, graph: Graph, command: str, name: str, member: str | None, depth: int, limit: int, root: str | None) -> DataFrame:
    """The rows of one command."""
    e = graph.edges
    back = e.filter(~is_test_double(F.col("src"))).select(F.col("dst").alias("at"), F.col("src").alias("to"))
    if command == "stats":
        parts = {"nodes": graph.nodes, "edges": e, "endpoints": graph.endpoints, "call_sites": graph.calls, "di_bindings": graph.di}
        out = None
        for part, df in parts.items():
            one = df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
            out = one if out is None else out.unionByName(one)
        return out
    if command == "search":
        hit = graph.nodes.filter(F.instr("key", name.upper()) > 0).join(pagerank(e, spark), "key", "left")
        return hit.orderBy(F.coalesce("rank", F.lit(0.0)).desc(), "key").limit(limit).select("key", "kind", "file_path", "start_line")
    if command == "hubs":
        r = pagerank(e, spark).join(graph.nodes.select("key", "kind"), "key").filter(~is_test_double(F.col("key")))
        return r.orderBy(F.desc("rank"), "key").limit(limit)
    if command == "semantic":
        return text.bm25(_documents(graph), "key", "text", name, limit)
    if command == "read-file":
        files = read_sources(spark, root or ".").filter(F.col("file_path").endswith(name))
        return read_numbered(files, graph.nodes, limit).orderBy("line")
    start = _one(graph, name)
    if command == "callers":
        tree = traverse.caller_tree(traverse.ranked_callers(e, pagerank(e, spark)), start, depth, spark)
        return tree.orderBy("pos").select("depth", "key", "relation")
    if command == "usages":
        return e.join(start, F.col("src") == start["key"], "left_semi").groupBy("dst").agg(F.sort_array(F.collect_set("relation")).alias("relations")).orderBy("dst")
    if command == "callsites":
        c = graph.calls.join(start, F.col("callee") == start["key"], "left_semi").filter(~is_test_double(F.col("caller")))
        c = c if member is None else c.filter(F.upper("callee_member") == member.upper())
        return c.orderBy("callee_member", "caller", "file_path", "line").limit(limit)
    if command == "trace":
        found = traverse.best_traces(e, graph.endpoints, start, depth, spark)
        if not found.isEmpty():
            return found
        return traverse.trace_fallbacks(e, graph.di, graph.endpoints, depth, spark).join(start, "key", "left_semi").orderBy("kind", "rn")
    if command == "flow":
        calls = graph.calls if member else graph.calls.withColumn("member", F.lit("*"))
        steps = traverse.call_steps(calls, graph.di)
        first = start.select(F.col("key").alias("type"), F.lit(member or "*").alias("member"))
        return traverse.within_budget(traverse.call_tree(steps, first, depth if member else 1, spark), 80)
    if command == "di":
        key = start.head()[0]
        return graph.di.filter((F.col("service") == key) | (F.col("impl") == key)).select("service", "impl", "lifetime", "line").distinct()
    if command == "source":
        spans = graph.nodes.join(start, "key", "left_semi").select(F.col("key").alias("span_id"), "file_path", "start_line", "end_line")
        if member:
            m = longest_spans(graph.members.join(start, F.col("type_key") == start["key"], "left_semi").filter(F.col("member_key") == member.upper()))
            spans = m.select(F.col("member_name").alias("span_id"), "file_path", "start_line", "end_line")
        return slice_spans(read_sources(spark, root or "."), spans, limit).orderBy("line")
    if command in ("explore", "understand"):
        near = traverse.bfs(back, start, depth, spark).withColumn("side", F.lit("caller"))
        deps = traverse.bfs(e.select(F.col("src").alias("at"), F.col("dst").alias("to")), start, depth, spark).withColumn("side", F.lit("dependency"))
        return near.unionByName(deps).orderBy("side", "dist", "key").limit(limit)
    raise SystemExit(f"no such command: {command}")


COMMANDS = ["scan", "stats", "search", "hubs", "semantic", "read-file", "callers", "usages", "callsites", "trace", "flow", "di", "source", "explore", "understand"]

#: Depth where none is given and it is not 3.
DEPTHS = {"trace": 8}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="typegraph", description=__doc__)
    p.add_argument("store", help="folder of the fragment store")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("name", nargs="?", default="", help="a type, a pattern, a query or a folder to scan")
    p.add_argument("member", nargs="?")
    p.add_argument("-d", "--depth", type=int, help="levels, 3 where none is given; of trace the types of a path, 8")
    p.add_argument("-n", "--limit", type=int, default=50)
    p.add_argument("-r", "--root", help="folder of the sources")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("typegraph").getOrCreate()
    store = FragmentStore(spark, a.store)
    if a.command == "scan":
        scan(spark, read_sources(spark, a.name), store)
        a.command = "stats"
    graph = build_graph(store.load(), spark)
    depth = a.depth if a.depth is not None else DEPTHS.get(a.command, 3)
    answer(spark, graph, a.command, a.name, a.member, depth, a.limit, a.root).show(200, truncate=False)


if __name__ == "__main__":
    main()
