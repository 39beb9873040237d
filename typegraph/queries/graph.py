"""Queries of the graph's own operators over the code-graph tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from typegraph.functions.names import bare_key, file_key, last_segment, relation_key, target_key
from typegraph.operators import resolve, slices, text, traverse
from typegraph.operators.rank import pagerank
from typegraph.plans.kept import kept
from typegraph.plans.scratch import Scratch
from typegraph.queries.general import _bare, _file, _target
from typegraph.schema import MESSAGE_RELATIONS, RELATIONS, is_test_double, relation_order
from typegraph.session import table
from typegraph.streaming.watch import windowed_counts

ORACLE_SCALE = 10  # digits to which ranks are compared


@kept("type_nodes")
def nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row per declared type."""
    n = table(spark, d, "type_nodes").select(
        bare_key(F.col("type_name")).alias("key"), F.trim("type_name").alias("name"), F.col("ns").alias("namespace"), "kind",
        F.coalesce("is_public", F.lit(False)).alias("is_public"), "start_line", "end_line", "summary", "file_path", "node_id",
    )
    return resolve.dedupe_nodes(n.distinct()).withColumn("simple", last_segment(F.col("key")))


@kept("type_edges", "type_nodes")
def edges(spark: SparkSession, d: str) -> DataFrame:
    """Resolved edges (ord, src, dst, relation, line, member) without void and self edges."""
    e = table(spark, d, "type_edges").select(
        F.col("edge_id").alias("ord"), bare_key(F.col("from_type")).alias("src"),
        target_key(F.col("to_type"), F.col("to_resolved")).alias("to"), F.coalesce("to_resolved", F.lit(False)).alias("full"),
        F.coalesce(relation_key(F.col("relation")), F.lit("uses")).alias("relation"), "line", F.col("from_member").alias("member"),
    ).filter("src is not null and to is not null").distinct()
    return _declared(spark, d, e, "to", "dst").filter("src <> dst").drop("full")


def combine_route(prefix: Column, action: Column) -> Column:
    """One route of a prefix and an action part; empty parts do not count."""
    parts = F.filter(F.array(F.regexp_replace(prefix, "^/+|/+$", ""), F.regexp_replace(action, "^/+|/+$", "")), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def _declared(spark: SparkSession, d: str, rows: DataFrame, col: str, out: str) -> DataFrame:
    """Full name of the declared type for simple names; rows with ``full`` stay."""
    n = table(spark, d, "type_nodes").select(bare_key(F.col("type_name")).alias("__full")).filter("__full is not null")
    n = n.groupBy(last_segment(F.col("__full")).alias("__simple")).agg(F.min("__full").alias("__full"))
    j = rows.join(n, (F.col(col) == F.col("__simple")) & ~F.col("full"), "left")
    return j.withColumn(out, F.coalesce("__full", col)).drop("__full", "__simple", col)


@kept("call_sites", "type_nodes")
def calls(spark: SparkSession, d: str) -> DataFrame:
    """Resolved call-sites (ord, caller, member, callee, callee_member, line)."""
    c = table(spark, d, "call_sites").select(
        F.col("call_id").alias("ord"), bare_key(F.col("caller_type")).alias("caller"), F.col("caller_member").alias("member"),
        target_key(F.col("callee_type"), F.lit(False)).alias("to"), F.lit(False).alias("full"), "callee_member", "line",
    ).filter("caller is not null and to is not null").distinct()
    return _declared(spark, d, c, "to", "callee").drop("full")


@kept("di_bindings", "type_nodes")
def di(spark: SparkSession, d: str) -> DataFrame:
    """Bindings (ord, service, impl, lifetime, line)."""
    b = table(spark, d, "di_bindings").select(
        F.col("binding_id").alias("ord"), bare_key(F.col("service_type")).alias("s"), bare_key(F.col("implementation_type")).alias("i"),
        F.coalesce(relation_key(F.col("lifetime")), F.lit("")).alias("lifetime"), "line",
    ).filter("s is not null and i is not null").distinct()
    b = b.withColumn("full", F.instr("s", ".") > 0)
    b = _declared(spark, d, b, "s", "service").drop("full").withColumn("full", F.instr("i", ".") > 0)
    return _declared(spark, d, b, "i", "impl").drop("full")


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Types that serve requests: here, those named as controllers."""
    return nodes(spark, d).filter(F.col("key").endswith("CONTROLLER")).select("key")


def in_degrees(e: DataFrame) -> DataFrame:
    """(key, n_in): distinct sources of each target."""
    return e.select("src", "dst").distinct().groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("n_in"))


@kept("type_edges", "type_nodes")
def start_type(spark: SparkSession, d: str) -> DataFrame:
    """The declared type with most distinct users."""
    n = nodes(spark, d).select("key")
    return in_degrees(edges(spark, d)).join(n, "key").orderBy(F.desc("n_in"), "key").limit(1).select("key")


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the graph's parts."""
    parts = {
        "nodes": nodes(spark, d), "edges": edges(spark, d), "call_sites": calls(spark, d), "di_bindings": di(spark, d),
        "endpoints": endpoints(spark, d), "files": table(spark, d, "source_files").select("file_path").distinct(),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def node_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The row that stands for each type."""
    return nodes(spark, d).select("key", "node_id", "start_line", F.coalesce("summary", F.lit("")).alias("summary"))


def ambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    """Simple names of several types."""
    return resolve.ambiguous_names(nodes(spark, d))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    """Edges, distinct targets and distinct sources of every type."""
    e = edges(spark, d)
    out = e.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("n_edges"), F.count_distinct("dst").alias("n_out"))
    return out.join(in_degrees(e), "key", "full").na.fill(0, ["n_edges", "n_out", "n_in"])


def dominant_relation(spark: SparkSession, d: str) -> DataFrame:
    """The weightiest relation of each pair of types."""
    return traverse.dominant_relations(edges(spark, d))


@kept("type_edges", "type_nodes")
def rank(spark: SparkSession, d: str) -> DataFrame:
    """PageRank of every type."""
    return pagerank(edges(spark, d), spark).withColumn("rank", F.round("rank", ORACLE_SCALE))


def pagerank_all(spark: SparkSession, d: str) -> DataFrame:
    """PageRank of every type, in parts per million."""
    return rank(spark, d).select("key", F.round(F.col("rank") * 1e6).cast("bigint").alias("ppm"))


def hubs(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen most central declared types that are no test doubles (a report)."""
    e = edges(spark, d)
    r = rank(spark, d).join(nodes(spark, d).select("key", "kind"), "key").filter(~is_test_double(F.col("key")))
    return r.join(in_degrees(e), "key", "left").orderBy(F.desc("rank"), "key").limit(15).select("key", "kind", F.coalesce("n_in", F.lit(0)).alias("n_in"))


def hubs_external(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen most central types that are no test doubles, undeclared ones included (a report)."""
    known = nodes(spark, d).select("key", F.lit(False).alias("external"))
    r = rank(spark, d).join(known, "key", "left").filter(~is_test_double(F.col("key"))).join(in_degrees(edges(spark, d)), "key", "left")
    return r.orderBy(F.desc("rank"), "key").limit(15).select("key", F.coalesce("external", F.lit(True)).alias("external"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def name_search(spark: SparkSession, d: str) -> DataFrame:
    """Types whose name contains a pattern: exact, prefix and other matches by rank (top 30)."""
    p = "LEDGER"
    n = nodes(spark, d).filter(F.instr("key", p) > 0)
    kind = (
        F.when(F.col("key") == p, 0).when(F.col("simple") == p, 1).when(F.col("simple").startswith(p) | F.col("key").startswith(p), 2).otherwise(3)
    )
    e = edges(spark, d)
    uses = e.groupBy(F.col("src").alias("key")).agg(F.count_distinct("dst").alias("n_out"))
    bound = di(spark, d)
    bound = bound.select(F.col("service").alias("key")).union(bound.select("impl")).distinct().withColumn("bound", F.lit(True))
    out = n.withColumn("match", kind).join(rank(spark, d), "key", "left").join(in_degrees(e), "key", "left").join(uses, "key", "left").join(bound, "key", "left")
    return out.orderBy("match", F.coalesce("rank", F.lit(0.0)).desc(), "key").limit(30).select(
        "key", "kind", "match", F.coalesce("n_in", F.lit(0)).alias("n_callers"), F.coalesce("n_out", F.lit(0)).alias("n_uses"),
        F.coalesce("bound", F.lit(False)).alias("bound"),
    )


def usages(spark: SparkSession, d: str) -> DataFrame:
    """What every type uses: relations in their order, first lines, users of the target."""
    e = edges(spark, d)
    rel = F.sort_array(F.collect_set(F.struct(relation_order(F.col("relation")).alias("o"), F.col("relation").alias("r"))))
    lines = F.slice(F.sort_array(F.collect_set(F.when(F.col("line") > 0, F.col("line")))), 1, 3)
    g = e.groupBy("src", "dst").agg(
        F.array_join(F.transform(rel, lambda x: x["r"]), ",").alias("relations"),
        F.array_join(F.transform(lines, lambda x: x.cast("string")), ",").alias("lines"),
    )
    known = nodes(spark, d).select(F.col("key").alias("dst"), F.lit(False).alias("external"))
    return g.join(in_degrees(e).withColumnRenamed("key", "dst"), "dst").join(known, "dst", "left").select(
        "src", "dst", "relations", "lines", F.col("n_in").alias("used_by"), F.coalesce("external", F.lit(True)).alias("external")
    )


def callers_tree(spark: SparkSession, d: str) -> DataFrame:
    """Three levels of callers of the most used type."""
    c = traverse.ranked_callers(edges(spark, d), rank(spark, d))
    t = traverse.caller_tree(c, start_type(spark, d), 3, spark)
    return t.select("key", "parent", "relation", "depth", F.array_join(F.transform("pos", lambda x: x.cast("string")), ".").alias("pos"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("endpoint", F.array_join("path", ">").alias("path"), F.array_join("marks", " ").alias("marks"), "label")


def trace_paths(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen shortest paths of up to eight types from the most used type back to controllers (a report)."""
    return _shown(traverse.best_traces(edges(spark, d), endpoints(spark, d), start_type(spark, d), 8, spark))


def trace_short(spark: SparkSession, d: str) -> DataFrame:
    """All paths of up to three types from the most used type back to controllers."""
    return _shown(traverse.dedupe_traces(traverse.traces(edges(spark, d), endpoints(spark, d), start_type(spark, d), 3, spark)))


def trace_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Callers and implementations of every type from which no controller is within eight types."""
    return traverse.trace_fallbacks(edges(spark, d), di(spark, d), endpoints(spark, d), 8, spark)


def _back(e: DataFrame) -> DataFrame:
    return e.filter(~is_test_double(F.col("src"))).select(F.col("dst").alias("at"), F.col("src").alias("to"))


def bfs_callers(spark: SparkSession, d: str) -> DataFrame:
    """Types within two steps that use the most used type."""
    return traverse.bfs(_back(edges(spark, d)), start_type(spark, d), 2, spark).select("seed", "key", "dist")


def bfs_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Types within three steps that its first user needs."""
    e = edges(spark, d)
    first = e.join(start_type(spark, d), e["dst"] == F.col("key"), "left_semi").agg(F.min("src").alias("key")).filter("key is not null")
    return traverse.bfs(e.select(F.col("src").alias("at"), F.col("dst").alias("to")), first, 3, spark).select("seed", "key", "dist")


def nearby_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Controllers within two steps that use the most used type, with a chain."""
    found = traverse.bfs(_back(edges(spark, d)), start_type(spark, d), 2, spark).join(endpoints(spark, d), "key", "left_semi")
    return found.select("seed", "key", "dist", F.array_join(F.reverse("path"), ">").alias("chain"))


def _flow_start(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d).filter("member is not null")
    n = c.groupBy(F.col("caller").alias("type"), "member").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "type", "member").limit(1).select("type", "member")


def flow_tree(spark: SparkSession, d: str) -> DataFrame:
    """Two levels of what the busiest member orchestrates, at most 80 rows as printed."""
    c = calls(spark, d).filter("member is not null and callee_member is not null")
    s = traverse.call_steps(c, di(spark, d))
    t = traverse.call_tree(s, _flow_start(spark, d), 2, spark)
    t = traverse.within_budget(t, 80)
    return t.select("n", "depth", "callee", "callee_member", F.coalesce("via", F.lit("")).alias("via"), "line")


def flow_members(spark: SparkSession, d: str) -> DataFrame:
    """One level: the calls of every member, in line order."""
    w = W.partitionBy("caller", "member").orderBy("line", "ord")
    c = calls(spark, d).filter("member is not null")
    return c.select("caller", "member", "callee", "callee_member", "line", F.row_number().over(w).alias("n"))


def call_sites_of(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty call-sites of the most called type, with the total (a report)."""
    c = calls(spark, d).filter(~is_test_double(F.col("caller")))
    top = calls(spark, d).groupBy("callee").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "callee").limit(1).select("callee")
    c = c.join(top, "callee", "left_semi")
    total = c.agg(F.count("*").alias("total"))
    rows = c.orderBy(F.col("callee_member").asc_nulls_first(), "caller", "ord").limit(50)
    return rows.crossJoin(F.broadcast(total)).select("callee", "callee_member", "caller", "member", "line", "total")


def di_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Bindings of every type, as service and as implementation."""
    b = di(spark, d)
    line = F.min_by("line", "ord").alias("line")
    a = b.groupBy(F.col("service").alias("key"), F.col("impl").alias("other"), "lifetime").agg(line).withColumn("side", F.lit("service"))
    c = b.groupBy(F.col("impl").alias("key"), F.col("service").alias("other"), "lifetime").agg(line).withColumn("side", F.lit("impl"))
    return a.unionByName(c)


def symbol_resolve(spark: SparkSession, d: str) -> DataFrame:
    """What every distinct unresolved target stands for, by file, namespace and usings."""
    e = table(spark, d, "type_edges").filter(~F.coalesce("to_resolved", F.lit(False)))
    refs = e.select(bare_key(F.col("to_type")).alias("raw"), F.upper("ns").alias("ns"), file_key(F.col("file_path")).alias("file_key"))
    refs = refs.filter("raw is not null and file_key is not null")
    n = nodes(spark, d)
    symbols = n.select("simple", F.col("key").alias("fqn"), F.expr("substring(key, 1, greatest(0, length(key) - length(simple) - 1))").alias("namespace"))
    f = table(spark, d, "file_fragments").select(file_key(F.col("file_path")).alias("file_key"), "usings", "aliases", "scanned_at", "fragment_id")
    f = f.groupBy("file_key").agg(F.max(F.struct("scanned_at", "fragment_id", "usings", F.map_entries("aliases").alias("al"))).alias("r"))
    usings = f.select("file_key", F.explode("r.usings").alias("u")).select("file_key", F.upper("u").alias("namespace"))
    aliases = f.select("file_key", F.explode("r.al").alias("a")).select("file_key", F.upper("a.key").alias("alias"), F.upper("a.value").alias("target"))
    return resolve.resolve_symbols(refs, symbols, usings, aliases)


def node_documents(spark: SparkSession, d: str) -> DataFrame:
    """(key, text): name, summary and the first forty targets of each public type."""
    n = nodes(spark, d).filter("is_public")
    raw = table(spark, d, "type_edges").select("edge_id", bare_key(F.col("from_type")).alias("key"), F.trim("to_type").alias("t")).filter("t <> ''").distinct()
    w = W.partitionBy("key").orderBy("edge_id")
    first = raw.withColumn("rn", F.row_number().over(w)).filter("rn <= 40")
    t = first.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "t"))), lambda x: x["t"]), " ").alias("targets"))
    return n.join(t, "key", "left").select("key", F.concat_ws(" ", "name", "summary", "targets").alias("text"))


def search_semantic(spark: SparkSession, d: str) -> DataFrame:
    """The ten types that fit a free-text intent best."""
    q = "priced ledger rows for the tenant"
    return text.bm25(node_documents(spark, d), "key", "text", q, 10).select(F.col("doc_id").alias("key"), F.round("score", 6).alias("score"))


def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    """The ten documents that fit a query best."""
    return text.bm25(table(spark, d, "documents"), "doc_id", "text", "stale cache of the symbol table", 10).select("doc_id", F.round("score", 6).alias("score"))


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    """Document and collection frequency of every term of the documents."""
    tf = text.term_frequencies(table(spark, d, "documents"), "doc_id", "text")
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def route_combine(spark: SparkSession, d: str) -> DataFrame:
    """Routes put together from a prefix with a controller token and an action part."""
    n = endpoints(spark, d).select("key", F.regexp_replace(last_segment(F.col("key")), "CONTROLLER$", "").alias("c"))
    return n.select("key", combine_route(F.concat(F.lit("/api/"), "c", F.lit("/")), F.lit("{id}")).alias("route"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every file's text without its byte order mark."""
    f = table(spark, d, "source_files").select("file_path", "code").distinct()
    return f.select("file_path", F.upper(F.sha1(F.regexp_replace("code", "^﻿", ""))).alias("digest"))


def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    """New, changed, gone and same files between the first and the last observation."""
    f = table(spark, d, "file_fragments").select(file_key(F.col("file_path")).alias("key"), "hash", "is_gone", "scanned_at", "fragment_id")
    mid = F.expr("timestamp_ntz'2025-04-01'")
    last = F.max_by(F.struct("hash", "is_gone"), F.struct("scanned_at", "fragment_id")).alias("r")
    old = f.filter(F.col("scanned_at") < mid).groupBy("key").agg(last).filter("not r.is_gone").select("key", F.upper("r.hash").alias("old"), F.lit(1).alias("was"))
    new = f.groupBy("key").agg(last).filter("not r.is_gone").select("key", F.upper("r.hash").alias("new"), F.lit(1).alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.coalesce(F.col("old") == F.col("new"), F.lit(False)), "same").otherwise("changed")
    return old.join(new, "key", "full").select("key", state.alias("state"))


def fragment_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last observation of every file."""
    f = table(spark, d, "file_fragments").select(file_key(F.col("file_path")).alias("key"), "fragment_id", "scanned_at")
    return f.groupBy("key").agg(F.max(F.struct("scanned_at", "fragment_id")).alias("r")).select("key", "r.fragment_id")


def source_slice(spark: SparkSession, d: str) -> DataFrame:
    """All lines behind every declared type that lies in a known file."""
    files = table(spark, d, "source_files").select("file_path", "code").distinct()
    spans = nodes(spark, d).select(F.col("key").alias("span_id"), "file_path", "start_line", "end_line")
    return slices.slice_spans(files, spans, None).select("span_id", "line", "text")


def read_numbered(spark: SparkSession, d: str) -> DataFrame:
    """All numbered lines of every file, with the types that begin there."""
    files = table(spark, d, "source_files").select("file_path", "code").distinct()
    return slices.read_numbered(files, nodes(spark, d), None)


def source_budget(spark: SparkSession, d: str) -> DataFrame:
    """What a budget of 300 lines shows of the types of each namespace, in line order."""
    n = nodes(spark, d).filter("namespace is not null and start_line >= 1 and end_line >= start_line")
    m = n.select(F.upper("namespace").alias("type_key"), F.col("key").alias("member_name"), "start_line", "end_line")
    return slices.budget_members(m, 300).select("type_key", "member_name", "shown_lines", "show")


def compact_context(spark: SparkSession, d: str) -> DataFrame:
    """Of every declared type in use: its five best callers and the number of further ones (neither
    where all callers are test doubles), its first five targets with their relations, its bindings."""
    e = edges(spark, d)
    c = traverse.ranked_callers(e, rank(spark, d), 5)
    top = c.groupBy("dst").agg(F.sort_array(F.collect_list(F.struct("rn", "src", "relation"))).alias("t"))
    w = W.partitionBy("src").orderBy("first", "dst")
    uses = e.groupBy("src", "dst").agg(F.min("ord").alias("first")).withColumn("rn", F.row_number().over(w)).filter("rn <= 5")
    uses = uses.join(traverse.dominant_relations(e), ["src", "dst"]).groupBy(F.col("src").alias("key"))
    uses = uses.agg(F.sort_array(F.collect_list(F.struct("rn", F.col("dst").alias("src"), "relation"))).alias("u"))
    b = di(spark, d)
    bound = b.select(F.col("service").alias("key"), F.concat(F.lit("as "), "impl").alias("b"))
    bound = bound.union(b.select("impl", F.concat(F.lit("for "), "service"))).groupBy("key").agg(F.sort_array(F.collect_set("b")).alias("b"))
    out = nodes(spark, d).select("key").join(in_degrees(e), "key").join(top, F.col("key") == F.col("dst"), "left")
    out = out.join(uses, "key", "left").join(bound, "key", "left")
    shown = lambda c: F.coalesce(
        F.array_join(F.transform(c, lambda x: F.concat(x["src"], F.lit(" ("), x["relation"], F.lit(")"))), ", "), F.lit("")
    )
    extra = F.when(F.col("t").isNull(), 0).otherwise(F.col("n_in") - F.size("t")).cast("bigint")
    return out.select("key", shown("t").alias("callers"), extra.alias("extra"), shown("u").alias("targets"), F.coalesce(F.array_join("b", ", "), F.lit("")).alias("bindings"))


def understand(spark: SparkSession, d: str) -> DataFrame:
    """One row per declared type: kind, size, degree, bindings both ways, endpoint flag."""
    e, b = edges(spark, d), di(spark, d)
    out = e.groupBy(F.col("src").alias("key")).agg(F.count_distinct("dst").alias("n_out"))
    impls = b.groupBy(F.col("service").alias("key")).agg(F.array_join(F.sort_array(F.collect_set("impl")), ",").alias("impls"))
    services = b.groupBy(F.col("impl").alias("key")).agg(F.array_join(F.sort_array(F.collect_set("service")), ",").alias("services"))
    n = nodes(spark, d).join(in_degrees(e), "key", "left").join(out, "key", "left").join(impls, "key", "left").join(services, "key", "left")
    return n.select(
        "key", "kind", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"), F.coalesce("n_in", F.lit(0)).alias("n_in"),
        F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("impls", F.lit("")).alias("impls"), F.coalesce("services", F.lit("")).alias("services"),
        F.col("key").endswith("CONTROLLER").alias("endpoint"),
    )


def explore(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of a pattern with what surrounds them within two steps."""
    e = edges(spark, d)
    seeds = nodes(spark, d).filter(F.instr("simple", "LEDGERSERVICE") > 0).orderBy("key").limit(3).select("key")
    near = traverse.bfs(_back(e), seeds, 2, spark).withColumn("side", F.lit("caller"))
    deps = traverse.bfs(e.select(F.col("src").alias("at"), F.col("dst").alias("to")), seeds, 2, spark).withColumn("side", F.lit("dependency"))
    return near.unionByName(deps).groupBy("seed", "side", "dist").agg(F.count("*").alias("n"))


def return_chain(spark: SparkSession, d: str) -> DataFrame:
    """Two-step chains of members, each leading to the type its first call goes to."""
    r = calls(spark, d).filter("member is not null").groupBy(F.col("caller").alias("type_key"), F.upper("member").alias("member_key"))
    r = r.agg(F.min_by("callee", "ord").alias("next_key"))
    two = r.select(F.col("type_key").alias("t1"), F.col("member_key").alias("m1"), F.col("next_key").alias("n1")).join(
        r, F.col("n1") == F.col("type_key")
    )
    start = two.select(F.concat_ws(">", "t1", "m1", "member_key").alias("id"), F.col("t1").alias("type_key"), F.array("m1", "member_key").alias("members"))
    return resolve.fold_steps(start, 2, r).select("id", "type_key")


def rollup_events(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and day with subtotals."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.rollup("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def session_events(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user: gaps of more than thirty minutes part them."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("p", F.lag("ts").over(w))
    e = e.withColumn("first", F.when(F.col("p").isNull() | (F.col("ts") > F.col("p") + F.expr("interval 30 minutes")), 1).otherwise(0))
    return e.groupBy("user_id").agg(F.sum("first").alias("n_sessions"), F.count("*").alias("n_events"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Sum of a JSON property per event type."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(k).alias("n"))


def semi_external(spark: SparkSession, d: str) -> DataFrame:
    """References per known external type."""
    x = table(spark, d, "external_types").select(F.upper("simple_name").alias("key")).distinct()
    return edges(spark, d).groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("n")).join(x, "key", "left_semi")


def anti_gone(spark: SparkSession, d: str) -> DataFrame:
    """Declared types in files that are not among the source files."""
    f = table(spark, d, "source_files").select(file_key(F.col("file_path")).alias("f"))
    n = nodes(spark, d)
    return n.join(f, file_key(n["file_path"]) == F.col("f"), "left_anti").select("key")


def stream_events(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type, counted by a stream that reads all there is and ends."""
    scratch = Scratch(spark, "stream")
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = windowed_counts(rows, "ts", "event_type", "1 hour", "1 hour")
    out = counts.writeStream.outputMode("complete").option("checkpointLocation", scratch.root + "/state").trigger(availableNow=True)
    q = out.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(scratch.root + "/out")).start()
    q.awaitTermination()
    return spark.read.schema(counts.schema).parquet(scratch.root + "/out").select(
        F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), F.col("key").alias("event_type"), "n"
    )


QUERIES = {
    f.__name__: f
    for f in (
        stream_events, graph_stats, node_dedup, ambiguous_names, degrees, dominant_relation, pagerank_all, hubs, hubs_external, name_search, usages, callers_tree,
        trace_paths, trace_short, trace_fallback, bfs_callers, bfs_dependencies, nearby_endpoints, flow_tree, flow_members, call_sites_of, di_resolve,
        symbol_resolve, search_semantic, bm25_documents, term_stats, route_combine, content_hash, incremental_diff, fragment_upsert,
        source_slice, read_numbered, source_budget, compact_context, understand, explore, return_chain, rollup_events,
        session_events, json_props, semi_external, anti_gone,
    )
}


def _simple(c: str) -> str:
    return f"regexp_extract({c}, '[^.]*$')"


_DOUBLE = "regexp_matches(regexp_extract({}, '[^.]*$'), '(TESTS?$|MOCK|FAKE|STUB|BUILDER)')"
_WEIGHT = "CASE {} " + " ".join(f"WHEN '{r}' THEN {w}" for r, _, w in RELATIONS) + " ELSE 1 END"
_ORDER = "CASE {} " + " ".join(f"WHEN '{r}' THEN {o}" for r, o, _ in RELATIONS) + f" ELSE {len(RELATIONS)} END"

_BASE = f"""
WITH RECURSIVE node0 AS (
  SELECT DISTINCT {_bare('type_name')} AS key, trim(type_name) AS name, ns, kind, coalesce(is_public, false) AS is_public,
    start_line, end_line, summary, file_path, node_id FROM type_nodes),
node AS MATERIALIZED (
  SELECT *, {_simple('key')} AS simple FROM node0 WHERE key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY summary IS NULL, file_path NULLS LAST, start_line NULLS FIRST, node_id) = 1),
decl AS MATERIALIZED (SELECT simple, min(key) AS full_name FROM node GROUP BY 1),
edge AS MATERIALIZED (
  SELECT ord, src, CASE WHEN full_ THEN t ELSE coalesce(full_name, t) END AS dst, relation, line, member FROM (
    SELECT DISTINCT edge_id AS ord, {_bare('from_type')} AS src, {_target('to_type', 'to_resolved')} AS t, coalesce(to_resolved, false) AS full_,
      coalesce(lower(trim(relation)), 'uses') AS relation, line, from_member AS member FROM type_edges) LEFT JOIN decl ON t = simple
  WHERE src IS NOT NULL AND t IS NOT NULL AND src <> CASE WHEN full_ THEN t ELSE coalesce(full_name, t) END),
call AS MATERIALIZED (
  SELECT ord, caller, member, coalesce(full_name, t) AS callee, callee_member, line FROM (
    SELECT DISTINCT call_id AS ord, {_bare('caller_type')} AS caller, caller_member AS member, {_target('callee_type', 'false')} AS t,
      callee_member, line FROM call_sites) LEFT JOIN decl ON t = simple
  WHERE caller IS NOT NULL AND t IS NOT NULL),
bind AS MATERIALIZED (
  SELECT ord, CASE WHEN contains(s, '.') THEN s ELSE coalesce(a.full_name, s) END AS service,
    CASE WHEN contains(i, '.') THEN i ELSE coalesce(b.full_name, i) END AS impl, lifetime, line FROM (
    SELECT DISTINCT binding_id AS ord, {_bare('service_type')} AS s, {_bare('implementation_type')} AS i,
      coalesce(lower(trim(lifetime)), '') AS lifetime, line FROM di_bindings) LEFT JOIN decl a ON s = a.simple LEFT JOIN decl b ON i = b.simple
  WHERE s IS NOT NULL AND i IS NOT NULL),
ends AS (SELECT key FROM node WHERE key LIKE '%CONTROLLER'),
deg AS MATERIALIZED (SELECT dst AS key, count(DISTINCT src) AS n_in FROM edge GROUP BY 1),
start AS MATERIALIZED (SELECT key FROM deg JOIN node USING (key) ORDER BY n_in DESC, key LIMIT 1),
dom AS MATERIALIZED (SELECT src, dst, arg_max(relation, ({_WEIGHT.format('relation')}, -ord)) AS relation FROM edge GROUP BY 1, 2)"""


def _rank_sql() -> str:
    out = """,
pe AS MATERIALIZED (SELECT DISTINCT src, dst FROM edge),
pv AS MATERIALIZED (SELECT key, count(dst) AS o FROM (SELECT src AS key FROM pe UNION SELECT dst FROM pe) LEFT JOIN pe ON key = src GROUP BY 1),
pn AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM pv),
r0 AS MATERIALIZED (SELECT key, o, 1.0 / n AS r FROM pv, pn)"""
    for k in range(1, 21):
        p = f"r{k - 1}"
        out += f""",
r{k} AS MATERIALIZED (
  SELECT pv.key, pv.o, 0.15 / n + 0.85 * (coalesce(g.s, 0) + (SELECT coalesce(sum(r), 0) FROM {p} WHERE o = 0) / n) AS r
  FROM pv CROSS JOIN pn LEFT JOIN (SELECT dst AS key, sum(r / o) AS s FROM {p} JOIN pe ON {p}.key = pe.src GROUP BY 1) g ON pv.key = g.key)"""
    return out + ", rank AS MATERIALIZED (SELECT key, round(r, 10) AS rank FROM r20)"


_RANK = _BASE + _rank_sql()
_CALLERS = _RANK + f""",
ranked AS MATERIALIZED (
  SELECT dst, src, relation, rn FROM (
    SELECT dst, src, relation, row_number() OVER (PARTITION BY dst ORDER BY coalesce(rank, 0) DESC, src) AS rn
    FROM dom LEFT JOIN rank ON rank.key = dom.src WHERE NOT {_DOUBLE.format('src')}) WHERE rn <= 20)"""
_TF = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '(\p{Ll})(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{Nd}]+'), lambda x: length(x) >= 2) AS ts FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY 1, 2)"""


def _bfs_sql(steps: str, start: str, depth: int) -> str:
    return _BASE + f""",
st AS MATERIALIZED ({steps}),
w AS (SELECT key AS seed, key, 0 AS dist FROM ({start})
  UNION SELECT seed, st.t, dist + 1 FROM w JOIN st ON w.key = st.a WHERE dist < {depth}),
found AS (SELECT seed, key, min(dist) AS dist FROM w GROUP BY 1, 2 HAVING min(dist) > 0)"""


_STEPS = _BASE + f""",
used AS (SELECT key FROM deg WHERE n_in >= 2),
st AS MATERIALIZED (
  SELECT dst AS a, src AS t, CASE WHEN relation IN {MESSAGE_RELATIONS} THEN '=>' ELSE '->' END AS mark FROM dom WHERE NOT {_DOUBLE.format('src')}
  UNION ALL SELECT src, dst, '<->' FROM dom WHERE relation NOT IN {MESSAGE_RELATIONS} AND dst IN (SELECT key FROM used))"""
_BACK = f"SELECT DISTINCT dst AS a, src AS t FROM edge WHERE NOT {_DOUBLE.format('src')}"
_FWD = "SELECT DISTINCT src AS a, dst AS t FROM edge"
_SEEDS = "SELECT key FROM node WHERE contains(simple, 'LEDGERSERVICE') ORDER BY key LIMIT 3"
_NODE_DOC = _BASE + f""",
raw AS (SELECT DISTINCT edge_id, {_bare('from_type')} AS key, trim(to_type) AS t FROM type_edges WHERE trim(to_type) <> ''),
tg AS (SELECT key, string_agg(t, ' ' ORDER BY edge_id) AS targets FROM (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY key ORDER BY edge_id) <= 40) GROUP BY 1),
doc AS (SELECT node.key AS doc_id, concat_ws(' ', name, summary, targets) AS text FROM node LEFT JOIN tg USING (key) WHERE is_public)"""


def _bm25_sql(prelude: str, table_: str, words: list[str], out: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return prelude + f""",
dd AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: length(x) >= 2) AS ts FROM {table_}),
tot AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM dd),
h AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM dd) WHERE term IN ({listed}) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
SELECT doc_id AS {out}, round(s, 6) AS score FROM (
  SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))), 9) AS s
  FROM h JOIN df USING (term) CROSS JOIN tot GROUP BY doc_id) ORDER BY s DESC, doc_id LIMIT 10"""


_FRAG = f"SELECT DISTINCT {_file('file_path')} AS key, upper(hash) AS hash, is_gone, scanned_at, fragment_id FROM file_fragments"

SQL = {
    "graph_stats": _BASE + """
SELECT 'nodes' AS part, count(*) AS n FROM node UNION ALL SELECT 'edges', count(*) FROM edge UNION ALL SELECT 'call_sites', count(*) FROM call
UNION ALL SELECT 'di_bindings', count(*) FROM bind UNION ALL SELECT 'endpoints', count(*) FROM ends
UNION ALL SELECT 'files', count(DISTINCT file_path) FROM source_files""",
    "node_dedup": _BASE + " SELECT key, node_id, start_line, coalesce(summary, '') AS summary FROM node",
    "ambiguous_names": _BASE + " SELECT simple, count(DISTINCT key) AS n_types FROM node GROUP BY 1 HAVING count(DISTINCT key) > 1",
    "degrees": _BASE + """, o AS (SELECT src AS key, count(*) AS n_edges, count(DISTINCT dst) AS n_out FROM edge GROUP BY 1)
SELECT key, coalesce(n_edges, 0) AS n_edges, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN deg USING (key)""",
    "dominant_relation": _BASE + " SELECT * FROM dom",
    "pagerank_all": _RANK + " SELECT key, CAST(round(rank * 1e6) AS BIGINT) AS ppm FROM rank",
    "hubs": _RANK + f""" SELECT key, kind, coalesce(n_in, 0) AS n_in FROM rank JOIN node USING (key) LEFT JOIN deg USING (key)
WHERE NOT {_DOUBLE.format('key')} ORDER BY rank DESC, key LIMIT 15""",
    "hubs_external": _RANK + f""" SELECT key, key NOT IN (SELECT key FROM node) AS external, coalesce(n_in, 0) AS n_in FROM rank LEFT JOIN deg USING (key)
WHERE NOT {_DOUBLE.format('key')} ORDER BY rank DESC, key LIMIT 15""",
    "name_search": _RANK + """, uses AS (SELECT src AS key, count(DISTINCT dst) AS n_out FROM edge GROUP BY 1),
b AS (SELECT service AS key FROM bind UNION SELECT impl FROM bind)
SELECT key, kind, CASE WHEN key = 'LEDGER' THEN 0 WHEN simple = 'LEDGER' THEN 1 WHEN starts_with(simple, 'LEDGER') OR starts_with(key, 'LEDGER') THEN 2 ELSE 3 END AS match,
  coalesce(n_in, 0) AS n_callers, coalesce(n_out, 0) AS n_uses, key IN (SELECT key FROM b) AS bound
FROM node LEFT JOIN rank USING (key) LEFT JOIN deg USING (key) LEFT JOIN uses USING (key)
WHERE contains(key, 'LEDGER') ORDER BY match, coalesce(rank, 0) DESC, key LIMIT 30""",
    "usages": _BASE + f""", g AS (
  SELECT src, dst, array_to_string(list_transform(list_sort(list(DISTINCT ({_ORDER.format('relation')}, relation))), lambda x: x[2]), ',') AS relations,
    coalesce(array_to_string(list_sort(list(DISTINCT line) FILTER (line > 0))[1:3], ','), '') AS lines FROM edge GROUP BY 1, 2)
SELECT src, dst, relations, lines, n_in AS used_by, dst NOT IN (SELECT key FROM node) AS external FROM g JOIN deg ON dst = key""",
    "callers_tree": _CALLERS + """,
t AS (
  SELECT src AS key, start.key AS parent, relation, 1 AS depth, [rn] AS pos, [start.key, src] AS path, src <> start.key AS open FROM start JOIN ranked ON dst = start.key
  UNION ALL
  SELECT ranked.src, t.key, ranked.relation, depth + 1, list_append(pos, rn), list_append(path, ranked.src), NOT list_contains(path, ranked.src)
  FROM t JOIN ranked ON t.key = ranked.dst WHERE depth < 3 AND open)
SELECT key, parent, relation, depth, array_to_string(pos, '.') AS pos FROM t""",
    "trace_short": _STEPS + """,
w AS (
  SELECT key AS node, [key] AS path, CAST([] AS VARCHAR[]) AS marks, false AS pivoted FROM start
  UNION ALL
  SELECT t, list_append(path, t), list_append(marks, mark), pivoted OR mark = '<->' FROM w JOIN st ON node = a
  WHERE node NOT IN (SELECT key FROM ends) AND len(path) < 3 AND NOT list_contains(path, t) AND NOT (pivoted AND mark = '<->')),
f AS (
  SELECT DISTINCT node AS endpoint, array_to_string(path, '>') AS path, array_to_string(marks, ' ') AS marks,
    CASE WHEN list_contains(marks, '<->') THEN 'heuristic' WHEN list_contains(marks, '=>') THEN 'exact-message' WHEN len(path) <= 3 THEN 'direct' ELSE 'nearby' END AS label
  FROM w WHERE node IN (SELECT key FROM ends))
SELECT * FROM f WHERE label <> 'heuristic' OR endpoint NOT IN (SELECT endpoint FROM f WHERE label <> 'heuristic')""",
    "trace_fallback": _STEPS + """,
near AS (SELECT key, 0 AS dist FROM ends UNION SELECT a, dist + 1 FROM near JOIN st ON near.key = st.t WHERE dist < 7),
c AS (SELECT key, 'caller' AS kind, other, row_number() OVER (PARTITION BY key ORDER BY other) AS rn FROM (SELECT DISTINCT dst AS key, src AS other FROM edge)),
i AS (SELECT key, 'implementation' AS kind, other, row_number() OVER (PARTITION BY key ORDER BY other) AS rn FROM (SELECT DISTINCT service AS key, impl AS other FROM bind))
SELECT key, kind, other, CAST(rn AS INTEGER) AS rn FROM (SELECT * FROM c WHERE rn <= 10 UNION ALL SELECT * FROM i) WHERE key NOT IN (SELECT key FROM near)""",
    "bfs_callers": _bfs_sql(_BACK, "SELECT key FROM start", 2) + " SELECT seed, key, dist FROM found",
    "bfs_dependencies": _bfs_sql(_FWD, "SELECT min(src) AS key FROM edge WHERE dst IN (SELECT key FROM start)", 3) + " SELECT seed, key, dist FROM found",
    "nearby_endpoints": _BASE + f""",
st AS MATERIALIZED ({_BACK}),
w AS (SELECT key AS seed, key, 0 AS dist, [key] AS path FROM start
  UNION ALL SELECT seed, st.t, dist + 1, list_append(path, st.t) FROM w JOIN st ON w.key = st.a WHERE dist < 2 AND NOT list_contains(path, st.t)),
f AS (SELECT seed, key, dist, path FROM w QUALIFY row_number() OVER (PARTITION BY seed, key ORDER BY dist, path) = 1)
SELECT seed, key, dist, array_to_string(list_reverse(path), '>') AS chain FROM f WHERE dist > 0 AND key IN (SELECT key FROM ends)""",
    "flow_tree": _BASE + """,
c AS MATERIALIZED (SELECT * FROM call WHERE member IS NOT NULL AND callee_member IS NOT NULL),
has AS (SELECT DISTINCT caller, member FROM c),
pick AS (
  SELECT callee, callee_member, arg_min(impl, (CASE WHEN has.caller IS NULL THEN 1 ELSE 0 END, b.ord, impl)) AS via
  FROM (SELECT DISTINCT callee, callee_member FROM c) q JOIN bind b ON b.service = q.callee LEFT JOIN has ON has.caller = b.impl AND has.member = q.callee_member
  WHERE NOT EXISTS (SELECT 1 FROM has h WHERE h.caller = q.callee AND h.member = q.callee_member) GROUP BY 1, 2),
s AS MATERIALIZED (SELECT c.*, via, coalesce(via, callee) AS into_, row_number() OVER (PARTITION BY caller, member ORDER BY line, ord) AS rn FROM c LEFT JOIN pick USING (callee, callee_member)),
fs AS (SELECT caller, member FROM call WHERE member IS NOT NULL GROUP BY 1, 2 ORDER BY count(*) DESC, caller, member LIMIT 1),
t AS (
  SELECT s.callee, s.callee_member, s.via, s.line, 1 AS depth, [rn] AS pos, into_ AS type, s.callee_member AS mem, [into_ || '.' || s.callee_member] AS seen, true AS open FROM fs JOIN s USING (caller, member)
  UNION ALL
  SELECT s.callee, s.callee_member, s.via, s.line, depth + 1, list_append(pos, s.rn), s.into_, s.callee_member, list_append(seen, s.into_ || '.' || s.callee_member), NOT list_contains(seen, s.into_ || '.' || s.callee_member)
  FROM t JOIN s ON t.type = s.caller AND t.mem = s.member WHERE depth < 2 AND open)
SELECT CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS n, depth, callee, callee_member, coalesce(via, '') AS via, line FROM t ORDER BY pos LIMIT 80""",
    "flow_members": _BASE + " SELECT caller, member, callee, callee_member, line, CAST(row_number() OVER (PARTITION BY caller, member ORDER BY line NULLS FIRST, ord) AS INTEGER) AS n FROM call WHERE member IS NOT NULL",
    "call_sites_of": _BASE + f""", top AS (SELECT callee FROM call GROUP BY 1 ORDER BY count(*) DESC, callee LIMIT 1),
c AS (SELECT * FROM call WHERE callee IN (SELECT callee FROM top) AND NOT {_DOUBLE.format('caller')})
SELECT callee, callee_member, caller, member, line, (SELECT count(*) FROM c) AS total FROM c ORDER BY callee_member NULLS FIRST, caller, ord LIMIT 50""",
    "di_resolve": _BASE + """
SELECT service AS key, impl AS other, lifetime, arg_min(line, ord) AS line, 'service' AS side FROM bind GROUP BY 1, 2, 3
UNION ALL SELECT impl, service, lifetime, arg_min(line, ord), 'impl' FROM bind GROUP BY 1, 2, 3""",
    "symbol_resolve": _BASE + f""",
rf AS (SELECT DISTINCT {_bare('to_type')} AS raw, coalesce(upper(ns), '') AS ns, {_file('file_path')} AS file_key FROM type_edges WHERE NOT coalesce(to_resolved, false)),
fr AS (SELECT {_file('file_path')} AS file_key, usings, aliases FROM file_fragments QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY scanned_at DESC, fragment_id DESC) = 1),
us AS (SELECT DISTINCT file_key, upper(unnest(usings)) AS u FROM fr),
al AS (SELECT file_key, upper(e.key) AS a, regexp_extract(upper(e.value), '[^.]*$') AS t FROM (SELECT file_key, unnest(map_entries(aliases)) AS e FROM fr)),
q AS (SELECT raw, ns, rf.file_key, coalesce(al.t, {_simple('raw')}) AS seg FROM rf LEFT JOIN al ON al.file_key = rf.file_key AND al.a = {_simple('raw')} WHERE raw IS NOT NULL AND rf.file_key IS NOT NULL),
k AS (
  SELECT q.*, node.key AS fqn, substring(key, 1, greatest(0, length(key) - length(simple) - 1)) AS cns FROM q LEFT JOIN node ON node.simple = q.seg),
m AS (SELECT k.*, CASE WHEN cns = ns THEN 3 WHEN us.u IS NOT NULL THEN 2 ELSE 1 END AS tier,
    CASE WHEN fqn IS NULL THEN NULL ELSE len(list_filter(range(1, 1 + least(len(string_split(ns, '.')), len(string_split(cns, '.')))), lambda i: string_split(ns, '.')[1:i] = string_split(cns, '.')[1:i])) END AS shared
  FROM k LEFT JOIN us ON us.file_key = k.file_key AND us.u = cns)
SELECT raw, ns, file_key, coalesce(fqn, seg) AS fqn FROM m
QUALIFY row_number() OVER (PARTITION BY raw, ns, file_key ORDER BY tier DESC, CASE WHEN tier = 1 THEN shared ELSE 0 END DESC, fqn) = 1""",
    "search_semantic": _bm25_sql(_NODE_DOC, "doc", ["priced", "ledger", "rows", "for", "the", "tenant"], "key"),
    "bm25_documents": _bm25_sql("WITH z AS (SELECT 1)", "documents", ["stale", "cache", "of", "the", "symbol", "table"], "doc_id"),
    "term_stats": _TF + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY 1",
    "route_combine": _BASE + f" SELECT key, '/api/' || regexp_replace({_simple('key')}, 'CONTROLLER$', '') || '/{{id}}' AS route FROM ends",
    "content_hash": "SELECT DISTINCT file_path, upper(sha1(CASE WHEN starts_with(code, chr(65279)) THEN substring(code, 2) ELSE code END)) AS digest FROM source_files",
    "incremental_diff": f"""
WITH f AS ({_FRAG}),
o AS (SELECT key, arg_max((hash, is_gone), (scanned_at, fragment_id)) AS r FROM f WHERE scanned_at < TIMESTAMP '2025-04-01' GROUP BY 1),
n AS (SELECT key, arg_max((hash, is_gone), (scanned_at, fragment_id)) AS r FROM f GROUP BY 1),
ol AS (SELECT key, r[1] AS h, 1 AS w FROM o WHERE NOT r[2]), nl AS (SELECT key, r[1] AS h, 1 AS w FROM n WHERE NOT r[2])
SELECT key, CASE WHEN ol.w IS NULL THEN 'new' WHEN nl.w IS NULL THEN 'gone' WHEN coalesce(ol.h = nl.h, false) THEN 'same' ELSE 'changed' END AS state FROM ol FULL JOIN nl USING (key)""",
    "fragment_upsert": f"WITH f AS ({_FRAG}) SELECT key, arg_max(fragment_id, (scanned_at, fragment_id)) AS fragment_id FROM f GROUP BY 1",
    "source_slice": _BASE + """,
fl AS (SELECT DISTINCT file_path, regexp_split_to_array(code, '\r\n|\n|\r') AS ls FROM source_files WHERE code IS NOT NULL),
sp AS (SELECT key, start_line, ls[start_line:end_line] AS cut FROM node JOIN fl USING (file_path) WHERE start_line >= 1 AND end_line >= start_line AND start_line <= len(ls))
SELECT key AS span_id, CAST(unnest(range(start_line, start_line + len(cut))) AS INTEGER) AS line, unnest(cut) AS text FROM sp""",
    "read_numbered": _BASE + """,
fl AS (SELECT DISTINCT file_path, regexp_split_to_array(code, '\r\n|\n|\r') AS ls FROM source_files WHERE code IS NOT NULL),
rw AS (SELECT file_path, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS i, unnest(ls) AS l FROM fl),
mk AS (SELECT file_path, start_line, string_agg(DISTINCT key, ',' ORDER BY key) AS starts FROM node GROUP BY 1, 2)
SELECT rw.file_path, i AS line, CASE WHEN i < 100000 THEN lpad(CAST(i AS VARCHAR), 5, ' ') ELSE CAST(i AS VARCHAR) END || ' ' || l AS text, coalesce(starts, '') AS starts
FROM rw LEFT JOIN mk ON mk.file_path = rw.file_path AND mk.start_line = i""",
    "source_budget": _BASE + """,
m AS (SELECT upper(ns) AS type_key, key AS member_name, end_line - start_line + 1 AS n, sum(end_line - start_line + 1) OVER (PARTITION BY upper(ns) ORDER BY start_line, key ROWS UNBOUNDED PRECEDING) AS total
  FROM node WHERE ns IS NOT NULL AND start_line >= 1 AND end_line >= start_line)
SELECT type_key, member_name, CAST(greatest(0, least(n, 300 - (total - n))) AS BIGINT) AS shown_lines,
  CASE WHEN total <= 300 THEN 'full' WHEN greatest(0, least(n, 300 - (total - n))) > 0 THEN 'part' ELSE 'signature' END AS show FROM m""",
    "compact_context": _CALLERS + """, c AS (SELECT dst, string_agg(src || ' (' || relation || ')', ', ' ORDER BY rn) AS callers, count(*) AS n FROM ranked WHERE rn <= 5 GROUP BY 1),
u AS (SELECT src, string_agg(dst || ' (' || relation || ')', ', ' ORDER BY first, dst) AS targets FROM (
  SELECT src, dst, min(ord) AS first FROM edge GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY min(ord), dst) <= 5) JOIN dom USING (src, dst) GROUP BY 1),
b AS (SELECT key, string_agg(DISTINCT b, ', ' ORDER BY b) AS bindings FROM (SELECT service AS key, 'as ' || impl AS b FROM bind UNION ALL SELECT impl, 'for ' || service FROM bind) GROUP BY 1)
SELECT node.key, coalesce(callers, '') AS callers, CASE WHEN n IS NULL THEN 0 ELSE n_in - n END AS extra, coalesce(targets, '') AS targets, coalesce(bindings, '') AS bindings
FROM node JOIN deg USING (key) LEFT JOIN c ON c.dst = node.key LEFT JOIN u ON u.src = node.key LEFT JOIN b ON b.key = node.key""",
    "understand": _BASE + """, o AS (SELECT src AS key, count(DISTINCT dst) AS n_out FROM edge GROUP BY 1),
i AS (SELECT service AS key, string_agg(DISTINCT impl, ',' ORDER BY impl) AS impls FROM bind GROUP BY 1),
s AS (SELECT impl AS key, string_agg(DISTINCT service, ',' ORDER BY service) AS services FROM bind GROUP BY 1)
SELECT key, kind, end_line - start_line + 1 AS n_lines, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(impls, '') AS impls, coalesce(services, '') AS services, key LIKE '%CONTROLLER' AS endpoint
FROM node LEFT JOIN deg USING (key) LEFT JOIN o USING (key) LEFT JOIN i USING (key) LEFT JOIN s USING (key)""",
    "return_chain": _BASE + """,
r AS (SELECT caller AS t, upper(member) AS m, arg_min(callee, ord) AS n FROM call WHERE member IS NOT NULL GROUP BY 1, 2)
SELECT a.t || '>' || a.m || '>' || b.m AS id, b.n AS type_key FROM r a JOIN r b ON a.n = b.t""",
    "rollup_events": "SELECT event_type, day, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY ROLLUP (event_type, day)",
    "session_events": """
SELECT user_id, CAST(sum(f) AS BIGINT) AS n_sessions, count(*) AS n_events FROM (
  SELECT user_id, CASE WHEN coalesce(ts > lag(ts) OVER w + INTERVAL 30 MINUTE, true) THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1""",
    "stream_events": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1",
    "semi_external": _BASE + " SELECT dst AS key, count(*) AS n FROM edge WHERE dst IN (SELECT upper(simple_name) FROM external_types) GROUP BY 1",
    "anti_gone": _BASE + f" SELECT key FROM node WHERE NOT EXISTS (SELECT 1 FROM source_files f WHERE {_file('f.file_path')} = {_file('node.file_path')})",
}
_NEAR = _bfs_sql(_BACK, _SEEDS, 2)
SQL["explore"] = _NEAR + f""",
s2 AS MATERIALIZED ({_FWD}),
w2 AS (SELECT key AS seed, key, 0 AS dist FROM ({_SEEDS}) UNION SELECT seed, s2.t, dist + 1 FROM w2 JOIN s2 ON w2.key = s2.a WHERE dist < 2),
f2 AS (SELECT seed, key, min(dist) AS dist FROM w2 GROUP BY 1, 2 HAVING min(dist) > 0)
SELECT seed, 'caller' AS side, dist, count(*) AS n FROM found GROUP BY 1, 2, 3 UNION ALL SELECT seed, 'dependency', dist, count(*) FROM f2 GROUP BY 1, 2, 3"""
