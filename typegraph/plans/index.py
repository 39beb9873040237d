"""From fragments to the resolved graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typegraph.operators.resolve import dedupe_nodes, fold_steps, resolve_symbols
from typegraph.plans.scratch import Scratch

#: Least rounds in which locals that take their type from other locals are resolved.
LOCAL_ROUNDS = 3


@dataclass
class Graph:
    """Resolved tables; keys are upper-case names."""

    nodes: DataFrame  # key, name, simple, namespace, kind, is_public, start_line, end_line, summary, file_path
    edges: DataFrame  # src, dst, relation, line, member, file_path, ord
    calls: DataFrame  # caller, member, callee, callee_member, line, file_path, ord
    di: DataFrame  # service, impl, lifetime, line, file_path, ord
    endpoints: DataFrame  # key, verb, route, method_name, line
    members: DataFrame  # type_key, member_key, member_name, kind, signature, start_line, end_line, is_public, file_path
    names: DataFrame  # key, display


def _rows(fragments: DataFrame, part: str) -> DataFrame:
    return fragments.select("file_path", F.posexplode(part).alias("ord", "x")).select("file_path", "ord", "x.*")


def _key(c: str) -> Column:
    return F.upper(F.col(c))


def build_graph(fragments: DataFrame, spark: SparkSession) -> Graph:
    """Resolve all names of all fragments and put the graph's tables together.

    All written names are resolved in one join of their distinct (name, namespace, file).
    Self edges and blank ends are dropped; chained receivers are folded over return types;
    what stays unknown gives no row. Tables are written once to the shared folder.
    """
    scratch = Scratch(spark, "index")
    nodes = _rows(fragments, "nodes").withColumn("key", _key("name")).withColumn("simple", F.substring_index("name", ".", -1))
    nodes = scratch.save(dedupe_nodes(nodes.drop("ord")))
    symbols = nodes.select("simple", F.col("name").alias("fqn"), "namespace")
    usings = fragments.select(F.col("file_path").alias("file_key"), F.explode("usings").alias("namespace"))
    aliases = fragments.select(F.col("file_path").alias("file_key"), F.explode("aliases").alias("alias", "target"))

    edges, calls, di = _rows(fragments, "edges"), _rows(fragments, "call_sites"), _rows(fragments, "di_bindings")
    sigs = _rows(fragments, "return_sigs")
    pend = _rows(fragments, "pending_calls").withColumn("root", F.col("receiver")[0]).withColumn("id", F.concat_ws("|", "file_path", F.lit("c"), "ord"))
    locs = _rows(fragments, "pending_locals").withColumn("root", F.col("initializer")[0]).withColumn("id", F.concat_ws("|", "file_path", F.lit("l"), "ord"))

    def want(df: DataFrame, name: str, file: Column | None = None) -> DataFrame:
        return df.select(F.col(name).alias("raw"), F.col("ns").alias("ns"), (F.col("file_path") if file is None else file).alias("file_key"))

    none = F.lit("")  # return types are read without a file's usings
    refs = want(edges.filter("not from_resolved"), "from_type").unionByName(want(edges.filter("not to_resolved"), "to_type"))
    refs = refs.unionByName(want(calls, "callee_type")).unionByName(want(di, "service_type")).unionByName(want(di, "implementation_type"))
    refs = refs.unionByName(want(sigs, "return_simple_type", none))
    refs = refs.unionByName(want(pend, "root.type_simple_name")).unionByName(want(locs, "root.type_simple_name"))
    known = scratch.save(resolve_symbols(refs.filter("raw is not null and trim(raw) <> ''"), symbols, usings, aliases))

    def resolved(df: DataFrame, name: str, out: str, file: Column | None = None) -> DataFrame:
        k = known.select(F.col("raw").alias("__r"), F.col("ns").alias("__n"), F.col("file_key").alias("__f"), F.col("fqn").alias(out))
        at = F.col("file_path") if file is None else file
        on = (F.col(name) == F.col("__r")) & (F.coalesce("ns", F.lit("")) == F.col("__n")) & (at == F.col("__f"))
        return df.join(k, on, "left").drop("__r", "__n", "__f")

    e = resolved(resolved(edges, "from_type", "__a"), "to_type", "__b")
    e = e.withColumn("src_name", F.when(F.col("from_resolved"), F.col("from_type")).otherwise(F.col("__a")))
    e = e.withColumn("dst_name", F.when(F.col("to_resolved"), F.col("to_type")).otherwise(F.col("__b")))
    e = e.select("src_name", "dst_name", "relation", "line", F.col("from_member").alias("member"), "file_path", "ord")
    c = resolved(calls, "callee_type", "callee_name").select(
        F.col("caller_type").alias("caller_name"), F.col("caller_member").alias("member"), "callee_name", "callee_member", "line", "file_path", "ord"
    )
    b = resolved(resolved(di, "service_type", "service_name"), "implementation_type", "impl_name")
    di_out = b.select(
        _key("service_name").alias("service"), _key("impl_name").alias("impl"), "lifetime", "line", "file_path", "ord"
    ).filter("service is not null and impl is not null")

    returns = resolved(sigs, "return_simple_type", "next", none).filter("next is not null")
    first = F.min_by("next", F.struct("file_path", "ord")).alias("next")
    returns = returns.groupBy(_key("type_name").alias("type_key"), _key("member_name").alias("member_key")).agg(first)
    returns = scratch.save(returns.select("type_key", "member_key", F.upper("next").alias("next_key")))

    rest = lambda steps: F.transform(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), lambda s: s["name"])
    lr = scratch.save(
        resolved(locs.withColumn("raw0", F.col("root.type_simple_name")), "raw0", "t").select(
            "id", _key("declaring_type").alias("owner"), "declaring_member", "local_name", F.col("root.name").alias("root_name"),
            F.upper("t").alias("type_key"), rest("initializer").alias("members"), "file_path", "ord",
        )
    )
    pr = scratch.save(
        resolved(pend.withColumn("raw0", F.col("root.type_simple_name")), "raw0", "t").select(
            "id", "caller_type", "caller_member", "callee_member", "line", F.col("root.name").alias("root_name"),
            F.upper("t").alias("type_key"), rest("receiver").alias("members"), "file_path", "ord",
        )
    )
    longest = lr.select(F.size("members").alias("n")).union(pr.select(F.size("members"))).agg(F.max("n")).head()[0] or 0
    done = scratch.save(_latest(fold_steps(lr.filter("type_key is not null"), longest, returns).join(lr.drop("type_key"), "id")))
    # a local's place only moves on to later assignments, so the rounds end, in circles as well
    place = ["owner", "declaring_member", "local_name", "file_path", "ord"]
    rounds, moved = 0, not lr.filter("type_key is null").isEmpty()
    while moved:
        open_ = lr.filter("type_key is null").drop("type_key").join(
            done.select("owner", "declaring_member", F.col("local_name").alias("root_name"), F.col("type_key")), ["owner", "declaring_member", "root_name"]
        )
        more = fold_steps(open_, longest, returns).join(lr.drop("type_key"), "id")
        was, done = done, scratch.save(_latest(done.unionByName(_latest(more), allowMissingColumns=True)))
        rounds += 1
        moved = rounds < LOCAL_ROUNDS or not done.join(was, place, "left_anti").isEmpty()
    roots = done.select("owner", F.col("declaring_member").alias("__m"), F.col("local_name").alias("__l"), F.col("type_key").alias("__t"))
    p = pr.join(roots, (F.upper("caller_type") == F.col("owner")) & (F.col("caller_member") == F.col("__m")) & (F.col("root_name") == F.col("__l")), "left")
    p = p.withColumn("type_key", F.coalesce("type_key", "__t")).filter("type_key is not null")
    folded = fold_steps(p, longest, returns).join(pr.drop("type_key", "members"), "id")
    late = scratch.save(
        folded.select(
            _key("caller_type").alias("caller"), F.col("caller_member").alias("member"), F.col("type_key").alias("callee"), "callee_member",
            "line", "file_path", (F.col("ord") + 1_000_000).alias("ord"),
        )
    )
    c_out = c.filter("callee_name is not null").select(
        _key("caller_name").alias("caller"), "member", _key("callee_name").alias("callee"), "callee_member", "line", "file_path", "ord"
    )
    e_out = e.select(_key("src_name").alias("src"), _key("dst_name").alias("dst"), "relation", "line", "member", "file_path", "ord").unionByName(
        late.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("call").alias("relation"), "line", F.col("callee_member").alias("member"), "file_path", "ord")
    ).filter("trim(src) <> '' and trim(dst) <> '' and src <> dst")
    names = nodes.select("key", "name", "simple").withColumn("n", F.expr("count(1) over (partition by upper(simple))"))
    members = _rows(fragments, "members").select(
        _key("type_name").alias("type_key"), _key("member_name").alias("member_key"), "member_name", "kind", "signature", "start_line",
        "end_line", "is_public", "file_path",
    )
    ends = _rows(fragments, "endpoints").select(_key("type_name").alias("key"), "verb", "route", "method_name", "line")
    return Graph(
        nodes, scratch.save(e_out), scratch.save(c_out.unionByName(late)), scratch.save(di_out), ends, members,
        names.select("key", F.when(F.col("n") > 1, F.col("name")).otherwise(F.col("simple")).alias("display")),
    )


def _latest(rows: DataFrame) -> DataFrame:
    """Per local the type of its last assignment."""
    last = F.max_by("type_key", F.struct("file_path", "ord")).alias("type_key")
    at = F.max(F.struct("file_path", "ord")).alias("at")
    g = rows.groupBy("owner", "declaring_member", "local_name").agg(last, at)
    return g.select("owner", "declaring_member", "local_name", "type_key", "at.file_path", "at.ord")


def resolve_input(graph: Graph, name: str) -> DataFrame:
    """(status, key): the type a user means; ok, ambiguous or missing."""
    key = name.strip().upper()
    exact = graph.nodes.select("key").union(graph.edges.select("src")).union(graph.edges.select("dst")).filter(F.col("key") == key).distinct()
    simple = graph.nodes.filter(F.upper("simple") == key).select("key").distinct()
    both = exact.withColumn("tier", F.lit(0)).unionByName(simple.withColumn("tier", F.lit(1)))
    tier = both.agg(F.min("tier").alias("best"))
    hit = both.join(F.broadcast(tier), both["tier"] == F.col("best")).select("key")  # one row
    n = hit.agg(F.count("*").alias("n"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "ok").otherwise("ambiguous")
    return F.broadcast(n).join(hit, F.lit(True), "left").select(status.alias("status"), "key")
