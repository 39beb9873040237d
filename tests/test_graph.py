"""Traversal, ranking, resolution, slices and the index against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from typegraph.extract.scan import fragments
from typegraph.operators import resolve, slices, text, traverse
from typegraph.operators.rank import pagerank
from typegraph.plans.index import build_graph, resolve_input
from typegraph.schema import RELATIONS, relation_dim


def random_edges(seed, n=12, m=40):
    rnd = random.Random(seed)
    rel = [r[0] for r in RELATIONS]
    return [(k, f"T{rnd.randrange(n)}", f"T{rnd.randrange(n)}", rnd.choice(rel), rnd.randrange(-1, 30)) for k in range(m)]


@pytest.fixture(scope="module")
def graph(spark):
    rows = [r for r in random_edges(4) if r[1] != r[2]]
    return rows, spark.createDataFrame(rows, "ord long, src string, dst string, relation string, line int").cache()


def dominant(rows):
    weight = {r: w for r, _, w in RELATIONS}
    best = {}
    for o, s, d, rel, _ in rows:
        if (s, d) not in best or (weight[rel], -o) > best[s, d][0]:
            best[s, d] = ((weight[rel], -o), rel)
    return {k: v[1] for k, v in best.items()}


def test_dominant(graph):
    rows, e = graph
    assert {(r[0], r[1]): r[2] for r in traverse.dominant_relations(e).collect()} == dominant(rows)


def test_relation_dim(spark):
    assert relation_dim(spark).count() == 12


def test_pagerank(spark, graph):
    rows, e = graph
    pairs = {(s, d) for _, s, d, _, _ in rows}
    nodes = sorted({x for p in pairs for x in p})
    out = defaultdict(list)
    for s, d in pairs:
        out[s].append(d)
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        lost = sum(r[n] for n in nodes if not out[n])
        nxt = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * lost / len(nodes))
        for s in nodes:
            for d in out[s]:
                nxt[d] += 0.85 * r[s] / len(out[s])
        r = nxt
    got = {x[0]: x[1] for x in pagerank(e, spark).collect()}
    assert got.keys() == r.keys() and all(math.isclose(got[k], r[k], rel_tol=1e-9) for k in r)
    assert pagerank(e.limit(0), spark).count() == 0


def test_caller_tree(spark, graph):
    rows, e = graph
    ranks = spark.createDataFrame([(f"T{k}", float(k % 3)) for k in range(12)], "key string, rank double")
    dom = dominant(rows)
    want = []

    def walk(node, path, pos, depth):
        if depth == 3:
            return
        callers = sorted((s for s, d in dom if d == node), key=lambda s: (-(int(s[1:]) % 3), s))[:20]
        for n, s in enumerate(callers, 1):
            want.append((s, node, depth + 1, (*pos, n)))
            if s not in path:
                walk(s, path | {s}, (*pos, n), depth + 1)

    walk("T1", {"T1"}, (), 0)
    start = spark.createDataFrame([("T1",)], "key string")
    got = traverse.caller_tree(traverse.ranked_callers(e, ranks), start, 3, spark).collect()
    assert sorted((r["key"], r["parent"], r["depth"], tuple(r["pos"])) for r in got) == sorted(want)


def test_traces(spark, graph):
    rows, e = graph
    dom = dominant(rows)
    used = Counter(d for _, d in dom)
    ends = {"T0", "T7"}
    want = set()

    def walk(path, marks, pivoted):
        if path[-1] in ends:
            want.add((path[-1], tuple(path), tuple(marks)))
            return
        if len(path) == 4:
            return
        for (s, d), rel in dom.items():
            msg = rel in ("sends", "handled-by")
            if d == path[-1] and s not in path:
                walk([*path, s], [*marks, "=>" if msg else "->"], pivoted)
            if s == path[-1] and d not in path and not pivoted and not msg and used[d] >= 2:
                walk([*path, d], [*marks, "<->"], True)

    walk(["T3"], [], False)
    key = lambda vs: spark.createDataFrame([(v,) for v in vs], "key string")
    found = traverse.traces(e, key(ends), key(["T3"]), 4, spark)
    assert {(r["endpoint"], tuple(r["path"]), tuple(r["marks"])) for r in found.collect()} == want
    kept = traverse.dedupe_traces(found).collect()
    sure = {r["endpoint"] for r in kept if r["label"] != "heuristic"}
    assert not [r for r in kept if r["label"] == "heuristic" and r["endpoint"] in sure]


def test_bfs(spark, graph):
    rows, e = graph
    steps = e.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    out = defaultdict(set)
    for _, s, d, _, _ in rows:
        out[s].add(d)
    dist, front = {"T2": 0}, ["T2"]
    for k in range(1, 4):
        front = sorted({d for s in front for d in out[s]} - dist.keys())
        dist.update(dict.fromkeys(front, k))
    got = traverse.bfs(steps, spark.createDataFrame([("T2",)], "key string"), 3, spark).collect()
    assert {r["key"]: r["dist"] for r in got} == {k: v for k, v in dist.items() if v}
    assert all(len(r["path"]) == r["dist"] + 1 and r["path"][0] == "T2" for r in got)


def flow(spark, calls, di, depth):
    c = spark.createDataFrame(calls, "ord long, caller string, member string, callee string, callee_member string, line int")
    b = spark.createDataFrame(di, "service string, impl string, ord int")
    start = spark.createDataFrame([("A", "M")], "type string, member string")
    t = traverse.call_tree(traverse.call_steps(c, b), start, depth, spark).orderBy("pos").collect()
    return [(r["callee"], r["via"], r["depth"]) for r in t]


def test_flow_over_bound_circle(spark):
    calls = [(1, "A", "M", "IB", "M", 5), (2, "B", "M", "IA", "M", 9)]
    assert flow(spark, calls, [("IA", "A", 1), ("IB", "B", 2)], 3) == [("IB", "B", 1), ("IA", "A", 2), ("IB", "B", 3)]
    assert flow(spark, calls, [("IA", "A", 1), ("IB", "B", 2)], 5) == [("IB", "B", 1), ("IA", "A", 2), ("IB", "B", 3)]


def test_flow_without_bindings_ends(spark):
    di = [("IX", "X", 1)]
    assert flow(spark, [(1, "A", "M", "IB", "M", 5), (2, "B", "M", "IA", "M", 9)], di, 5) == [("IB", None, 1)]


def test_symbol_tiers(spark):
    refs = [("Order", "Sales.Api", "f1"), ("Order", "Buying", "f1"), ("Order", "Other", "f2"), ("Alias", "Other", "f1"), ("Gone", "Sales", "f1"), ("x.y.Only", None, "f1"), ("Order", "Sales.Core.Deep", "f3")]
    sym = [("Order", "Sales.Order", "Sales"), ("Order", "Buying.Order", "Buying"), ("Order", "Sales.Core.Order", "Sales.Core"), ("Only", "Z.Only", "Z")]
    r = spark.createDataFrame(refs, "raw string, ns string, file_key string")
    s = spark.createDataFrame(sym, "simple string, fqn string, namespace string")
    u = spark.createDataFrame([("f2", "Buying")], "file_key string, namespace string")
    a = spark.createDataFrame([("f1", "Alias", "Foo.Only")], "file_key string, alias string, target string")
    got = {(x[0], x[1], x[2]): x[3] for x in resolve.resolve_symbols(r, s, u, a).collect()}
    assert got == {
        ("Order", "Sales.Api", "f1"): "Sales.Core.Order", ("Order", "Buying", "f1"): "Buying.Order", ("Order", "Other", "f2"): "Buying.Order",
        ("Alias", "Other", "f1"): "Z.Only", ("Gone", "Sales", "f1"): "Gone", ("x.y.Only", "", "f1"): "Z.Only", ("Order", "Sales.Core.Deep", "f3"): "Sales.Core.Order",
    }


def test_shared_parts(spark):
    df = spark.createDataFrame([("", ""), ("A", ""), ("A.B.C", "A.B.D"), ("A", "A")], "a string, b string")
    assert [r[0] for r in df.select(resolve.shared_parts(F.col("a"), F.col("b"))).collect()] == [1, 0, 2, 1]


def test_tokens_and_bm25(spark):
    df = spark.createDataFrame([(1, "PayrollService computes grossPay"), (2, "x gross gross"), (3, None), (4, "")], "doc_id int, text string")
    got = [r[0] for r in df.select(text.tokens(F.col("text"))).collect()]
    assert got[0] == ["payroll", "service", "computes", "gross", "pay"] and got[2] is None
    best = [r["doc_id"] for r in text.bm25(df, "doc_id", "text", "gross", 5).collect()]
    assert best == [2, 1]
    assert text.bm25(df, "doc_id", "text", "zzz !", 5).count() == 0


def test_slices(spark):
    files = spark.createDataFrame([("f", "a\r\nb\nc\rd"), ("g", None)], "file_path string, code string")
    spans = spark.createDataFrame([("s", "f", 2, 9), ("t", "f", 7, 9), ("u", "g", 1, 2), ("v", "f", 0, 2)], "span_id string, file_path string, start_line int, end_line int")
    got = [(r["span_id"], r["line"], r["text"], r["truncated"]) for r in slices.slice_spans(files, spans, 2).orderBy("line").collect()]
    assert got == [("s", 2, "b", True), ("s", 3, "c", True)]
    m = spark.createDataFrame([("T", "a", 1, 5), ("T", "b", 6, 15), ("T", "c", 16, 17)], "type_key string, member_name string, start_line int, end_line int")
    assert {r["member_name"]: (r["shown_lines"], r["show"]) for r in slices.budget_members(m, 8).collect()} == {"a": (5, "full"), "b": (3, "part"), "c": (0, "signature")}


HOST = """
using Lib;
namespace App;
public class Host {
    private readonly IFactory _factory; private readonly Outer _outer;
    public async Task Go() { _factory.Get().Run(); _outer.Inner.Run(); var s = await _factory.GetAsync(); s.Stop(); var t = s; t.Again(); unknown.Foo().Bar(); }
    public void Self() { Host h = null; h.Go(); }
}
"""
LIB = """
namespace Lib { public interface IFactory { IService Get(); Task<IService> GetAsync(); } public class Outer { public IService Inner { get; set; } }
public interface IService { } public class Order { } }
namespace Other { public class Order { } }
"""


def test_index_resolves_chains(spark):
    files = spark.createDataFrame([("host.cs", HOST), ("lib.cs", LIB), ("bad.cs", None)], "file_path string, code string")
    g = build_graph(fragments(files), spark)
    got = {(r["caller"], r["member"], r["callee"], r["callee_member"]) for r in g.calls.collect()}
    service = "LIB.ISERVICE"
    assert {("APP.HOST", "Go", service, "Run"), ("APP.HOST", "Go", service, "Stop"), ("APP.HOST", "Go", service, "Again")} <= got
    assert not [c for c in got if c[3] == "Bar"]
    e = {(r["src"], r["dst"], r["relation"]) for r in g.edges.collect()}
    assert ("APP.HOST", service, "call") in e and ("APP.HOST", "LIB.IFACTORY", "field") in e
    assert not [x for x in e if x[0] == x[1]]
    assert [tuple(r) for r in resolve_input(g, "app.host").collect()] == [("ok", "APP.HOST")]
    assert sorted(tuple(r) for r in resolve_input(g, "Order").collect()) == [("ambiguous", "LIB.ORDER"), ("ambiguous", "OTHER.ORDER")]
    assert [tuple(r) for r in resolve_input(g, "Nope").collect()] == [("missing", None)]
    names = {r["key"]: r["display"] for r in g.names.collect()}
    assert names["LIB.ORDER"] == "Lib.Order" and names["APP.HOST"] == "Host"
