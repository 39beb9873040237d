"""Queries that do the whole job, against brute force over the smallest tables."""

import datetime as dt
import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from typegraph import cli
from typegraph.extract.scan import fragments
from typegraph.operators import incremental, slices, traverse
from typegraph.plans.index import build_graph
from typegraph.plans.scratch import Scratch
from typegraph.queries import graph as queries
from typegraph.schema import MESSAGE_RELATIONS, is_test_double

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")


def source_lines():
    """The lines of every file of the smallest tables."""
    files = duckdb.sql(f"SELECT DISTINCT file_path, code FROM '{SMALL}/source_files.parquet' WHERE code IS NOT NULL").fetchall()
    return [(p, re.split("\r\n|\n|\r", c)) for p, c in files]


@needs_tables
def test_read_numbered(spark):
    rows = entry.queries()["read_numbered"](spark, SMALL).collect()
    want = [(p, k + 1, f"{k + 1:>5} {t}") for p, ls in source_lines() for k, t in enumerate(ls)]
    assert sorted((r["file_path"], r["line"], r["text"]) for r in rows) == sorted(want)
    assert max(r["line"] for r in rows) > 10 and any(r["starts"] and r["line"] > 10 for r in rows)


def test_read_numbered_beyond_five_digits(spark):
    files = spark.createDataFrame([("f", "\n" * 100_000 + "end")], "file_path string, code string")
    nodes = spark.createDataFrame([("T", "f", 100_001)], "key string, file_path string, start_line int")
    last = slices.read_numbered(files, nodes, None).filter(F.col("line") > 100_000).collect()
    assert [tuple(r) for r in last] == [("f", 100_001, "100001 end", "T")]


def simple_paths(start, back, side, ends, most):
    """All (endpoint, path, marks) of a walk as the usual tool takes it, by depth-first search."""
    steps = {}
    for a, b, mark in back + side:
        steps.setdefault(a, []).append((b, mark))
    far = dict.fromkeys(ends, 0)
    for k in range(1, most):
        far |= {a: k for a, _, _ in (x for x in back + side if far.get(x[1]) == k - 1) if a not in far}
    out = set()

    def walk(path, marks):
        if path[-1] in ends:
            out.add((path[-1], tuple(path), tuple(marks)))
            return
        for to, mark in steps.get(path[-1], []):
            if to not in path and not (mark == "<->" and mark in marks) and len(path) + 1 + far.get(to, most) <= most:
                walk([*path, to], [*marks, mark])

    if start in far:
        walk([start], [])
    return out


@needs_tables
def test_trace_paths_whole(spark):
    e = queries.edges(spark, SMALL)
    dom = [tuple(r) for r in traverse.dominant_relations(e).select("src", "dst", "relation", is_test_double(F.col("src"))).collect()]
    users = {}
    for s, t, _, _ in dom:
        users.setdefault(t, set()).add(s)
    back = [(t, s, "=>" if rel in MESSAGE_RELATIONS else "->") for s, t, rel, double in dom if not double]
    side = [(s, t, "<->") for s, t, rel, _ in dom if rel not in MESSAGE_RELATIONS and len(users[t]) >= 2]
    names = {r["key"] for r in queries.nodes(spark, SMALL).select("key").collect()}
    ends = {k for k in names if k.endswith("CONTROLLER")}
    start = min(names & users.keys(), key=lambda k: (-len(users[k]), k))
    found = simple_paths(start, back, side, ends, 8)
    sure = {t for t, _, marks in found if "<->" not in marks}
    want = {(">".join(p), " ".join(m)) for t, p, m in found if "<->" not in m or t not in sure}
    all_ = traverse.dedupe_traces(traverse.traces(e, queries.endpoints(spark, SMALL), queries.start_type(spark, SMALL), 8, spark)).collect()
    assert want and sorted((">".join(r["path"]), " ".join(r["marks"])) for r in all_) == sorted(want)
    assert max(p.count(">") for p, _ in want) == 7
    rows = entry.queries()["trace_paths"](spark, SMALL).collect()
    best = sorted(want, key=lambda x: (x[0].count(">"), x[0].split(">"), x[1].split(" ")))[:15]
    assert [(r["path"], r["marks"]) for r in rows] == best


def test_best_traces_brute(spark):
    """The shortest traces of random graphs with far ends, and the fallbacks of types without any."""
    for seed in (2,):
        rnd = random.Random(seed)
        rel = ["call", "field", "sends", "inherits", "new"]
        rows = [(k, f"T{rnd.randrange(14)}", f"T{rnd.randrange(14)}", rnd.choice(rel)) for k in range(30)]
        rows += [(100 + k, f"Z{k + 1}", f"Z{k}", "call") for k in range(6)] + [(200, "Z0", "T3", "call"), (201, "MOCKZ", "T3", "call")]
        rows = [r for r in rows if r[1] != r[2]]
        e = spark.createDataFrame(rows, "ord long, src string, dst string, relation string").withColumn("line", F.lit(1))
        dom = [tuple(r) for r in traverse.dominant_relations(e).select("src", "dst", "relation", is_test_double(F.col("src"))).collect()]
        users = {}
        for s, t, _, _ in dom:
            users.setdefault(t, set()).add(s)
        back = [(t, s, "=>" if r in MESSAGE_RELATIONS else "->") for s, t, r, double in dom if not double]
        side = [(s, t, "<->") for s, t, r, _ in dom if r not in MESSAGE_RELATIONS and len(users[t]) >= 2]
        ends = {"Z5", "T9"}
        key = lambda vs: spark.createDataFrame([(v,) for v in vs], "key string")
        for start, most, top in (("T3", 7, 25), ("T9", 8, 15), ("NONE", 8, 15)):
            found = simple_paths(start, back, side, ends, most)
            sure = {t for t, _, marks in found if "<->" not in marks}
            want = sorted(((p, m) for t, p, m in found if "<->" not in m or t not in sure), key=lambda x: (len(x[0]), x[0], x[1]))[:top]
            got = traverse.best_traces(e, key(ends), key([start]), most, spark, top).collect()
            assert [(tuple(r["path"]), tuple(r["marks"])) for r in got] == want, (seed, start, most, top)
        di = spark.createDataFrame([("Z9", "Q"), ("T3", "Q"), ("Z9", "P")], "service string, impl string")
        got = {tuple(r) for r in traverse.trace_fallbacks(e, di, key(ends), 3, spark).collect()}
        near, front = set(ends), set(ends)
        for _ in range(2):
            front = {a for a, b, _ in back + side if b in front} - near
            near |= front
        want = {(t, "caller", s, k + 1) for t, ss in users.items() if t not in near for k, s in enumerate(sorted(ss)[:10])}
        want |= {("Z9", "implementation", s, k + 1) for k, s in enumerate(["P", "Q"])}
        assert {r for r in got if r[0] != "T3" or r[1] == "caller"} == want


def test_trace_follows_long_paths_by_default(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    chain = "".join(f"public class Step{k} {{ private readonly Step{k + 1} _next; }} " for k in range(4))
    code = f'namespace App; public class Step4 {{ }} {chain} [Route("api")] public class HeadController {{ private readonly Step0 _s; [HttpGet("x")] public void Get() {{ }} }}'
    (tmp_path / "src" / "A.cs").write_text(code)
    store = str(tmp_path / "store")
    cli.main([store, "scan", str(tmp_path / "src")])
    cli.main([store, "trace", "Step4"])
    assert "APP.HEADCONTROLLER" in capsys.readouterr().out


@needs_tables
def test_source_slice(spark):
    rows = entry.queries()["source_slice"](spark, SMALL).collect()
    texts = {}
    for p, ls in source_lines():
        texts.setdefault(p, []).append(ls)
    want = [
        (n["key"], k, ls[k - 1])
        for n in queries.nodes(spark, SMALL).collect() if (n["start_line"] or 0) >= 1 and n["end_line"]
        for ls in texts.get(n["file_path"], []) for k in range(n["start_line"], min(n["end_line"], len(ls)) + 1)
    ]
    assert sorted((r["span_id"], r["line"], r["text"]) for r in rows) == sorted(want)
    assert max(Counter(r["span_id"] for r in rows).values()) > 20


def test_broken_history_goes_on(spark, monkeypatch):
    rnd, t0, hour = random.Random(3), dt.datetime(2025, 1, 1), dt.timedelta(hours=1)
    rows = []
    for i in range(120):
        scanned = t0 + rnd.randrange(60) * hour
        rows.append((f"f{rnd.randrange(12)}", scanned, i, rnd.random() < 0.15, rnd.choice("abc") * 40, scanned + rnd.randrange(20) * hour))
    df = spark.createDataFrame(rows, "key string, scanned_at timestamp_ntz, fragment_id long, gone boolean, digest string, arrived_at timestamp_ntz")
    runs = [(k, t0 + (k * 15 + 1) * hour, "succeeded") for k in range(6)]
    rf = spark.createDataFrame(runs, "run_id long, started_at timestamp_ntz, status string")
    whole = incremental.run_history(spark, df, rf, Scratch(spark, "t").root).collect()

    real, done = incremental.process_batch, []

    def batch(state, part, run_id, *rest):
        if run_id == 3 and not done.count("broken"):
            done.append("broken")
            raise OSError("the machine went down")
        done.append(run_id)
        return real(state, part, run_id, *rest)

    monkeypatch.setattr(incremental, "process_batch", batch)
    root = Scratch(spark, "t").root
    with pytest.raises(OSError):
        incremental.run_history(spark, df, rf.filter("run_id < 5"), root)
    incremental.run_history(spark, df, rf.filter("run_id < 5"), root)
    incremental.run_history(spark, df, rf.filter("run_id = 5"), root)  # later runs alone
    again = incremental.run_history(spark, df, rf, root).collect()
    assert done == [0, 1, 2, "broken", 3, 4, 5]
    assert whole and sorted(map(tuple, again)) == sorted(map(tuple, whole))


def test_long_chains_of_locals(spark):
    body = "var v0 = _node.Next(); " + "".join(f"var v{k} = v{k - 1}.Next(); v{k}.Use{k}(); " for k in range(1, 9)) + "var p = q.Next(); var q = p.Next();"
    code = f"namespace App; public interface INode {{ INode Next(); }} public class Host {{ private readonly INode _node; public void Go() {{ {body} }} }}"
    g = build_graph(fragments(spark.createDataFrame([("a.cs", code)], "file_path string, code string")), spark)
    got = {r["callee_member"] for r in g.calls.filter("callee = 'APP.INODE'").collect()}
    assert {f"Use{k}" for k in range(1, 9)} <= got
