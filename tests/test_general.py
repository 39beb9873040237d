"""The general operators against brute force, and their defined results at the edges."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from typegraph.functions.names import bare_key, file_key, relation_key, target_key
from typegraph.operators.hierarchy import descendants, hierarchy
from typegraph.operators.incremental import Manifest, VersionedState, content_digest, process_batch, readable_digest, run_history
from typegraph.operators.orphans import orphan_references
from typegraph.operators.skew import dominant_keys, key_statistics
from typegraph.plans.scratch import Scratch

T0 = dt.datetime(2025, 1, 1)


def one(spark, expr_of, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expr_of(F.col("v"))).collect()]


def test_names(spark):
    names = {
        " \tFoo ": "FOO", "Foo?": "FOO", "Foo ?": "FOO", "Foo[]": "FOO", "Foo<T>[]?": "FOO", "A.Foo<List<int>>": "A.FOO", "Foo`2": "FOO",
        "global::A.B": "A.B", "Foo<Guid, int>": "FOO", "ref Foo": "FOO", "typeof(Foo)": "FOO", "@class": "CLASS", "Outer<T>.Inner": "OUTER.INNER",
        "A<B<C<D<E<F<G>>>>>>.Inner": "A.INNER", "A<B>.C<D<E>>": "A.C", "List<A>>.Foo": "LIST", "A<B.Inner": "A", "<>": None,
        "In": "IN", "A . B": "A.B", "Foo*": "FOO", "(Foo)": "FOO", "Größe": "GRÖSSE" if "Größe".upper() == "GRÖSSE" else None, "": None, "  ": None, "?": None, None: None,
    }
    assert one(spark, bare_key, list(names)) == list(names.values())
    df = spark.createDataFrame([("A.B", True), ("A.B", False), ("A.B", None), (None, True)], "n string, r boolean")
    assert [r[0] for r in df.select(target_key(F.col("n"), F.col("r"))).collect()] == ["A.B", "B", "B", None]
    assert one(spark, relation_key, [" Inherits\t", None]) == ["inherits", None]


def test_file_spellings(spark):
    deep = ["a/b/c/d/e/f/../../../../../../x.cs", "./a/b/../../x.cs", "x.cs"]
    assert set(one(spark, file_key, deep)) == {"X.CS"}
    assert one(spark, file_key, ["../a", "a/../../b", "/../x", "/a/", "a/.../b"]) == ["../A", "../B", "/X", "/A", "A/.../B"]
    same = ["a/b/c.cs", "A\\B\\C.cs", "./a/b/c.cs", ".\\a\\b\\c.cs", "a//b/c.cs", "a/./b/c.cs", "a/x/../b/c.cs", "a/b/./././c.cs"]
    assert set(one(spark, file_key, same)) == {"A/B/C.CS"}
    assert one(spark, file_key, [None, "a/b/d.cs"]) == [None, "A/B/D.CS"]


def test_key_statistics(spark):
    rows = [(1, "A", "x"), (1, "A", "x"), (2, "A", "x"), (3, "A", None), (4, None, "y"), (None, "A", "z"), (None, "A", "z")]
    df = spark.createDataFrame(rows, "id long, k string, r string").withColumn("n_refs", F.lit("clash"))
    got = {r[0]: (r[1], r[2]) for r in key_statistics(df, F.col("id"), F.col("k"), F.col("r")).collect()}
    assert got == {"A": (5, 2), None: (1, 1)}
    assert key_statistics(df.limit(0), F.col("id"), F.col("k"), F.col("r")).count() == 0


def test_key_statistics_brute(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(3000), None) for _ in range(4000)]
    rows = [(i, "HOT" if i % 3 == 0 else f"K{i % 50}", f"R{i % 7}") for i, _ in rows]
    refs, users = Counter(), defaultdict(set)
    for i, k, r in set(rows):
        refs[k] += 1
        users[k].add(r)
    df = spark.createDataFrame(rows, "id long, k string, r string").repartition(8)
    s = key_statistics(df, F.col("id"), F.col("k"), F.col("r"))
    assert {r[0]: (r[1], r[2]) for r in s.collect()} == {k: (refs[k], len(users[k])) for k in refs}
    top = dominant_keys(s.withColumn("g", F.lit("t")), "g", 2)
    assert {r["type_key"] for r in top.collect()} == {k for k in refs if refs[k] * 100 >= 2 * sum(refs.values())}


def brute_hierarchy(parent):
    out = {}
    for n in parent:
        path, seen = [n], {n: 0}
        while path[-1] in parent:
            nxt = parent[path[-1]]
            if nxt in seen:
                ring = path[seen[nxt] :]
                out[n] = (min(ring), -1, None, "cycle") if n in ring else (min(ring), seen[nxt], None, "below_cycle")
                break
            seen[nxt] = len(path)
            path.append(nxt)
        else:
            out[n] = (path[-1], len(path) - 1, path[::-1], "tree")
    return out


@pytest.mark.parametrize("seed,gap", [(1, 8), (2, 2), (3, 1000)])
def test_hierarchy_brute(spark, seed, gap):
    rnd = random.Random(seed)
    parent = {}
    for c in range(12):  # chains, a bush, circles with tails
        for k in range(rnd.randrange(1, 25)):
            parent[f"c{c}_{k}"] = f"c{c}_{k + 1}"
    for k in range(60):
        parent[f"b{k}"] = f"b{rnd.randrange(k + 1, 61)}"
    for c, size in enumerate((2, 3, 11)):
        for k in range(size):
            parent[f"r{c}_{k}"] = f"r{c}_{(k + 1) % size}"
        for k in range(5):
            parent[f"t{c}_{k}"] = f"t{c}_{k + 1}" if k < 4 else f"r{c}_1"
    want = brute_hierarchy(parent)
    links = spark.createDataFrame(list(parent.items()), "node string, parent string")
    h = hierarchy(links, spark, gap)
    got = {r["node"]: (r["root"], r["depth"], r["path"], r["state"]) for r in h.collect()}
    assert got == want
    if seed == 1:
        pairs = {(r[0], r[1]): r[2] for r in descendants(h).collect()}
        assert pairs == {(a, n): d - k for n, (_, d, p, s) in want.items() if s == "tree" for k, a in enumerate(p[:-1])}


def test_hierarchy_edges(spark):
    rows = [("a", "a"), (None, "b"), ("c", None), ("d", "z"), ("d", "y"), ("d", "y")]
    df = spark.createDataFrame(rows, "node string, parent string").withColumn("path", F.lit(1)).withColumn("state", F.lit("x"))
    got = [tuple(r) for r in hierarchy(df, spark).collect()]
    assert got == [("d", "y", 1, ["y", "d"], "tree")]
    assert hierarchy(df.limit(0), spark).count() == 0


def brute_runs(rows, runs):
    """rows: (key, scanned, id, gone, digest, arrived)"""
    out, state, since = set(), {}, None
    for run_id, start, status in sorted(runs, key=lambda r: r[1]):
        if status != "succeeded":
            continue
        part = defaultdict(list)
        for r in rows:
            if r[5] < start and (since is None or r[5] >= since):
                part[r[0]].append(r)
        since = start
        for key, rs in part.items():
            _, at, fid, gone, digest, _ = max(rs, key=lambda r: (r[1], r[2]))
            old = state.get(key)
            if old and at <= old[0]:
                continue
            if gone:
                case = bool(old) and not old[1]
            else:
                case = not old or old[1] or digest is None or old[2] is None or digest != old[2]
            state[key] = (at, gone, digest)
            if case:
                out.add((run_id, fid))
    return out


def test_runs_brute(spark):
    rnd = random.Random(5)
    hour = dt.timedelta(hours=1)
    rows = []
    for i in range(300):
        scanned = T0 + rnd.randrange(100) * hour
        rows.append((f"f{rnd.randrange(20)}", scanned, i, rnd.random() < 0.15, rnd.choice(["a" * 40, "B" * 40, None]), scanned + rnd.randrange(30) * hour))
    rows += rows[:20]
    runs = [(k, T0 + (k * 13 + 1) * hour, rnd.choice(["succeeded", "succeeded", "failed"])) for k in range(9)]
    df = spark.createDataFrame(rows, "key string, scanned_at timestamp_ntz, fragment_id long, gone boolean, digest string, arrived_at timestamp_ntz")
    rf = spark.createDataFrame([*runs, (99, None, "succeeded"), (98, T0, None)], "run_id long, started_at timestamp_ntz, status string")
    brute = [(k, s, f, g, d and d.upper(), a) for k, s, f, g, d, a in rows]
    got = [tuple(r) for r in run_history(spark, df, rf, Scratch(spark, "t").root).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_runs(brute, runs)
    none = run_history(spark, df, rf.limit(0), Scratch(spark, "t").root)
    assert none.count() == 0
    assert run_history(spark, df.limit(0), rf, Scratch(spark, "t").root).count() == 0


def test_failed_run_leaves_no_trace(spark):
    state = VersionedState(spark, Scratch(spark, "t").root)
    schema = "key string, scanned_at timestamp_ntz, fragment_id long, gone boolean, digest string"
    a = spark.createDataFrame([("x", T0, 1, False, "a" * 40), (None, T0, 7, False, "a" * 40), ("y", None, 2, None, "bad")], schema)
    state.write(state.read([]))  # a run that died before its commit
    first = process_batch(state, a, 1)
    assert {r["fragment_id"] for r in state.read(first.results).filter("is_case").collect()} == {1, 2}
    stale = VersionedState(spark, state.root)
    lost = stale.current()
    process_batch(state, a, 2)
    lost.version += 1
    with pytest.raises(RuntimeError):
        stale.commit(lost)  # another run took the version
    assert {r["fragment_id"] for r in state.read(state.current().results[1:]).filter("is_case").collect()} == set()


def test_two_writers_of_one_version(spark):
    """Of writers that commit the same version at once, one alone succeeds."""
    from concurrent.futures import ThreadPoolExecutor

    root = Scratch(spark, "t").root
    for version in (1, 2, 3):

        def commit(k):
            try:
                VersionedState(spark, root).commit(Manifest(version, [], [f"by {k}"]))
            except RuntimeError:
                return None
            return f"by {k}"

        with ThreadPoolExecutor(8) as pool:
            done = [r for r in pool.map(commit, range(8)) if r]
        assert len(done) == 1 and VersionedState(spark, root).current().results == done


def test_only_touched_buckets_are_read(spark, monkeypatch):
    import typegraph.operators.incremental as inc

    monkeypatch.setattr(inc, "BUCKET_ROWS", 10)
    state = VersionedState(spark, Scratch(spark, "t").root)
    schema = "key string, scanned_at timestamp_ntz, fragment_id long, gone boolean, digest string"
    rows = [(f"k{k}", T0, k, False, "a" * 40) for k in range(200)]
    process_batch(state, spark.createDataFrame(rows, schema), 1)
    at = state.current()
    assert at.buckets == 20
    plan = state.known(at, None, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "(bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]
    new = [("k7", T0 + dt.timedelta(days=1), 900, False, "b" * 40), ("k8", T0 + dt.timedelta(days=1), 901, False, "a" * 40), ("z", T0, 902, True, None)]
    m = process_batch(state, spark.createDataFrame(new, schema), 2)
    assert {r["fragment_id"] for r in state.read(m.results[1:]).filter("is_case").collect()} == {900}
    assert state.known(m).count() == 201


def test_digest_of_columns(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", ""), (4, None, "a")], "i int, x string, y string")
    got = {r["i"]: r["d"] for r in df.select("i", readable_digest(content_digest(["x", "y"])).alias("d")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3 and None not in got.values()


def test_state_is_compacted(spark, monkeypatch):
    import typegraph.operators.incremental as inc

    monkeypatch.setattr(inc, "COMPACT_AFTER", 2)
    state = VersionedState(spark, Scratch(spark, "t").root)
    schema = "key string, scanned_at timestamp_ntz, fragment_id long, gone boolean, digest string"
    for k in range(4):
        df = spark.createDataFrame([("x", T0 + dt.timedelta(days=k), k, False, "abcd"[k] * 40), (f"k{k}", T0, 10 + k, False, "e" * 40)], schema)
        process_batch(state, df, k)
    m = state.current()
    assert len(m.state) <= 2 and len(m.results) == 4
    assert {r["key"]: r["fragment_id"] for r in state.known(m).collect()} == {"x": 3, "k0": 10, "k1": 11, "k2": 12, "k3": 13}


def test_orphans_brute(spark):
    rnd = random.Random(3)
    day = dt.timedelta(hours=7)
    parents, refs = [], []
    for _ in range(60):
        born = T0 + rnd.randrange(300) * day
        parents.append((f"K{rnd.randrange(25)}", born, None if rnd.random() < 0.4 else born + rnd.randrange(1, 200) * day))
    parents += [("EXT", None, None), ("MONTH", dt.datetime(2025, 2, 1), dt.datetime(2025, 3, 1)), ("VOID", T0 + 5 * day, T0 + 4 * day)]
    for i in range(600):
        refs.append(("t", i, rnd.choice([f"K{rnd.randrange(30)}", "EXT", "VOID", "MONTH", None]), T0 + rnd.randrange(400) * day))
    refs += [("u", 1, "MONTH", dt.datetime(2025, 2, 1)), ("u", 2, "MONTH", dt.datetime(2025, 3, 1)), ("u", 3, "NOPE", None), ("u", 4, "K1", None)]
    refs += refs[:50]
    want = set()
    for t, i, k, at in refs:
        own = [(b, d) for kk, b, d in parents if kk == k]
        if k is None or (at is None and own):
            continue
        if at is not None and any((b is None or b <= at) and (d is None or at < d) for b, d in own):
            continue
        reason = "missing" if not own else "deleted" if any(d is not None and d <= at for _, d in own) else "late"
        want.add((t, i, reason, at and at.strftime("%Y-%m")))
    r = spark.createDataFrame(refs, "src_table string, ref_id long, key string, seen_at timestamp_ntz")
    p = spark.createDataFrame(parents, "key string, born timestamp_ntz, died timestamp_ntz")
    got = [tuple(x) for x in orphan_references(spark, r, p).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert orphan_references(spark, r.limit(0), p).count() == 0
    assert orphan_references(spark, r, p.limit(0)).filter("reason <> 'missing'").count() == 0
