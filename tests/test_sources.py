"""Files, the fragment store, scans and the watcher."""

import os
import time

import pytest
from pyspark.sql import functions as F

from typegraph.extract.scan import fragments
from typegraph.sources.files import FragmentStore, is_source, plan_scan, read_sources, scan
from typegraph.streaming.watch import watch_folder, windowed_counts


def put(root, name, code):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(code)


def names(df):
    return sorted(n["name"] for r in df.collect() for n in r["nodes"])


def test_is_source(spark):
    good = ["a/B.cs", "/x/objx/C.CS", "a/Obj/D.cs"]
    bad = ["a/obj/B.cs", "bin/B.cs", "a/.git/x.cs", "node_modules/x.cs", "x.g.cs", "x.Designer.CS", "x.AssemblyInfo.cs", "x.GlobalUsings.g.cs", "x.txt"]
    df = spark.createDataFrame([(p,) for p in good + bad], "p string")
    assert [r[0] for r in df.filter(is_source(F.col("p"))).collect()] == good


def test_scan_and_watch(spark, tmp_path):
    root, store = str(tmp_path / "src"), FragmentStore(spark, str(tmp_path / "store"))
    put(root, "a/A.cs", "class A { }")
    put(root, "obj/X.cs", "class X { }")
    put(root, "B.cs", "﻿class B { }")
    assert names(scan(spark, read_sources(spark, root), store)) == ["A", "B"]
    put(root, "a/A.cs", "class A2 { }")
    put(root, "C.cs", "class C { }")
    os.remove(os.path.join(root, "B.cs"))
    assert names(scan(spark, read_sources(spark, os.path.join(root, "x.sln")), store)) == ["A2", "C"]
    time.sleep(0.1)
    put(root, "D.cs", "class D { }")
    os.remove(os.path.join(root, "C.cs"))
    q = watch_folder(spark, root, store, str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert q.exception() is None
    assert names(store.load()) == ["A2", "D"]
    gone = store.load().filter(F.col("file_path").endswith("D.cs"))
    assert names(store.delete(gone)) == ["A2"]


def test_store_versions(spark, tmp_path, monkeypatch):
    import typegraph.sources.files as files

    monkeypatch.setattr(files, "COMPACT_AFTER", 3)
    store = FragmentStore(spark, str(tmp_path / "store"))
    of = lambda *texts: fragments(spark.createDataFrame([(f"{t[-1]}.cs", f"class {t} {{ }}") for t in texts], "file_path string, code string"))
    for k in range(6):
        store.upsert(of(f"T{k}a", f"T{k}{k}"))
    assert names(store.load()) == sorted(["T5a", *(f"T{k}{k}" for k in range(6))])
    assert len(store._versions()) == 2 and len(store._tables(store._versions()[-1])) <= 3
    stale = store._versions()
    store.change(of("T6a"), spark.createDataFrame([("2.cs",), ("nope.cs",)], "file_path string"))
    monkeypatch.setattr(FragmentStore, "_versions", lambda self: stale)
    with pytest.raises(RuntimeError):
        store.upsert(of("T7a"))  # another writer has placed that version
    monkeypatch.undo()
    assert names(store.load()) == sorted(["T6a", *(f"T{k}{k}" for k in (0, 1, 3, 4, 5))])


def test_unreadable_texts_are_not_gone(spark):
    stored = spark.createDataFrame([("a", "H"), ("b", "H"), ("c", None)], "file_path string, hash string")
    now = spark.createDataFrame([("a", None), ("c", "x"), ("d", None)], "file_path string, code string")
    got = {r["file_path"]: r["state"] for r in plan_scan(now, stored).collect()}
    assert got == {"a": "changed", "b": "gone", "c": "changed", "d": "new"}


def test_windowed_counts(spark, tmp_path):
    rows = [("2025-01-01 00:00:01", "a"), ("2025-01-01 00:00:02", "a"), ("2025-01-01 00:06:00", "b"), ("2025-01-01 01:00:00", "c")]
    spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp_ntz("t").alias("t"), "k").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("t timestamp_ntz, k string").parquet(str(tmp_path / "in"))
    q = windowed_counts(s, "t", "k", "5 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("wc").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["key"], r["n"]) for r in spark.table("wc").collect()) == [("a", 2), ("b", 1), ("c", 1)]
