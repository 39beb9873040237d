"""Centrality of types: PageRank with a fixed number of iterations."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from typegraph.plans.scratch import Scratch

DAMPING = 0.85
ITERATIONS = 20


def pagerank(
    edges: DataFrame, spark: SparkSession, iterations: int = ITERATIONS, damping: float = DAMPING,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """(key, rank) over distinct edges (src, dst).

    Nodes are both ends of all edges, or the keys of ``nodes``; a target that is no node
    loses its share. The mass of nodes without targets is spread evenly. Nodes get numbers
    once. The edges stay in one partitioning by source over all iterations (kept on the
    executors; a lost part is read again from its table), so an iteration moves one row per
    node and the sums per target, combined on the map side: a target with a tenth of all
    edges is no burden. Ranks are written after each iteration, so lineage stays short.
    """
    scratch = Scratch(spark, "rank")
    e = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    e = scratch.save(e)  # read for nodes, degrees and numbers
    if nodes is None:
        v = e.select(F.col("src").alias("key")).union(e.select(F.col("dst").alias("key"))).distinct()
    else:
        v = nodes.select("key").distinct()
    degree = e.groupBy("src").agg(F.count("*").alias("out"))
    v = v.join(degree, v["key"] == degree["src"], "left").select("key", F.coalesce("out", F.lit(0)).alias("out"))
    v = scratch.save(v.withColumn("id", F.monotonically_increasing_id()))
    size = v.agg(F.count("*").alias("n"), F.count(F.when(F.col("out") == 0, 1)).alias("ends")).head()
    n = size["n"]
    if not n:
        return v.select("key", F.lit(None).cast("double").alias("rank"))
    number = lambda end, name: v.select(F.col("key").alias(end), F.col("id").alias(name))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = e.join(number("src", "s"), "src").join(number("dst", "d"), "dst").select("s", "d")
    pairs = scratch.save(pairs).repartition(parts, "s").persist(StorageLevel.MEMORY_AND_DISK)
    base = v.select("id", "out")
    r, lost = base.withColumn("rank", F.lit(1.0 / n)), size["ends"] / n
    for _ in range(iterations):
        sent = r.filter("out > 0").select(F.col("id").alias("s"), (F.col("rank") / F.col("out")).alias("part"))
        got = sent.join(pairs, "s").groupBy(F.col("d").alias("id")).agg(F.sum("part").alias("got"))
        rank = F.lit((1 - damping) / n + damping * lost / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        seen = Observation()  # the mass of nodes without targets is summed while the ranks are written
        r = base.join(got, "id", "left").select("id", "out", rank.alias("rank"))
        r = scratch.save(r.observe(seen, F.sum(F.when(F.col("out") == 0, F.col("rank"))).alias("lost")))
        lost = seen.get["lost"] or 0.0
    pairs.unpersist()
    return v.select("id", "key").join(r.select("id", "rank"), "id").select("key", "rank")
