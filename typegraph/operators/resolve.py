"""Symbol resolution: which declared type a written name stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node key: the first with a summary, else the first.

    First means by (file_path, start_line, then id where there is one). Rows without a
    key are dropped.
    """
    tie = ["node_id"] if "node_id" in nodes.columns else []
    order = [F.col("summary").isNull().cast("int"), F.col("file_path").asc_nulls_last(), "start_line", *tie]
    w = W.partitionBy("key").orderBy(*order)
    return nodes.filter("key is not null").withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def ambiguous_names(nodes: DataFrame) -> DataFrame:
    """(simple, n_types): simple names that several types share."""
    return nodes.groupBy("simple").agg(F.count_distinct("key").alias("n_types")).filter("n_types > 1")


def shared_parts(a: Column, b: Column) -> Column:
    """Number of leading namespace parts two dotted names have in common."""
    pa, pb = F.split(a, "[.]"), F.split(b, "[.]")
    at = F.sequence(F.lit(1), F.least(F.size(pa), F.size(pb)))
    return F.size(F.filter(at, lambda i: F.slice(pa, 1, i) == F.slice(pb, 1, i)))


def resolve_symbols(refs: DataFrame, symbols: DataFrame, usings: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw, ns, file_key, fqn) for the distinct references (raw, ns, file_key).

    symbols: (simple, fqn, namespace); usings: (file_key, namespace); aliases:
    (file_key, alias, target). The last segment of raw, after the file's alias, is looked
    up case-sensitively. No candidate: the bare name; several: one of the same namespace,
    else of a namespace the file uses, else of the longest shared namespace, the smallest
    name among equals. References are reduced to distinct ones first, so a popular name
    costs one row per file that writes it.
    """
    r = refs.select("raw", F.coalesce("ns", F.lit("")).alias("ns"), "file_key").distinct()
    r = r.withColumn("seg", F.substring_index("raw", ".", -1))
    al = aliases.select(F.col("file_key").alias("__f"), F.col("alias").alias("__a"), F.substring_index("target", ".", -1).alias("__t"))
    r = r.join(al, (F.col("file_key") == F.col("__f")) & (F.col("seg") == F.col("__a")), "left")
    r = r.withColumn("seg", F.coalesce("__t", "seg")).drop("__f", "__a", "__t")
    s = symbols.select(F.col("simple").alias("seg"), "fqn", F.coalesce("namespace", F.lit("")).alias("cand_ns")).distinct()
    c = r.join(s, "seg", "left")
    u = usings.select(F.col("file_key").alias("__f"), F.col("namespace").alias("__u")).distinct().withColumn("used", F.lit(True))
    c = c.join(u, (F.col("file_key") == F.col("__f")) & (F.col("cand_ns") == F.col("__u")), "left").drop("__f", "__u")
    tier = F.when(F.col("cand_ns") == F.col("ns"), 3).when(F.coalesce("used", F.lit(False)), 2).otherwise(1)
    score = F.struct(tier.alias("t"), F.when(tier == 1, shared_parts(F.col("ns"), F.col("cand_ns"))).otherwise(0).alias("s"))
    c = c.withColumn("score", score).groupBy("raw", "ns", "file_key", "seg").agg(
        F.max(F.when(F.col("fqn").isNotNull(), F.col("score"))).alias("top"),
        F.collect_list(F.when(F.col("fqn").isNotNull(), F.struct("score", "fqn"))).alias("all"),
    )
    best = F.array_min(F.transform(F.filter("all", lambda x: x["score"] == F.col("top")), lambda x: x["fqn"]))
    return c.select("raw", "ns", "file_key", F.coalesce(best, F.col("seg")).alias("fqn"))


def fold_steps(start: DataFrame, steps: int, returns: DataFrame) -> DataFrame:
    """Follow chains of members through their return types.

    start: (id, type_key, members array<string>); returns: (type_key, member_key,
    next_key), one row per member. A member that the full name does not have is looked up
    under its last segment. A chain that meets an unknown member is dropped. The loop has as many joins as the longest chain has steps.
    """
    at = start.select("id", "type_key", "members")
    for k in range(steps):
        member = F.upper(F.get("members", k))
        live = at.filter(F.size("members") > k).withColumn("__m", member)
        done = at.filter(F.size("members") <= k)
        r = returns.select(F.col("type_key").alias("__t"), F.col("member_key").alias("__k"), "next_key")
        live = live.join(r, (F.col("type_key") == F.col("__t")) & (F.col("__m") == F.col("__k")), "left").drop("__t", "__k")
        # a type outside of all namespaces may stand for a full name that has no such member
        bare = returns.filter(~F.contains("type_key", F.lit("."))).select(
            F.col("type_key").alias("__t"), F.col("member_key").alias("__k"), F.col("next_key").alias("__next")
        )
        simple = F.substring_index("type_key", ".", -1)
        live = live.join(bare, F.col("next_key").isNull() & (simple == F.col("__t")) & (F.col("__m") == F.col("__k")), "left")
        live = live.withColumn("next_key", F.coalesce("next_key", "__next")).filter("next_key is not null")
        at = done.unionByName(live.select("id", F.col("next_key").alias("type_key"), "members"))
    return at.select("id", "type_key")
