"""Size checks in front of broadcasts and partition counts in front of Python work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most so many rows and characters.
BROADCAST_ROWS = 500_000
BROADCAST_CHARS = 32_000_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> DataFrame:
    """``df`` with a broadcast hint if it is measured small, else ``df`` as it is.

    Without the hint the planner shuffles both sides and splits skewed partitions.
    """
    texts = [F.coalesce(F.sum(F.length(c)), F.lit(0)) for c, t in df.dtypes if t == "string"]
    size = df.agg(F.count(F.lit(1)).alias("n"), *[t.alias(f"c{i}") for i, t in enumerate(texts)]).head()
    small = size["n"] <= rows and sum(size[f"c{i}"] for i in range(len(texts))) <= chars
    return F.broadcast(df) if small else df


def spread(df: DataFrame, spark: SparkSession, key: str) -> DataFrame:
    """At least one partition per core, for tables that lie in fewer pieces than that."""
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, F.xxhash64(key))
