"""Per-key statistics that do not depend on how rows are spread over keys.

Map-side combining in three native aggregates: each task folds its rows into a bounded
hash table (which spills when full) and only its compact partial states are shuffled.

1. one row per id (the shuffle key is the id, which is never hot),
2. one partial count per (key, referrer),
3. one state per key: every map task of this step sends at most one row per key, so a
   key that holds a third of all rows costs its reducer one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_statistics(df: DataFrame, id_: Column, key: Column, referrer: Column) -> DataFrame:
    """(type_key, n_refs, n_referrers) over the distinct references of ``df``.

    A row repeated under one id counts once; rows without an id count each. Rows without
    a key form the group of the null key. Null referrers count as references but not as
    referrers. An empty table gives an empty result. Other columns are not read.
    """
    rows = df.select(
        id_.alias("__id"),
        F.when(id_.isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)).alias("__no_id"),
        key.alias("__key"),
        referrer.alias("__referrer"),
    ).distinct()
    pairs = rows.groupBy("__key", "__referrer").agg(F.count("*").alias("n"))
    return pairs.groupBy(F.col("__key").alias("type_key")).agg(
        F.sum("n").alias("n_refs"), F.count("__referrer").alias("n_referrers")
    )


def dominant_keys(stats: DataFrame, group: str, share_percent: int) -> DataFrame:
    """Keys that bear at least ``share_percent`` of the references of their group.

    ``stats`` holds (group, type_key, n_refs); the total counts the null key too.
    """
    total = stats.groupBy(F.col(group).alias("__g")).agg(F.sum("n_refs").alias("__total"))
    return (
        stats.join(total, F.col(group) == F.col("__g"))
        .filter(F.col("type_key").isNotNull() & (F.col("n_refs") * 100 >= F.col("__total") * share_percent))
        .drop("__g", "__total")
    )
