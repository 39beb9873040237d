"""References whose target does not exist at their own time.

Keys are dictionary-encoded: a key's range comes from its hash, its number within the
range from a window over that range alone, so ids are dense without one task seeing
all keys. Per range and month, the referred keys and the keys that exist throughout that
month are bitmaps of 64-bit words of which only non-zero words are stored (the
compression). ``referred AND NOT existing`` is one join of words; surviving bits decode to
the few (key, month) pairs in doubt, and only references of those are compared with the
merged lifetimes of their target. All references are reduced to distinct (key, month)
before any join on keys, so popular targets weigh as much as others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from typegraph.plans.scratch import Scratch

#: Keys of one range: two to the power of RANGE_BITS on average.
RANGE_BITS = 14
_FAR = "timestamp_ntz'9999-12-31'"
_OLD = "timestamp_ntz'0001-01-01'"


def month_of(ts: Column) -> Column:
    """Months since year 0."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_text(m: Column) -> Column:
    """YYYY-MM of a month number."""
    return F.format_string("%04d-%02d", F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"))


def merged_lifetimes(rows: DataFrame) -> DataFrame:
    """rows (key, born, died) to disjoint lifetimes per key, gaps kept.

    A null ``born`` has existed ever since, a null ``died`` still exists; a row that
    died before it was born never existed.
    """
    r = rows.select("key", F.coalesce("born", F.expr(_OLD)).alias("born"), F.coalesce("died", F.expr(_FAR)).alias("died"))
    r = r.filter("born < died").distinct()
    w = W.partitionBy("key").orderBy("born", "died")
    r = r.withColumn("before", F.max("died").over(w.rowsBetween(W.unboundedPreceding, -1)))
    r = r.withColumn("island", F.sum(F.when(F.col("before") >= F.col("born"), 0).otherwise(1)).over(w))
    return r.groupBy("key", "island").agg(F.min("born").alias("born"), F.max("died").alias("died")).drop("island")


def orphan_references(spark: SparkSession, refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(src_table, ref_id, reason, seen_month) of the references without a target.

    refs: (src_table, ref_id, key, seen_at); parents: (key, born, died). A reference
    without a key is none; one without a time is an orphan only if its name never
    existed, with a null month. Repeated references come out once.
    """
    scratch = Scratch(spark, "orphans")
    refs = refs.filter("key is not null").withColumn("m", month_of(F.col("seen_at")))
    used = scratch.save(refs.select("key", "m").distinct())
    lives = scratch.save(merged_lifetimes(parents).join(used.select("key").distinct(), "key", "left_semi"))
    buried = parents.groupBy("key").agg(F.min("died").alias("first_death"))

    keys = used.select("key").distinct()
    ranges = max(1, keys.count() >> RANGE_BITS)
    codes = keys.withColumn("rng", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
    codes = codes.withColumn("id", F.row_number().over(W.partitionBy("rng").orderBy("key")) - 1)
    codes = scratch.save(codes)

    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    word = F.shiftright("id", 6)

    def bitmap(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.join(codes, "key").groupBy("rng", "m", word.alias("word")).agg(F.bit_or(bit).alias(name))

    span = used.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    # a month is full if the life starts at or before its first instant and ends after its last
    full_from = F.when(
        F.col("born") == F.trunc(F.col("born"), "month").cast("timestamp_ntz"), month_of(F.col("born"))
    ).otherwise(month_of(F.col("born")) + 1)
    full_to = month_of(F.col("died")) - 1
    whole = lives.crossJoin(F.broadcast(span)).select(  # one row
        "key", F.greatest(full_from, F.col("lo")).alias("a"), F.least(full_to, F.col("hi")).alias("b")
    )
    whole = whole.filter("a <= b").select("key", F.explode(F.sequence("a", "b")).alias("m"))
    referred = bitmap(used.filter("m is not null"), "referred")
    existing = bitmap(whole, "existing")
    left = referred.join(existing, ["rng", "m", "word"], "left").select(
        "rng", "m", "word",
        F.col("referred").bitwiseAND(F.bitwise_not(F.coalesce("existing", F.lit(0).cast("long")))).alias("left"),
    )
    bits = left.filter("left <> 0").select(
        "rng", "m", F.explode(F.expr("transform(filter(sequence(0, 63), i -> (shiftright(left, i) & 1L) = 1L), i -> word * 64 + i)")).alias("id")
    )
    doubtful = bits.join(codes, ["rng", "id"]).select("key", "m")
    doubtful = doubtful.unionByName(used.filter("m is null").select("key", "m"))
    # lifetimes that touch the month; without such, the reason alone is open
    named = doubtful.join(buried.withColumn("bears", F.lit(True)), "key", "left")
    in_month = (month_of(F.col("born")) <= F.col("m")) & (F.col("m") <= month_of(F.col("died")))
    touch = doubtful.join(lives, "key").filter(in_month)
    touch = touch.groupBy(F.col("key").alias("__k"), F.col("m").alias("__m")).agg(F.collect_list(F.struct("born", "died")).alias("lives"))
    named = named.join(touch, (F.col("key") == F.col("__k")) & (F.col("m") == F.col("__m")), "left").select(
        "key", F.coalesce("m", F.lit(-1)).alias("m"), F.coalesce("bears", F.lit(False)).alias("bears"), "first_death", "lives"
    )
    named = scratch.save(named)
    hit = refs.withColumn("m", F.coalesce("m", F.lit(-1))).join(named, ["key", "m"])
    alive = F.expr("coalesce(exists(lives, x -> x.born <= seen_at and seen_at < x.died), false)")
    reason = (
        F.when(~F.col("bears"), F.lit("missing"))
        .when(F.col("first_death") <= F.col("seen_at"), F.lit("deleted"))
        .otherwise(F.lit("late"))
    )
    hit = hit.filter(~F.col("bears") | (F.col("seen_at").isNotNull() & ~alive))
    return hit.select(
        "src_table", "ref_id", reason.alias("reason"),
        F.when(F.col("m") >= 0, month_text(F.col("m"))).alias("seen_month"),
    ).distinct()
