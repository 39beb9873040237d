"""Processing only new, changed or vanished records, run by run.

The state of the last successful run is kept as key, content digest and observation time,
in buckets by the hash of the key. A run reduces its rows to one per key, hashes them
against the state by a join, and writes its decisions as one table, which is at the same
time what it adds to the state. Only state rows whose keys the run brings are moved: the
run's buckets alone are read, and its keys go to the state where they are measured small,
else both sides meet by a shuffle.

Nothing counts before the new version's manifest is in place. It is written aside and put
in place under its number only if no such number is there, which the file system decides at
once; another run that took the same version fails. A run that dies leaves a table no
manifest names; its rows are read again by the next run, so none is lost or repeated.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typegraph.plans.joins import BROADCAST_ROWS, checked_broadcast
from typegraph.plans.scratch import filesystem, place_once, read_text, remove_path

_REDUCED = "key string, scanned_at timestamp_ntz, fragment_id bigint, gone boolean, digest string"
_SCHEMA = _REDUCED + ", run_id bigint, version bigint, is_case boolean, bucket int"
#: After so many tables the state is written anew as one.
COMPACT_AFTER = 24
#: Rows of the first run in one bucket of the state.
BUCKET_ROWS = 1 << 20


@dataclass
class Manifest:
    """What a version consists of: state tables (later ones override) and results."""

    version: int = 0
    state: list[str] = field(default_factory=list)
    results: list[str] = field(default_factory=list)
    read_before: str | None = None
    buckets: int = 0


class VersionedState:
    """State tables and manifests under one shared directory, which lasts from run to run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> Manifest:
        """The newest manifest; an empty one at the start."""
        fs, at = filesystem(self.spark, f"{self.root}/manifests")
        if not fs.exists(at):
            return Manifest()
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = sorted(n for n in names if n.startswith("v") and n.endswith(".json"))
        if not done:
            return Manifest()
        return Manifest(**json.loads(read_text(self.spark, f"{self.root}/manifests/{done[-1]}")))

    def write(self, df: DataFrame) -> str:
        """Write a table that no manifest names yet; returns its path."""
        path = f"{self.root}/tables/part={uuid.uuid4().hex}"
        df.write.partitionBy("bucket").parquet(path)
        return path

    def commit(self, manifest: Manifest) -> None:
        """Put a version in place; fails if that version exists."""
        place_once(self.spark, f"{self.root}/manifests/v{manifest.version:010d}.json", json.dumps(manifest.__dict__))

    def read(self, tables: list[str]) -> DataFrame:
        """The rows of some of the tables."""
        if not tables:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA + ", part string").option("basePath", f"{self.root}/tables").parquet(*tables).drop("part")

    def known(self, manifest: Manifest, keys: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
        """One row per key: the state of a version, of some keys and buckets only if they are given."""
        rows = self.read(manifest.state)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        rows = rows.select("key", "version", "scanned_at", "digest", "gone", "fragment_id")
        if keys is not None:
            rows = rows.join(keys, "key", "left_semi")
        last = F.max(F.struct("version", "scanned_at", "digest", "gone", "fragment_id"))
        return rows.groupBy("key").agg(last.alias("s")).select("key", "s.*")


def readable_digest(digest: Column) -> Column:
    """Upper-case digest of 40 hex digits; null for anything else."""
    return F.when(digest.rlike("^[0-9A-Fa-f]{40}$"), F.upper(digest))


def content_digest(columns: list[str]) -> Column:
    """Digest of a record's columns, for records that are delivered without one; nulls count."""
    return F.upper(F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def reduced(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per key (and what else ``by`` names): the one observed last, the larger id among equals."""
    old = F.coalesce("scanned_at", F.expr("timestamp_ntz'0001-01-01'")).alias("scanned_at")
    r = rows.filter("key is not null").select(
        *by, "key", old, F.col("fragment_id").cast("bigint").alias("fragment_id"),
        F.coalesce("gone", F.lit(False)).alias("gone"), readable_digest(F.col("digest")).alias("digest"),
    )
    last = F.max(F.struct("scanned_at", "fragment_id", "gone", "digest"))
    return r.groupBy(*by, "key").agg(last.alias("r")).select(*by, "key", "r.*")


def process_batch(
    state: VersionedState, batch: DataFrame, run_id: int, read_before: str | None = None, rows: int | None = None
) -> Manifest:
    """One successful run over its rows (key, scanned_at, fragment_id, gone, digest).

    Per key the row observed last counts (the larger id among equals); rows without a key
    name no record. It is void unless observed later than all rows of the key that
    earlier runs read; a missing time is earliest. It is a case if the key is new or was
    gone, if the digest differs or either is unreadable, or if it reports that a live
    record is gone. The run commits even if it finds nothing. ``rows`` is given by callers
    that have reduced the batch already: its number of rows.
    """
    at = state.current()
    newest = reduced(batch, []) if rows is None else batch.select("key", "scanned_at", "fragment_id", "gone", "digest")
    if not at.buckets:
        at.buckets = max(1, (newest.count() if rows is None else rows) // BUCKET_ROWS)
    newest = newest.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(at.buckets)).cast("int"))
    keys, buckets = newest.select("key"), None
    if at.state and at.buckets > 1:
        # a small run touches few buckets; their numbers, one for BUCKET_ROWS keys of the state, prune the scan
        buckets = [r["bucket"] for r in newest.select("bucket").distinct().collect()]
    # with the keys at hand nothing of the state is moved but their rows
    if rows is None and at.state:
        keys = checked_broadcast(keys)
    elif rows is not None and rows <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    known = state.known(at, keys, buckets)
    known = known.select(
        F.col("key").alias("__k"), F.col("scanned_at").alias("__at"), F.col("gone").alias("__gone"), F.col("digest").alias("__digest")
    )
    both = newest.join(known, F.col("key") == F.col("__k"), "left")
    both = both.filter(F.col("__k").isNull() | (F.col("scanned_at") > F.col("__at")))
    was_live = F.col("__k").isNotNull() & ~F.coalesce("__gone", F.lit(False))
    differs = F.coalesce(F.col("digest") != F.col("__digest"), F.lit(True))
    case = F.when(F.col("gone"), was_live).otherwise(~was_live | differs)
    version = at.version + 1
    decided = both.select(
        "key", "scanned_at", "fragment_id", "gone", "digest",
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(version).cast("bigint").alias("version"), case.alias("is_case"), "bucket",
    )
    table = state.write(decided)
    then = Manifest(version, [*at.state, table], [*at.results, table], read_before or at.read_before, at.buckets)
    if len(then.state) > COMPACT_AFTER:
        last = F.max(F.struct("version", "scanned_at", "fragment_id", "gone", "digest", "run_id"))
        whole = state.read(then.state).groupBy("bucket", "key").agg(last.alias("s")).select("key", "s.*", "bucket")
        then.state = [state.write(whole.withColumn("is_case", F.lit(False)))]
    state.commit(then)
    return then


def sorted_into_runs(rows: DataFrame, starts: list[datetime], since: datetime | None) -> DataFrame:
    """rows with ``slot``: the number of the run that reads them, from 0; others are left out.

    The runs' windows meet the rows by day, so no list of runs stands in an expression; a
    window has a row per day. The first window without ``since`` is open to the past.
    """
    spark = rows.sparkSession
    first = since or starts[0]
    windows = spark.createDataFrame(
        [(k, first if k == 0 else starts[k - 1], s) for k, s in enumerate(starts)], "slot int, lo timestamp_ntz, hi timestamp_ntz"
    )
    days = F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("day")
    windows = windows.select("slot", F.when((F.col("slot") > 0) | F.lit(since is not None), F.col("lo")).alias("lo"), "hi", days)
    day = F.greatest(F.to_date("arrived_at"), F.lit(first.date()))
    at = rows.filter("key is not null and arrived_at is not null").withColumn("day", day)
    inside = (F.col("lo").isNull() | (F.col("arrived_at") >= F.col("lo"))) & (F.col("arrived_at") < F.col("hi"))
    return at.join(checked_broadcast(windows), "day").filter(inside).drop("day", "lo", "hi", "arrived_at")


def run_history(spark: SparkSession, rows: DataFrame, runs: DataFrame, root: str) -> DataFrame:
    """Process every succeeded run in turn; (run_id, fragment_id) of the cases.

    rows: (key, scanned_at, fragment_id, gone, digest, arrived_at), the digest as delivered
    or by :func:`content_digest`; runs: (run_id, started_at, status), the scheduler's list,
    one row per run. ``root`` is the folder of the state, which lasts as long as its owner
    wants. A run reads what arrived before its start and not before that of the previous
    succeeded run. Runs without a start never ran. Without a succeeded run the result is
    empty. On a root with committed runs only those are processed that start after the last
    of these; the result has the cases of all.
    """
    state = VersionedState(spark, root)
    before = state.current().read_before
    since = datetime.fromisoformat(before) if before else None
    good = runs.filter((F.col("status") == "succeeded") & F.col("started_at").isNotNull()).select("run_id", "started_at").distinct()
    todo = [r for r in good.orderBy("started_at", "run_id").collect() if since is None or r["started_at"] > since]
    if todo:
        # one pass sorts the rows into the runs that read them and reduces them; a run then reads its part alone
        inbox = f"{state.root}/inbox-{uuid.uuid4().hex}"
        try:
            parts = sorted_into_runs(rows, [r["started_at"] for r in todo], since)
            reduced(parts, ["slot"]).write.partitionBy("slot").parquet(inbox)
            read = spark.read.schema(_REDUCED + ", slot int").parquet(inbox)
            sizes = {r["slot"]: r["n"] for r in read.groupBy("slot").agg(F.count("*").alias("n")).collect()}
            for k, run in enumerate(todo):
                process_batch(state, read.filter(F.col("slot") == k).drop("slot"), run["run_id"], str(run["started_at"]), sizes.get(k, 0))
        finally:
            remove_path(spark, inbox)
    return state.read(state.current().results).filter("is_case").select("run_id", "fragment_id")
