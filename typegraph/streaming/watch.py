"""Keeping the fragment store up to date from a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from typegraph.extract.scan import fragments
from typegraph.sources.files import FragmentStore, is_source, read_sources

#: Changes within this time are taken together.
DEBOUNCE = "400 milliseconds"


def latest(batch: DataFrame) -> DataFrame:
    """The last text of each file of a micro-batch (file_path, code, at)."""
    return batch.groupBy("file_path").agg(F.max_by("code", "at").alias("code"))


def apply_batch(batch: DataFrame, store: FragmentStore, root: str | None = None) -> None:
    """Upsert a micro-batch and, with a root, drop the files no longer listed there, in one write of the changes."""
    gone = None
    if root is not None:
        there = read_sources(batch.sparkSession, root).select("file_path")  # names alone, no contents
        gone = store.load().select("file_path").join(there, "file_path", "left_anti")
    store.change(fragments(latest(batch)), gone)


def watch_folder(spark: SparkSession, root: str, store: FragmentStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Stream the C# files under a folder into the store.

    The file source reports additions; vanished files are found by listing in each batch.
    Repeating a batch after a failure gives the same store.
    """
    raw = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.cs").load(root)
    )
    rows = raw.filter(is_source(F.col("path"))).select(
        F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("code"), F.col("modificationTime").alias("at")
    )
    out = rows.writeStream.foreachBatch(lambda b, _: apply_batch(b, store, root)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=DEBOUNCE)).start()


def windowed_counts(stream: DataFrame, time_col: str, key_col: str, window: str, late: str) -> DataFrame:
    """(window_start, key, n) per tumbling window; rows later than ``late`` are dropped by
    the watermark. The time may be without a zone."""
    s = stream.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late)
    g = s.groupBy(F.window("__t", window).alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "key", "n")
