"""Derived tables that a session computes once for a data directory."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from typegraph.plans.scratch import Scratch, filesystem

_PATHS: dict[tuple, tuple] = {}


def _state(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """Time and size of some tables; other content gives another state."""
    out = []
    for name in names:
        fs, at = filesystem(spark, f"{sf_dir}/{name}.parquet")
        s = fs.getContentSummary(at)
        out.append((fs.getFileStatus(at).getModificationTime(), s.getLength(), s.getFileCount()))
    return tuple(out)


def _there(spark: SparkSession, path: str) -> bool:
    fs, at = filesystem(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def kept(*tables: str) -> Callable:
    """The function's table is written once per session, directory and state of the named
    tables, and read from there as long as it is there. Every call gives a frame of its own, fit for self joins."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, d, f.__module__, f.__name__, _state(spark, d, tables))
            if key not in _PATHS or not _there(spark, _PATHS[key][0]):
                scratch = Scratch(spark, f.__name__)
                df = scratch.save(f(spark, d))
                _PATHS[key] = (scratch.last, df.schema)
            path, schema = _PATHS[key]
            return spark.read.schema(schema).parquet(path)

        return run

    return wrap
