"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it back. The
folder is the one the cluster names in ``spark.checkpoint.dir``; a folder of our own is
set only where that setting is absent on a local master, as in tests, and an error raised on
a cluster without it. A written table also gives the
planner true sizes, so a small side is broadcast only because its files are small and
goes through a shuffle join otherwise.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession

_OPEN: list["Scratch"] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session, created by us only where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="typegraph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """A directory of one run of an operator under the shared folder. Its tables last as long as
    the session, since results are read from them late; :func:`remove_all` frees them earlier."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self._n = 0
        _OPEN.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table read back, without its lineage."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.mode("overwrite").parquet(path)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Delete the directory."""
        remove_path(self.spark, self.root)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path object."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def place_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in whole, or raise RuntimeError if that path is taken.

    On a local file system a hard link is made, which fails where the name is taken; on
    HDFS the file is renamed without the right to overwrite; on others, object stores
    above all, it is created without that right and appears when it is closed.
    """
    fs, final = filesystem(spark, path)
    fs.mkdirs(final.getParent())
    _, aside = filesystem(spark, f"{path}.{uuid.uuid4().hex}.aside")
    scheme, jvm = fs.getUri().getScheme(), spark._jvm

    def put(at) -> None:
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()

    try:
        if scheme == "file":
            put(aside)
            place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(place(final), place(aside))
        elif scheme in ("hdfs", "viewfs"):
            put(aside)
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            rights = spark.sparkContext._gateway.new_array(rename, 1)
            rights[0] = rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, final, rights)
        else:
            put(final)
    except (Py4JJavaError, CapturedException) as e:
        raise RuntimeError(f"{path} is there already") from e
    finally:
        fs.delete(aside, False)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, at = filesystem(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path with everything under it, if it is there."""
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def remove_all() -> None:
    """Delete the tables of all runs so far, for sessions that last long; results that have
    not been read by then can't be."""
    while _OPEN:
        _OPEN.pop().remove()


@atexit.register
def _clean() -> None:
    for s in _OPEN:
        try:
            s.remove()
        except Exception:  # the session may be gone already
            pass
