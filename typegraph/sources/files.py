"""C# files as a source, and the store of their fragments."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typegraph.extract.scan import digest, fragments
from typegraph.plans.scratch import filesystem, place_once, read_text, remove_path
from typegraph.schema import FRAGMENT_DDL, PARSER_VERSION

# Folders and file endings that are never read.
SKIPPED_FOLDERS = ("obj", "bin", ".git", "node_modules", ".vs")
SKIPPED_ENDINGS = (".g.cs", ".designer.cs", ".assemblyinfo.cs", ".globalusings.g.cs")

#: After so many tables the store is written anew as one.
COMPACT_AFTER = 24


def is_source(path: Column) -> Column:
    """Whether a path is a hand-kept C# file: folders by case, endings without."""
    p = F.translate(path, "\\", "/")
    folder = p.rlike("(^|/)(" + "|".join(s.replace(".", "[.]") for s in SKIPPED_FOLDERS) + ")/")
    out = F.lower(p).endswith(".cs") & ~folder
    for e in SKIPPED_ENDINGS:
        out = out & ~F.lower(p).endswith(e)
    return out


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, code) of the C# files under a folder; a file's or project's own path
    stands for its folder."""
    if root.lower().endswith((".cs", ".sln", ".csproj", ".slnx")):
        root = root.replace("\\", "/").rsplit("/", 1)[0]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.cs").load(root)
    return raw.filter(is_source(F.col("path"))).select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("code"))


class FragmentStore:
    """Fragments of one parser version under a folder.

    A version is a list of tables: a base and what was written since, later tables
    overriding earlier ones by path. It counts once its file is in place, which of two
    writers of the same version one alone can do; readers of older versions go on, since
    the tables of the version before stay until the next one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = f"{root.rstrip('/')}/parser_version={PARSER_VERSION}"

    def _versions(self) -> list[int]:
        fs, at = filesystem(self.spark, f"{self.root}/versions")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _tables(self, version: int) -> list[str]:
        return json.loads(read_text(self.spark, f"{self.root}/versions/v{version:010d}.json"))

    def load(self) -> DataFrame:
        """The stored fragments; none if nothing of this parser version is stored."""
        v = self._versions()
        return self._read(self._tables(v[-1]) if v else []).filter("not dropped").drop("dropped", "nth")

    def _read(self, tables: list[str]) -> DataFrame:
        """One row per path over some tables, the latest; ``dropped`` marks what was deleted."""
        schema = FRAGMENT_DDL + ", dropped boolean, nth int"
        if not tables:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*tables)
        if len(tables) == 1:
            return rows
        # the latest number of a path is found without its fragment
        last = rows.groupBy("file_path").agg(F.max("nth").alias("nth"))
        return rows.join(last, ["file_path", "nth"], "left_semi")

    def _commit(self, rows: DataFrame, whole: bool) -> DataFrame:
        v = self._versions()
        n = (v[-1] if v else 0) + 1
        old = [] if whole or not v else self._tables(v[-1])
        path = f"{self.root}/tables/{uuid.uuid4().hex}"
        rows.withColumn("nth", F.lit(n)).write.parquet(path)
        tables = [*old, path]
        if len(tables) > COMPACT_AFTER:
            path = f"{self.root}/tables/{uuid.uuid4().hex}"
            self._read(tables).filter("not dropped").withColumn("nth", F.lit(n)).write.parquet(path)
            tables = [path]
        place_once(self.spark, f"{self.root}/versions/v{n:010d}.json", json.dumps(tables))
        # tables that neither this version nor the one before names, and older versions
        kept = {*tables, *(self._tables(v[-1]) if v else [])}
        for gone in v[:-1]:
            for t in self._tables(gone):
                if t not in kept:
                    remove_path(self.spark, t)
            remove_path(self.spark, f"{self.root}/versions/v{gone:010d}.json")
        return self.load()

    def save(self, rows: DataFrame) -> DataFrame:
        """A new version of these rows alone."""
        return self._commit(rows.withColumn("dropped", F.lit(False)), True)

    def change(self, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """A new version in one write: ``new`` replaces the fragments of its files, those of ``gone`` (file_path) go.

        Only the changed rows are written.
        """
        rows = new.withColumn("dropped", F.lit(False))
        if gone is not None:
            rows = rows.unionByName(gone.select("file_path").distinct().withColumn("dropped", F.lit(True)), allowMissingColumns=True)
        return self._commit(rows, False)

    def upsert(self, new: DataFrame) -> DataFrame:
        """Replace the fragments of the files in ``new``; the last write of a path wins."""
        return self.change(new)

    def delete(self, paths: DataFrame) -> DataFrame:
        """Drop the fragments of the files in ``paths`` (file_path)."""
        return self.change(self.spark.createDataFrame([], FRAGMENT_DDL), paths)


def plan_scan(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_path, state): new, changed, gone or same, by digest; a text that can't be read counts as changed."""
    now = sources.select("file_path", digest().alias("now"), F.lit(True).alias("here"))
    was = stored.select("file_path", F.col("hash").alias("was"), F.lit(True).alias("known"))
    same = F.coalesce(F.col("was") == F.col("now"), F.lit(False))
    state = F.when(F.col("known").isNull(), "new").when(F.col("here").isNull(), "gone").when(same, "same").otherwise("changed")
    return now.join(was, "file_path", "full").select("file_path", state.alias("state"))


def scan(spark: SparkSession, sources: DataFrame, store: FragmentStore) -> DataFrame:
    """Bring the store up to date in one write: parse only new and changed files, drop vanished and unreadable ones."""
    stored = store.load()
    plan = plan_scan(sources, stored)
    todo = sources.join(plan.filter("state in ('new', 'changed')"), "file_path", "left_semi")
    gone = plan.filter("state = 'gone'").select("file_path")
    unread = todo.filter("code is null").select("file_path")
    return store.change(fragments(todo), gone.unionByName(unread))
