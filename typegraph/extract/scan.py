"""The extraction as a table function over files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typegraph.extract.csharp import extract
from typegraph.schema import FRAGMENT_DDL


def digest(code: str = "code"):
    """Upper-case SHA-1 of a text without its byte order mark."""
    return F.upper(F.sha1(F.regexp_replace(code, "^﻿", "")))


def fragments(files: DataFrame) -> DataFrame:
    """One fragment per row of files (file_path, code); unreadable files are dropped.

    Parsing is the one step in Python; it moves whole files in Arrow batches, without a
    shuffle, and its rows come back as one JSON text that the JVM turns into the schema.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, h, extract(p, c)) for p, c, h in zip(b["file_path"], b["code"], b["hash"])]
            yield pd.DataFrame([json.dumps({**r, "hash": h}) for p, h, r in rows if r is not None], columns=["j"])

    rows = files.filter("file_path is not null").select("file_path", "code").withColumn("hash", digest())
    return rows.mapInPandas(run, "j string").select(F.from_json("j", FRAGMENT_DDL).alias("f")).select("f.*")
