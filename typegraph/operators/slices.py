"""Source text behind types and members, cut by lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def file_lines(files: DataFrame) -> DataFrame:
    """(file_path, line, text): the numbered lines of every file; none for a null code."""
    at = files.select("file_path", F.posexplode(F.split("code", "\r\n|\n|\r")).alias("p", "text"))
    return at.select("file_path", (F.col("p") + 1).alias("line"), "text")


def slice_spans(files: DataFrame, spans: DataFrame, max_lines: int | None) -> DataFrame:
    """(span_id, file_path, line, text, truncated): the first lines of each span, all without max_lines.

    spans: (span_id, file_path, start_line, end_line). The file's lines are cut as an array
    before they are exploded. Spans beyond the file's end give what is there.
    """
    f = files.select("file_path", F.split("code", "\r\n|\n|\r").alias("ls"))
    s = spans.join(f, "file_path").filter("start_line >= 1 and end_line >= start_line and start_line <= size(ls)")
    whole = F.col("end_line") - F.col("start_line") + 1
    size = whole if max_lines is None else F.least(whole, F.lit(max_lines))
    cut = s.select(
        "span_id", "file_path", "start_line", (F.lit(False) if max_lines is None else whole > max_lines).alias("truncated"),
        F.posexplode(F.slice("ls", F.col("start_line"), size)).alias("p", "text"),
    )
    return cut.select("span_id", "file_path", (F.col("start_line") + F.col("p")).alias("line"), "text", "truncated")


def longest_spans(members: DataFrame) -> DataFrame:
    """Of the members of one name in a type, the longest (the earliest among equals)."""
    size = F.struct((F.col("end_line") - F.col("start_line")).alias("n"), (-F.col("start_line")).alias("s"))
    row = F.struct(*[c for c in members.columns if c not in ("type_key", "member_key")])
    return members.groupBy("type_key", "member_key").agg(F.max_by(row, size).alias("r")).select("type_key", "member_key", "r.*")


def budget_members(members: DataFrame, budget: int) -> DataFrame:
    """How much of each member a type's line budget shows: full, part or signature.

    members: (type_key, member_name, start_line, end_line), shown by start_line.
    """
    w = W.partitionBy("type_key").orderBy("start_line", "member_name").rowsBetween(W.unboundedPreceding, 0)
    m = members.withColumn("n_lines", F.col("end_line") - F.col("start_line") + 1).withColumn("total", F.sum("n_lines").over(w))
    left = F.greatest(F.lit(0), F.least(F.col("n_lines"), F.lit(budget) - (F.col("total") - F.col("n_lines"))))
    show = F.when(F.col("total") <= budget, "full").when(left > 0, "part").otherwise("signature")
    return m.withColumn("shown_lines", left).withColumn("show", show)


def _padded(line: Column) -> Column:
    """The number in five columns, or in as many as it has (lpad alone would cut it)."""
    n = line.cast("string")
    return F.lpad(n, F.greatest(F.lit(5), F.length(n)), " ")


def read_numbered(files: DataFrame, nodes: DataFrame, max_lines: int | None) -> DataFrame:
    """(file_path, line, text, starts): first lines of files (all without max_lines), with
    numbers padded to five columns, and the types that begin there."""
    heads = file_lines(files)
    if max_lines is not None:
        heads = heads.filter(F.col("line") <= max_lines)
    marks = nodes.groupBy("file_path", F.col("start_line").alias("line")).agg(F.array_join(F.sort_array(F.collect_set("key")), ",").alias("starts"))
    out = heads.join(marks, ["file_path", "line"], "left")
    return out.select("file_path", "line", F.concat(_padded(F.col("line")), F.lit(" "), "text").alias("text"), F.coalesce("starts", F.lit("")).alias("starts"))
