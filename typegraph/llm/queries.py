"""Queries of the text problems (2, 6, 7 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typegraph.llm.abuse import OFFENDING, fit, severity
from typegraph.llm.contamination import contaminated
from typegraph.llm.source_origin import source_origin
from typegraph.llm.tokenizer import encode_corpus
from typegraph.plans.joins import spread
from typegraph.session import table


def p2_origins(spark: SparkSession, d: str) -> DataFrame:
    """Origin of every source file."""
    return source_origin(spread(table(spark, d, "source_files"), spark, "file_path"), spark)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that nobody in the project wrote by hand."""
    return p2_origins(spark, d).filter("origin <> 'hand'").select("file_path")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text"), spark, "doc_id"), spark)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with passages of evaluation items."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), spark, "doc_id")
    return contaminated(docs, table(spark, d, "eval_items"), spark)


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Severity of every document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"), spark, "doc_id")
    model = fit(table(spark, d, "documents"), table(spark, d, "doc_labels"))
    return severity(docs, model, spark)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that abuse, threaten, hate or are sexually explicit."""
    return p8_scores(spark, d).filter(F.col("p_offending") >= OFFENDING).select("doc_id")


def p8_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of offending documents and mean severity of every source."""
    offending = (F.col("p_offending") >= OFFENDING).cast("double")
    return p8_scores(spark, d).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.avg(offending).alias("rate"), F.avg("severity").alias("mean_severity")
    )


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_origins, p6_ids, p7_found, p8_found, p8_scores, p8_source_rates)
}
SQL: dict[str, str] = {}
