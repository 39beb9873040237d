"""Tokens, term statistics and BM25 ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters or digits; camel case is split."""
    spaced = F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{Nd}]+"), lambda w: F.length(w) >= 2)


def term_frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term, tf); null and empty texts have no terms."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df)."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, top: int) -> DataFrame:
    """(doc_id, score): the best documents for the distinct words of a query.

    Lengths and the number of documents cover all documents; term counts are taken inside
    each document for the query's words alone, so nothing but matching (document, term)
    rows is shuffled. Equal scores are ordered by doc_id.
    """
    spark = docs.sparkSession
    words = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query))))).collect()]
    base = docs.select(F.col(id_col).alias("doc_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("ts"))
    base = base.select("doc_id", F.size("ts").alias("len"), F.filter("ts", lambda w: w.isin(words) if words else F.lit(False)).alias("hit"))
    total = base.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    hits = base.filter(F.size("hit") > 0).select("doc_id", "len", F.explode("hit").alias("term"))
    hits = hits.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row per query word
    s = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    # sums of the same parts in another order differ in their last digits; equal scores must tie
    return s.groupBy("doc_id").agg(F.round(F.sum(part), 9).alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(top)
