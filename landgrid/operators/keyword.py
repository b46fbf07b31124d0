"""Keyword search over captions or texts by an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.functions.codes import UNNAMED
from landgrid.functions.text import tokens


def build_keyword_index(features: DataFrame, text: str = "caption", key: str = "rowkey") -> DataFrame:
    """term, key, tf and the text's number of tokens; unnamed captions are left out."""
    named = features.filter(F.col(text).isNotNull() & ~F.col(text).isin("\\", UNNAMED))
    words = named.select(key, tokens(F.col(text)).alias("words")).withColumn("n_words", F.size("words"))
    return words.select(key, "n_words", F.explode("words").alias("term")).groupBy("term", key, "n_words").agg(F.count("*").alias("tf"))


def search(index: DataFrame, n_texts: int, terms: list[str], every: bool, key: str = "rowkey") -> DataFrame:
    """Keys with all terms, or with any, and their score: the sum of tf idf^2 over the root of the text's length."""
    wanted = sorted({t.lower() for t in terms})
    hits = index.filter(F.col("term").isin(wanted))
    # as many rows as terms, each with its number of texts
    idf = hits.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log(F.lit(float(n_texts)) / F.col("df")) + 1).alias("idf"))
    scored = hits.join(F.broadcast(idf), "term").groupBy(key).agg(
        F.count("*").alias("n_terms"), F.sum(F.col("tf") * F.col("idf") * F.col("idf") / F.sqrt(F.col("n_words").cast("double"))).alias("score")
    )
    return scored.filter(F.col("n_terms") == len(wanted)) if every else scored


def top_hits(hits: DataFrame, k: int = 1000, key: str = "rowkey") -> DataFrame:
    return hits.orderBy(F.desc(F.round("score", 6)), key).limit(k)
