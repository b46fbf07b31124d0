"""Quality rules by cross-document line frequency, with DataFrame functions only.

Lines are normalised (spaces collapsed, trimmed, lower case) and hashed; for each host the distinct documents that hold
a line are counted. Lines held by more documents than the host's limit are taken out, and documents that lose too large
a share of their words are rejected, besides those that fail the base rules.

Defined cases: null text has no words; a text without words fails the base rules; a null host is a host of its own;
rows that repeat an id are documents of their own; an empty table gives an empty result; only the id, text and host columns
are read. Words and lines are compared by 64-bit hashes within a document or host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.llm.shared import SPACE, body, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, SPACE), ""), lambda w: F.xxhash64(w))


def _windows(words: Column) -> Column:
    """A hash for each run of WINDOW words, by its first word's place."""
    one = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))
    return F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), one)).otherwise(F.array().cast("array<bigint>"))


def document_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each document with its base counts and its lines (hash of the normalised line, words in it)."""
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), body(text_col).alias("t"))
    df = df.select(
        "row", "doc_id", "host", _word_hashes(F.col("t")).alias("words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("held"),
    )
    df = df.select("*", F.transform("held", lambda x: F.xxhash64(x)).alias("same"), _windows(F.col("words")).alias("runs"))
    twice = F.size(F.array_distinct("runs")) < F.size("runs")
    df = df.withColumn("placed", F.when(twice, F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, k: F.coalesce(F.get("placed", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("placed", k + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("at", F.sort_array(F.transform(F.filter("placed", near), lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.get("at", k + 1) - x)), F.lit(0).cast("long"), lambda s, x: s + x)
    tidy = lambda x: F.trim(F.regexp_replace(F.lower(x), SPACE, " "))
    n_line = lambda x: F.size(F.array_remove(F.split(x, SPACE), ""))
    return df.select(
        "row", "doc_id", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("same") - F.size(F.array_distinct("same"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.transform("held", lambda x: F.struct(F.xxhash64(tidy(x)).alias("h"), n_line(x).alias("n"))).alias("lines"),
    )


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 30, host_share: float = 0.2, most_docs: int = 1000, lost_share: float = 0.7, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """One row for each document: doc_id, base counts, base_failed, kept, n_removed_words.

    A line is removed where more documents hold it than ``host_share`` of the host's or ``most_docs`` if that is less,
    and more than ``min_docs``; a document is depleted where at least ``lost_share`` of its words are in removed lines.
    """
    rows = written(document_measures(docs, id_col, text_col, host_col), "line-rules")
    # map tasks count before the shuffle, so that a line or a host with a third of all rows is a row for each task
    limits = rows.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.least(F.lit(host_share) * F.count("*"), F.lit(float(most_docs)))).alias("most"))
    held = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    held = held.groupBy("host", "h").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    common = held.join(limits, "host").filter("n_docs > most").select("host", "h")
    lost = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    lost = lost.join(common, ["host", "h"]).groupBy("row").agg(F.sum("n").alias("n_removed_words"))
    out = rows.drop("lines", "host").join(lost, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.col("n_removed_words") < F.lit(lost_share) * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_removed_words")
