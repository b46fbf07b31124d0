"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm.byte_bpe import byte_bpe
from landgrid.llm.exact_dedup import exact_dedup
from landgrid.llm.line_rules import line_rules
from landgrid.llm.near_dedup import near_dedup
from landgrid.llm.packing import pack
from landgrid.llm.quality_model import score_quality, train_quality
from landgrid.llm.shared import documents
from landgrid.llm.suffix_dedup import suffix_dedup
from landgrid.llm.token_counts import token_counts
from landgrid.llm.token_files import token_files
from landgrid.llm.toxicity import score_toxicity, train_toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    english = F.coalesce(F.col("lang") == "en", F.lit(False)).cast("int")
    categories = {"toxic_english": F.col("toxic") * english, "toxic_other": F.col("toxic") * (1 - english), "toxic": F.col("toxic")}
    return score_toxicity(docs, train_toxicity(docs, labels, categories, "toxic"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_quality(docs, train_quality(docs))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(documents(spark, sf_dir))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_model": op4_quality_model,
    "op5_token_counts": op5_token_counts,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_files": op8_token_files,
    "op9_packing": op9_packing,
    "op10_line_rules": op10_line_rules,
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op10_line_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
        w AS (SELECT row, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
        runs AS (SELECT row, i, list_slice(ws, i, i + 7) AS run FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
        twice AS (SELECT row, i FROM runs QUALIFY count(*) OVER (PARTITION BY row, run) > 1),
        rep AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS u(k) GROUP BY row),
        held AS (SELECT row, host, t, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS tidy,
                        len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
                 FROM d, unnest(string_split(t, chr(10))) AS u(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        dup AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM held GROUP BY row),
        most AS (SELECT host, greatest(30, least(0.2 * count(*), 1000)) AS m FROM d GROUP BY host),
        common AS (SELECT host, tidy FROM held JOIN most USING (host) GROUP BY host, tidy, m HAVING count(DISTINCT row) > m),
        lost AS (SELECT row, sum(n) AS n FROM held SEMI JOIN common USING (host, tidy) GROUP BY row),
        m AS (SELECT d.row, doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
                     coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_removed_words
              FROM d JOIN w USING (row) LEFT JOIN dup USING (row) LEFT JOIN rep USING (row) LEFT JOIN lost USING (row))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_removed_words < 0.7 * n_words AS kept, cast(n_removed_words AS bigint) AS n_removed_words
        FROM m""",
}
