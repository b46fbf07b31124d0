"""The training-text pipeline: quality, exact copies, near copies, long repeats, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents. The quality classifier estimates its labellers and trains its scorer on the stage's own input.
A null text passes as empty. Rows that repeat an id are judged row by row for quality; the dedup stages keep one row
of each text or class, the longest of those that share the kept id and the kept text's normal form. Further columns of
documents pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm.exact_dedup import digest, exact_dedup
from landgrid.llm.near_dedup import near_rows, with_words_key
from landgrid.llm.packing import pack
from landgrid.llm.quality_model import keep_quality, train_quality
from landgrid.llm.shared import Scratch, discard, documents, key_bitmap, unused, written
from landgrid.llm.suffix_dedup import without_repeats
from landgrid.session import ship


def _by_bitmap(bitmap: np.ndarray, bits: int, marked: bool):
    """Rows whose id is marked in a bitmap, as null ids always are, or the others."""

    def rows(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) & ((1 << bits) - 1)
            hit = ((bitmap[ids >> 6] >> (ids & 63).astype(np.uint64)) & np.uint64(1)).astype(bool) | batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(hit == marked))

    return rows


def _rows_of(docs: DataFrame, report: DataFrame, keyed: Callable[..., DataFrame], keys: list[str]) -> DataFrame:
    """The rows of docs that a report (doc_id, kept, keys) keeps; keyed gives docs the keys under names of its own, which tell an id's texts apart.

    Rows whose id surely loses none pass where they are; only the others meet the report in a join. What the report says
    goes under names that docs has not.
    """
    own = unused(docs.columns, "_id", "_kept", "_rows", "_row", *(f"_{k}" for k in keys))
    the_id, kept, n_rows, row, *names = own
    report = report.select(F.col("doc_id").alias(the_id), F.col("kept").alias(kept), *(F.col(k).alias(n) for k, n in zip(keys, names)))
    report = written(report, "pipeline-report")
    tally = report.groupBy(the_id).agg(F.count("*").alias("n"), F.sum(F.col(kept).cast("int")).alias("n_kept"))
    lossy = written(tally.filter(F.col("n_kept") < F.col("n")).select(the_id, "n_kept"), "pipeline-lossy")
    bitmap, bits = key_bitmap(lossy.filter(F.col(the_id).isNotNull()).select(F.col(the_id).alias("key")))
    sure, doubtful = (docs.mapInArrow(_by_bitmap(bitmap, bits, marked), docs.schema) for marked in (False, True))
    some = lossy.select(the_id)
    unharmed = doubtful.join(some, doubtful["doc_id"].eqNullSafe(some[the_id]), "left_anti")
    found = sure.unionByName(unharmed.select(*docs.columns))
    mixed = lossy.filter("n_kept > 0").select(F.col(the_id).alias(row))
    if mixed.isEmpty():
        return found
    wanted = report.filter(kept).select(the_id, *names).join(mixed, F.col(the_id).eqNullSafe(F.col(row)), "left_semi")
    return found.unionByName(_of_repeated(keyed(doubtful, *names), wanted, the_id, names, row, docs.columns))


def _of_repeated(docs: DataFrame, kept: DataFrame, the_id: str, keys: list[str], row: str, columns: list[str]) -> DataFrame:
    """For each kept (id, keys) one row, the longest; map tasks fold an id's equal texts first."""
    first = F.min_by(F.struct(*columns), F.struct(-F.coalesce(F.length("text"), F.lit(-1)), "text"))
    kept = kept.select(F.col(the_id).alias(f"{the_id}k"), *(F.col(k).alias(f"{k}k") for k in keys))
    rows = docs.groupBy(F.col("doc_id").alias(the_id), *keys).agg(first.alias(row))
    same = F.col(the_id).eqNullSafe(F.col(f"{the_id}k"))
    for k in keys:
        same &= F.col(k) == F.col(f"{k}k")
    return rows.join(kept, same, "left_semi").select(f"{row}.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    ship(spark)
    return keep_quality(docs, train_quality(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    return _rows_of(docs, exact_dedup(docs), lambda d, name: d.withColumn(name, digest()), ["text_sha256"])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return _rows_of(docs, near_rows(docs), with_words_key, ["k1", "k2"])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes or more that come more than once."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("suffix-array dedup", repeats), ("packing", packing)]

#: The classifier, near dedup and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(ship(spark), sf_dir), None
    for name, stage in STAGES:
        with Scratch() as scratch:  # what a stage writes on the way goes when its result is written
            docs = scratch.keep(written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
        if before is not None:
            discard(spark, before)
        before = docs.written_to
    return docs
