"""Exact dedup through an extendible-hash index kept in shared files.

Keys are 64-bit hashes of the normalised text. The directory over the leading key bits takes the keys' load slot by slot;
a bucket that overfills (more bytes of text than ``capacity``) is split, and the directory doubles where the bucket has
one slot only. Map tasks fold the copies they meet themselves, comparing bytes. Owner tasks then read buckets in key
order, chain the texts of one key, compare bytes along the chain and write one index record (bucket, key, digest, least
id, size) for each different text into shared files. Every row looks its record up by bucket, key and digest.

Defined cases: null text is empty text; empty texts equal each other; rows with a null id form groups like others and
a group's smallest id ignores nulls; of rows that repeat both id and text one is kept; an empty table gives an empty
result; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.llm.shared import SPACE, body, hold, tidy, written

ENTRY = "bucket int, key long, digest binary, low long, n_low long, n long, body binary"
RECORD = "bucket int, key long, digest binary, keep_id long, n_low long, group_size long"
OVERHEAD = 100  # bytes of an entry besides its text
FLUSH_BYTES = 32 << 20


class ExtendibleDirectory:
    """Slots for the leading ``depth`` bits of a key; several slots may point to one bucket of smaller local depth."""

    def __init__(self, capacity: int, max_depth: int = 20):
        self.capacity, self.max_depth, self.depth = capacity, max_depth, 0
        self.slots = np.zeros(1, np.int32)
        self.local, self.prefix, self.load = [0], [0], [0]  # by bucket: its local depth, the leading bits of its keys, its bytes
        self.held: list[dict[int, int]] = [{}]  # by bucket: bytes by the max_depth leading bits

    def double(self) -> None:
        self.slots = np.repeat(self.slots, 2)
        self.depth += 1

    def split(self, bucket: int) -> int:
        """Gives the upper half of a bucket's keys to a new bucket, after doubling where it has one slot only."""
        if self.local[bucket] == self.depth:
            self.double()
        self.local[bucket] += 1
        self.prefix[bucket] *= 2
        new, local = len(self.local), self.local[bucket]
        self.local.append(local)
        self.prefix.append(self.prefix[bucket] + 1)
        span = 1 << (self.depth - local)
        self.slots[self.prefix[new] * span : (self.prefix[new] + 1) * span] = new
        bit = self.max_depth - local
        upper = {k: v for k, v in self.held[bucket].items() if k >> bit & 1}
        self.held[bucket] = {k: v for k, v in self.held[bucket].items() if not k >> bit & 1}
        self.held.append(upper)
        self.load.append(sum(upper.values()))
        self.load[bucket] -= self.load[new]
        return new

    def insert(self, leading: int, size: int) -> None:
        """Adds bytes under the ``max_depth`` leading bits of their keys; overfull buckets split while their keys differ in those."""
        bucket = int(self.slots[leading >> (self.max_depth - self.depth)])
        self.held[bucket][leading] = self.held[bucket].get(leading, 0) + size
        self.load[bucket] += size
        todo = [bucket]
        while todo:
            bucket = todo.pop()
            if self.load[bucket] > self.capacity and self.local[bucket] < self.max_depth and len(self.held[bucket]) > 1:
                todo += [bucket, self.split(bucket)]

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(keys), np.int32)
        return self.slots[(keys.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


class Chains:
    """Records by key; those of one key but other bytes follow each other in a chain."""

    def __init__(self):
        self.by_key: dict[int, list[list]] = {}
        self.size = 0

    def add(self, key: int, digest: bytes, low: int | None, n_low: int, n: int, text: bytes) -> None:
        chain = self.by_key.setdefault(key, [])
        for record in chain:
            if record[4] == text:
                if low is not None and (record[1] is None or low < record[1]):
                    record[1], record[2] = low, n_low
                elif low == record[1]:
                    record[2] += n_low
                record[3] += n
                return
        chain.append([digest, low, n_low, n, text])
        self.size += len(text) + OVERHEAD

    def records(self):
        for key, chain in self.by_key.items():
            for record in chain:
                yield key, *record


def _batches(chains: Chains, directory: ExtendibleDirectory, rows: int = 2000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    records, held = [], 0
    for record in chains.records():
        records.append(record)
        held += len(record[-1])
        if len(records) == rows or held > size:
            yield _entries(records, directory)
            records, held = [], 0
    if records:
        yield _entries(records, directory)


def _entries(records: list[tuple], directory: ExtendibleDirectory) -> pa.RecordBatch:
    key, digest, low, n_low, n, text = map(list, zip(*records))
    buckets = directory.bucket_of(np.array(key, np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(key, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.int64()), pa.array(n_low, pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.binary())],
        ["bucket", "key", "digest", "low", "n_low", "n", "body"],
    )


def _fold(directory: ExtendibleDirectory):
    def rows(batches):
        hold("exact")
        chains = Chains()
        for batch in batches:
            for record in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "low", "n_low", "n", "body"))):
                chains.add(*record)
            if chains.size > FLUSH_BYTES:
                yield from _batches(chains, directory)
                chains = Chains()
        yield from _batches(chains, directory)

    return tidy(rows)


def _own(batches):
    """An owner's task: entries in the order of their keys; it holds the chain of one key at a time."""
    hold("exact")
    chains, at, out = Chains(), None, []

    def record_batch():
        columns = list(zip(*out)) if out else [()] * 6
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "key", "digest", "keep_id", "n_low", "group_size"])

    for batch in batches:
        for bucket, key, *record in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "digest", "low", "n_low", "n", "body"))):
            if at != (bucket, key):
                out += [(at[0], *found[:-1]) for found in chains.records()] if at else []
                chains, at = Chains(), (bucket, key)
            chains.add(key, *record)
        if len(out) > 10_000:
            yield record_batch()
            out = []
    out += [(at[0], *found[:-1]) for found in chains.records()] if at else []
    yield record_batch()


def _placed(directory: ExtendibleDirectory):
    def rows(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(directory.bucket_of(keys), pa.int32())], [*batch.schema.names, "bucket"])

    return rows


def digest(text_col: str = "text") -> Column:
    """Of the normalised text, as lowercase hex."""
    return F.sha2(_plain(text_col).cast("binary"), 256)


def _plain(text_col: str) -> Column:
    return F.regexp_replace(body(text_col), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 8 << 20, max_bits: int = 20) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Parameters: ``capacity`` bytes of text to a bucket before it is split, ``max_bits`` leading key bits at most in the
    directory (its size bound). Owner tasks stream through their buckets, so that a bucket beyond either bound costs
    time but no memory.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), _plain(text_col).alias("plain"))
    keyed = plain.select("doc_id", F.xxhash64("plain").alias("key"), F.unhex(F.sha2(F.col("plain").cast("binary"), 256)).alias("digest"), F.col("plain").cast("binary").alias("body"))
    entries = written(keyed.select("doc_id", "key", "digest", F.length("body").alias("size"), F.monotonically_increasing_id().alias("row")), "exact-entries")
    total = entries.agg(F.sum(F.col("size") + OVERHEAD)).first()[0] or 0
    bits = min(max_bits, max(4, math.ceil(math.log2(max(1, total / capacity))) + 4))
    slots = entries.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("slot")).agg(F.sum(F.col("size") + OVERHEAD).alias("size")).collect()  # at most 2^max_bits
    directory = ExtendibleDirectory(capacity, bits)
    for slot, size in sorted(tuple(r) for r in slots):
        directory.insert(slot, size)
    directory.held = []  # tasks need the slots only

    one = F.lit(1).cast("long")
    rows = keyed.select("key", "digest", F.col("doc_id").alias("low"), one.alias("n_low"), one.alias("n"), "body")
    folded = rows.mapInArrow(_fold(directory), ENTRY)
    # a bucket's entries meet in its owner, in key order; the sort may spill
    owned = folded.repartition("bucket").sortWithinPartitions("bucket", "key")
    index = written(owned.mapInArrow(_own, RECORD), "exact-index")

    looked_up = entries.select("row", "doc_id", "key", "digest").mapInArrow(_placed(directory), "row long, doc_id long, key long, digest binary, bucket int")
    joined = looked_up.join(index, ["bucket", "key", "digest"])
    row = joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), (F.col("n_low") > 1).alias("again"), "row"
    )
    twice = row.filter("kept and again")  # rows that repeat id and text, or groups of null ids: one stays
    first = twice.groupBy("text_sha256").agg(F.min("row").alias("first"))
    one_kept = twice.join(first, "text_sha256").withColumn("kept", F.col("row") == F.col("first")).select(*row.columns)
    return row.filter("not (kept and again)").unionByName(one_kept).drop("again", "row")
