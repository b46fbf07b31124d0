"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

File ``ranks.ids``: unsigned 32-bit ids by falling frequency. File ``PPPPPPPP-NNNNNNNN.tok`` (a shard: file N of range P;
ranges, their shards and the documents in them ascend by doc_id): HEADER (magic, documents, tokens, control bytes, data bytes), the doc_ids (signed 64-bit), a
byte for each document that is 1 where its id is null, the documents' token counts (unsigned 64-bit), the control
bytes and the data bytes. A control byte has the byte lengths less one of four ranks, two bits each from the lowest;
the ranks' bytes follow one another, lowest first. All numbers are little-endian. Table ``starts``: the number of ids
before each shard, by its number P x 2^32 + N; readers join it, so that neither the driver nor a task holds all shards.

Defined cases: null and empty texts have the end id only; null doc_ids come first; rows that repeat an id keep a place
each; an empty table gives no shard and an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.llm.shared import body, shared_folder, written
from landgrid.llm.word_tokens import word_encoder

HEADER = struct.Struct("<8sQQQQ")
MAGIC = b"LGTOKEN1"
CODES = np.arange(256, dtype=np.uint8)
#: Byte lengths of the four ranks of a control byte.
LENGTHS = np.stack([((CODES >> s) & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)
HELD = 700_000  # words that an encoding task remembers
RANGES = 1 << 14  # of doc_ids that tasks write, each one shard after another
BLOCK = 1 << 16  # control bytes decoded at once


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = more
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again, by table lookup of the lengths."""
    control = np.frombuffer(control, np.uint8)
    data = np.frombuffer(data, np.uint8)
    out, at = np.empty(len(control) * 4, np.uint32), 0
    for i in range(0, len(control), BLOCK):
        lengths = LENGTHS[control[i : i + BLOCK]].ravel()
        here = min(len(lengths), n - 4 * i)
        lengths = lengths[:here]
        ends = at + np.cumsum(lengths, dtype=np.int64)
        starts = ends - lengths
        value = data[starts].astype(np.uint32)
        for k in (1, 2, 3):
            longer = np.flatnonzero(lengths > k)
            if not len(longer):
                break
            value[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
        out[4 * i : 4 * i + here] = value
        at = int(ends[-1]) if here else at
    return out[:n]


def pack_shard(doc_ids: list, ids: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    control, data = encode_ranks(rank_of[flat])
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    missing = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    counts = np.array([len(x) for x in ids], "<u8").tobytes()
    return HEADER.pack(MAGIC, len(doc_ids), len(flat), len(control), len(data)) + known + missing + counts + control + data


def unpack_shard(content: bytes, ids_by_rank: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """The doc_ids, the documents' token counts and all ids."""
    magic, n_docs, n, n_control, n_data = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    known = np.frombuffer(content, "<i8", n_docs, at)
    missing = np.frombuffer(content, np.uint8, n_docs, at + 8 * n_docs)
    counts = np.frombuffer(content, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    ranks = decode_ranks(content[at : at + n_control], content[at + n_control : at + n_control + n_data], n)
    return [None if m else d for d, m in zip(known.tolist(), missing.tolist())], counts, ids_by_rank[ranks]


def _encode(path: str, end_id: int):
    def rows(batches):
        encoder = word_encoder(path, HELD)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in encoder.encode_bytes(batch.column("t").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return rows


def encoded_documents(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (bytes of the encoder's dtype, with the end id)."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("t"))
    return df.mapInArrow(_encode(path, end_id), "doc_id long, ids binary")


def _count(dtype: str):
    def rows(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype), minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return rows


def _write(folder: str, dtype: str, rank_of: np.ndarray, shard_tokens: int):
    def rows(batches):
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(folder)
        part, shard, written_ = TaskContext.get().partitionId(), 0, []
        doc_ids, ids, held = [], [], 0

        def write():
            # another attempt at this task writes the same bytes under a name of its own, and the last move stays
            own = f"{place}/_{part:08d}-{shard:08d}-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(pack_shard(doc_ids, ids, rank_of))
            store.move(own, f"{place}/{part:08d}-{shard:08d}.tok")
            written_.append((part << 32 | shard, len(doc_ids), held))

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(raw, dtype))
                held += len(ids[-1])
                if held >= shard_tokens:
                    write()
                    doc_ids, ids, held, shard = [], [], 0, shard + 1
        if doc_ids:
            write()
        columns = list(zip(*written_)) if written_ else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "n_docs", "n_tokens"])

    return rows


def write_token_files(encoded: DataFrame, folder: str, dtype: str, shard_tokens: int = 1 << 22) -> DataFrame:
    """Writes ranks.ids, the shards of about ``shard_tokens`` ids (and one document more) and the table starts; returns that (shard, before)."""
    from pyarrow import fs

    counts = encoded.mapInArrow(_count(dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    total = sum(r["n"] for r in counts)
    by_rank = np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], "<u4")
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    with store.open_output_stream(f"{place}/ranks.ids") as out:
        out.write(by_rank.tobytes())
    ranges = min(RANGES, max(1, math.ceil(total / shard_tokens)))
    tie = F.xxhash64("ids")
    ordered = encoded.repartitionByRange(ranges, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    shards = written(ordered.mapInArrow(_write(folder, dtype, rank_of, shard_tokens), "shard long, n_docs long, n_tokens long"), "token-shards")
    # what comes before a shard: other ranges' shards (RANGES at most), and its own range's before it
    ranges_ = shards.groupBy(F.shiftright("shard", 32).alias("range")).agg(F.sum("n_tokens").alias("n"))
    ahead = lambda *order: F.coalesce(F.sum(order[0]).over(order[1].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    first = ranges_.select("range", ahead("n", Window.orderBy("range")).alias("first"))
    own = shards.select("shard", F.shiftright("shard", 32).alias("range"), ahead("n_tokens", Window.partitionBy(F.shiftright("shard", 32)).orderBy("shard")).alias("own"))
    return written(own.join(first, "range").select("shard", (F.col("first") + F.col("own")).alias("before")), "token-starts")


def _read(by_rank: np.ndarray, full: bool):
    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                doc_ids, counts, ids = unpack_shard(content.as_buffer().to_pybytes(), by_rank)
                part, shard = map(int, name.as_py().rpartition("/")[2].removesuffix(".tok").split("-"))
                ends = np.cumsum(counts)
                starts = ends - counts
                flat = memoryview(ids.astype("<u4", copy=False).tobytes())
                parts = [flat[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                last = pa.array([bytes(x) for x in parts], pa.binary()) if full else pa.array([zlib.crc32(x) for x in parts], pa.int64())
                at = pa.array(np.full(len(doc_ids), part << 32 | shard, np.int64))
                yield pa.RecordBatch.from_arrays([at, pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), last], ["shard", "doc_id", "place", "n_tokens", "ids" if full else "ids_crc32"])

    return rows


def read_token_files(spark: SparkSession, folder: str, starts: DataFrame, full: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens and ids_crc32, or with ``full`` the ids' bytes."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{place}/ranks.ids") as ranks:
        by_rank = np.frombuffer(ranks.read(), "<u4")
    last = "ids" if full else "ids_crc32"
    if not len(by_rank):
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {last} {'binary' if full else 'long'}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    found = files.mapInArrow(_read(by_rank, full), f"shard long, doc_id long, place long, n_tokens long, {last} {'binary' if full else 'long'}")
    return found.join(starts, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", last)


def token_files(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 22, full: bool = False) -> DataFrame:
    """Encodes the texts, writes the files in a new folder of the shared one and reads them back."""
    spark = docs.sparkSession
    encoded = written(encoded_documents(docs, path, end_id, id_col, text_col), "token-ids", codec="zstd")
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    starts = write_token_files(encoded, folder, word_encoder(path).dtype.str, shard_tokens)
    return read_token_files(spark, folder, starts, full)
