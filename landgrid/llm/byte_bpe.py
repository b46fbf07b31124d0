"""Byte-level BPE encoding and decoding with overlapping chunks.

A text longer than a chunk is cut into chunks that overlap; chunks are pre-tokenised in parallel, and a document's
chunks are stitched at a place in the overlap that is a boundary in both. The boundaries that a chunk shows within
GUARD characters of its end may be wrong, as the pattern looks ahead; those before are right from any right start on.
Where an overlap has no common boundary (a run longer than it), the text is pre-tokenised on from the last right one.
The pieces are then encoded by rank; decoding joins the raw bytes of the ids.

Defined cases: null and empty texts have no ids; rows that repeat an id are encoded row by row; an empty table gives
an empty result; only the id and text columns are read, and other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.shared import body, hold

GUARD = 4
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL = "doc_id long, ids binary, decoded binary"


class RankEncoder:
    """Encodes pieces by the ranks of a file; what a piece of a stitched text gives is remembered, up to ``held`` pieces."""

    def __init__(self, path: str, pattern: str, held: int = 300_000):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        # white space as the rank library has it; other engines count the separators 1C to 1F as well
        white = r"[\p{White_Space}]"
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", white).replace(r"\S", r"[^\p{White_Space}]"))
        self.known: dict[str, bytes] = {}
        self.held = held

    def boundaries(self, text: str) -> list[int]:
        """The ends of the pattern's matches."""
        return [m.end() for m in self.pattern.finditer(text)]

    def encode(self, text: str) -> bytes:
        """Ids of a text of one chunk, as little-endian unsigned 32-bit integers."""
        return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def encode_pieces(self, pieces: list[str]) -> bytes:
        known = self.known
        if len(known) > self.held:
            known.clear()
        for piece in {p for p in pieces if p not in known}:
            known[piece] = self.encode(piece)
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> RankEncoder:
    return RankEncoder(path, pattern)


def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """One for each Python worker."""
    encoder = _encoder(path, pattern)
    hold("ranks", _encoder.cache_clear)
    return encoder


def stitch(chunks: list[tuple[int, str, list[int]]], boundaries) -> list[str]:
    """The pieces of a text from its chunks (start, text, ends of matches in the chunk), in order.

    What has shown no sure boundary is scanned again only when it has doubled, so that long runs cost linear time.
    """
    pieces: list[str] = []
    at, end = 0, 0  # a right boundary that all pieces end at; where the text that is held ends
    held: list[str] = []  # the text from at on that the chunks so far have shown
    scanned = 0  # characters of it that gave no boundary
    for k, (start, text, ends) in enumerate(chunks):
        last = k == len(chunks) - 1
        if at < start or scanned:  # the chunk before had no boundary in common with this one
            held.append(text[end - start :])
            end = start + len(text)
            if end - at < 2 * scanned and not last:
                continue
            text, start = "".join(held), at
            ends = boundaries(text)
        elif at - start not in {0, *ends}:
            text, start = text[at - start :], at
            ends = boundaries(text)
        places = [p for p in (start, *(start + e for e in ends)) if p >= at]
        if not last:
            following, _, theirs = chunks[k + 1]
            meeting = {following, *(following + e for e in theirs)}
            sure = [p for p in places if p <= start + len(text) - GUARD] or [at]
            stop = next((p for p in sure if p in meeting), sure[-1])
            places = [p for p in places if p <= stop]
        end = start + len(text)
        scanned = end - at if places[-1] == at else 0
        pieces += [text[a - start : b - start] for a, b in zip(places, places[1:])]
        at = places[-1]
        held = [text[at - start :]]
    return pieces


def _digests(path: str, pattern: str, full: bool):
    def rows(batches):
        encoder = rank_encoder(path, pattern)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column("t").to_pylist()]
            yield _result(batch.column("doc_id"), ids, encoder, full)

    return rows


def _result(doc_ids, ids: list[bytes], encoder: RankEncoder, full: bool) -> pa.RecordBatch:
    decoded = [encoder.decode(x) for x in ids]
    if full:
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])
    digest = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) // 4 for x in ids], pa.int64()), digest(ids), digest(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _cut(chunk: int, overlap: int):
    def rows(batches):
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "t"))):
                starts = range(0, max(1, len(text) - overlap), chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(starts), pa.int64()), pa.array([doc_id] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array([text[s : s + chunk + overlap] for s in starts], pa.string())],
                    ["row", "doc_id", "start", "chunk"],
                )

    return rows


def _pretokenise(path: str, pattern: str):
    def rows(batches):
        encoder = rank_encoder(path, pattern)
        for batch in batches:
            ends = [encoder.boundaries(t) for t in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "start", "chunk")), pa.array(ends, pa.list_(pa.int32()))], ["row", "doc_id", "start", "chunk", "ends"])

    return rows


def _stitched(path: str, pattern: str, full: bool):
    def one(table: pa.Table) -> pa.Table:
        encoder = rank_encoder(path, pattern)
        table = table.sort_by("start")
        chunks = list(zip(*(table.column(c).to_pylist() for c in ("start", "chunk", "ends"))))
        doc_id = pa.array(table.column("doc_id").to_pylist()[:1], pa.int64())
        return pa.Table.from_batches([_result(doc_id, [encoder.encode_pieces(stitch(chunks, encoder.boundaries))], encoder, full)])

    return one


def byte_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 15, overlap: int = 1 << 9, full: bool = False) -> DataFrame:
    """One row for each document: its ids' count and digests, or with ``full`` its ids and decoded bytes.

    Parameters: ``chunk`` characters and ``overlap`` more to a chunk of a longer text.
    """
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("t"))
    schema = FULL if full else RESULT
    short = df.filter(F.length("t") <= chunk).mapInArrow(_digests(path, pattern, full), schema)
    long = df.filter(F.length("t") > chunk).withColumn("row", F.monotonically_increasing_id())
    cut = long.mapInArrow(_cut(chunk, overlap), "row long, doc_id long, start long, chunk string").repartition("row", "start")
    ends = cut.mapInArrow(_pretokenise(path, pattern), "row long, doc_id long, start long, chunk string, ends array<int>")
    return short.unionByName(ends.groupBy("row").applyInArrow(_stitched(path, pattern, full), schema))
