"""Order-preserving packing of documents into sequences.

A task lays its documents' ids end to end in blocks and chooses the cuts of each block by dynamic programming: cuts may
fall at the ends of documents or sentences, and every part of FORCED of a window inside runs that are longer, at a penalty that only
pays where it spares as many ids of padding, which few sentences but those longer than a window do. With f(j) the least cost
up to cut j, f(j) = min over i with p(j) - p(i) <= W of f(i) + (W - (p(j) - p(i))) + penalty(j): the padding of the
window plus what its cut costs. The least f(i) + p(i) in the sliding window comes from a monotone queue, so that a
block takes linear time. The last window of a block, the only one that may be far from full, is cut on into powers of
two, which need no padding.

Defined cases: null and empty texts have the end id only; rows that repeat an id are packed row by row; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.shared import body, tidy
from landgrid.llm.word_tokens import word_encoder

FORCED = 32  # of a window: the step of cuts within a sentence, and the padding that such a cut must spare
PENALTY_SENTENCE = 2  # in ids of padding
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_points(ends: np.ndarray, sentences: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places where a cut may fall (0 first) and what each costs. ends: of documents; sentences: of sentences."""
    natural = np.unique(np.concatenate([[0], ends, sentences]))
    gaps = np.diff(natural)
    step = max(1, window // FORCED)
    forced = [np.arange(natural[k] + step, natural[k + 1], step) for k in np.flatnonzero(gaps > step)]
    places = np.unique(np.concatenate([natural, *forced])).astype(np.int64) if forced else natural.astype(np.int64)
    cost = np.full(len(places), max(PENALTY_SENTENCE + 1, window // FORCED), np.int64)
    cost[np.searchsorted(places, sentences)] = PENALTY_SENTENCE
    cost[np.searchsorted(places, ends)] = 0
    return places, cost


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int) -> list[int]:
    """Ends of the windows of least total padding plus cost. No gap between places may pass window.

    The last window counts what it is cut on into, see tail_cost, and no padding.
    """
    p, c = places.tolist(), cost.tolist()
    back = [0] * len(p)
    f = [0] * len(p)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (f + p, p, index) with f + p ascending
    last = len(p) - 1
    for j in range(1, last):
        at = p[j]
        while at - queue[0][1] > window:
            queue.popleft()
        least, _, back[j] = queue[0]
        g = least + window + c[j]  # f(j) + p(j) = least + window - p(j) + cost(j) + p(j)
        f[j] = g - at
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, at, j))
    near = range(int(np.searchsorted(places, p[last] - window)), last)
    back[last] = min(near, key=lambda i: f[i] + tail_cost(p[last] - p[i], window), default=0)
    cuts, j = [], last
    while j:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


def tail_cost(length: int, window: int) -> int:
    """Of a last window: eight ids for each of the powers of two but one."""
    return 8 * (len(powers(length, window)) - 1)


def powers(length: int, window: int) -> list[int]:
    """Lengths of the sequences for a last window: itself where it is full, else powers of two."""
    return [length] if length == window else [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def pack_block(doc_ids: list, ids: list[np.ndarray], stops: np.ndarray, window: int, first_sequence: int) -> tuple[pa.RecordBatch | None, int]:
    """The pieces of a block's documents, and the number of the next sequence."""
    lengths = np.array([len(x) for x in ids], np.int64)
    ends = np.cumsum(lengths)
    if not len(ends):
        return None, first_sequence
    flat = np.concatenate(ids)
    places, cost = cut_points(ends, np.flatnonzero(np.isin(flat, stops)) + 1, window)
    cuts = best_cuts(places, cost, window)
    tail = cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0)
    begins = [0, *cuts[:-1]]
    begins += (begins[-1] + np.cumsum(powers(tail, window))[:-1]).tolist()
    sequences, total = np.array(begins, np.int64), int(ends[-1])
    at = np.unique(np.concatenate([ends - lengths, sequences]))
    doc, seq = np.searchsorted(ends, at, "right"), np.searchsorted(sequences, at, "right") - 1
    size = np.diff(np.append(at, total))
    raw = memoryview(flat.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist())]
    long = lambda x: pa.array(x, pa.int64())
    batch = pa.RecordBatch.from_arrays(
        [long([doc_ids[d] for d in doc.tolist()]), long(at - (ends - lengths)[doc]), long(size), long(crc), long(lengths[doc]), long(first_sequence + seq), long(at - sequences[seq])],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )
    return batch, first_sequence + len(sequences)


def _pack(path: str, end_id: int, window: int, block: int):
    def rows(batches):
        encoder = word_encoder(path)
        stops, end = encoder.sentence_ends(), np.array([end_id], encoder.dtype).tobytes()
        sequence = TaskContext.get().partitionId() << 36
        doc_ids, ids, held = [], [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encoder.encode_bytes(batch.column("t").to_pylist())):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(raw + end, encoder.dtype))
                held += len(ids[-1])
                if held >= block:
                    packed, sequence = pack_block(doc_ids, ids, stops, window, sequence)
                    yield packed
                    doc_ids, ids, held = [], [], 0
        packed, _ = pack_block(doc_ids, ids, stops, window, sequence)
        if packed is not None:
            yield packed

    return tidy(rows)


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = 2048, block: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences have at most ``window`` ids; ``block`` ids bound what a task holds (besides one document). Documents
    keep the order of their input partition; no rows move between tasks.
    """
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("t"))
    return df.mapInArrow(_pack(path, end_id, window, block), RESULT)
