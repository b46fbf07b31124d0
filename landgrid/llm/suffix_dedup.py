"""Removal of long repeated substrings, by suffix intervals on Burrows-Wheeler transforms.

All of a corpus has no one transform that a task could hold. Each window of ``least`` bytes is therefore dealt by its
anchor, the leftmost of its runs of GRAM bytes of least hash: equal windows have equal anchors at equal places, so that
what an anchor's windows cover, its segment, meets all its equals in the group of the anchor's hash. Anchors that occur
once hold no repeat. The different segments of groups go to tasks of about TASK_BYTES, where interval expansion on their
transform (bwt.py) finds the repeats among them; a group's only segment needs none, as it repeats as a whole.

A group beyond ``most_bytes`` is dealt on: its segments are cut in two, the windows that have the anchor in their later
half and the others, and each part goes to a group of the bytes that all its windows have beside the anchor. Equal
windows still meet, a part has at most ``least`` bytes more than its windows, and when a group's windows have the anchor
at one place only, its bytes are those of one window. So hot passages end in small groups after a few rounds.

Texts are told apart by 128 bits of their SHA-256; documents of equal text are one text with copies, each of whose
windows is a repeat. Segments are told apart within a group by 64 bits of their own beside those of the group.

Defined cases: null and empty texts, and texts of fewer than ``least`` bytes, lose nothing; rows that repeat an id or a
text are copies of each other; a removal may cut a character in two, so what is kept is bytes; an empty table gives an
empty result; only the id and text columns are read, and other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.llm.bwt import repeated_starts
from landgrid.llm.near_dedup import mix
from landgrid.llm.shared import Scratch, body, hold, key_bitmap, tidy, unused, written

GRAM = 32
CHUNK = 1 << 18  # bytes of segments given on at once
HASHED = 1 << 16  # bytes hashed at once; some 120 bytes of arrays for each
TASK_BYTES = 1 << 20
MOST_BYTES = 2 << 20
POINT = np.uint64(0xD6E8FEB86659FD93)
PLACE = np.uint64((1 << 24) - 1)
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * POINT)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def gram_size(least: int) -> int:
    """Of an anchor: a power of two."""
    return 1 << (min(GRAM, least).bit_length() - 1)


def anchors(texts: list[bytes | memoryview], least: int) -> tuple[np.ndarray, ...]:
    """Text number, hash, first window, number of windows and place (from the first window's start) of each anchor; texts together under 16 MB."""
    raw = VALUES[np.frombuffer(b"".join(texts), np.uint8)]
    factor, size = int(POINT), 1
    while size < gram_size(least):  # polynomial hashes of runs of twice the size
        raw = raw[:-size] * np.uint64(factor) + raw[size:] if len(raw) > size else raw[:0]
        factor, size = factor * factor % (1 << 64), 2 * size
    gram = mix(raw)
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(0, lengths - least + 1)
    if not counts.any():
        return tuple(np.empty(0, np.int64) for _ in range(5))
    begins = np.cumsum(lengths) - lengths
    low, span, width = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64), 1, least - size + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    text = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    start = np.arange(ends[-1]) + np.repeat(begins - (ends - counts), counts)
    at = (low[start] & PLACE).astype(np.int64)
    change = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    windows = np.diff(np.append(change, len(at)))
    return text[change], gram[at[change]].view(np.int64), start[change] - begins[text[change]], windows, at[change] - start[change]


def _find_anchors(least: int):
    def rows(batches):
        hold("suffix")
        seen: set[bytes] = set()
        for batch in batches:
            keys, texts, held = [], [], 0
            for key, value in zip(batch.column("key").to_pylist(), batch.column("t")):
                text = memoryview(value.as_buffer())  # of the batch; nothing is copied
                if len(text) < least or key in seen:
                    continue
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(key)
                for a in range(0, len(text) - least + 1, HASHED):  # parts overlap so that each window is in one
                    if held + len(text) - a > HASHED and texts:
                        yield _anchor_rows(keys, texts, least)
                        keys, texts, held = [], [], 0
                    part = text[a : a + HASHED + least - 1]
                    keys.append((key, a))
                    texts.append(part)
                    held += len(part)
            if texts:
                yield _anchor_rows(keys, texts, least)

    return tidy(rows)


def _anchor_rows(keys, texts, least: int) -> pa.RecordBatch:
    """A row for each different segment of a text, with all places where it begins there."""
    text, gram, first, windows, at = anchors(texts, least)
    begin = np.array([b for _, b in keys], np.int64)
    order = np.lexsort((first, windows, gram, text))
    text, gram, first, windows, at = text[order], gram[order], first[order], windows[order], at[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1]) | (windows[1:] != windows[:-1])
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, len(text)))
    single = begins[sizes == 1]
    several: list[list[int]] = []  # the places of each segment whose anchor comes again in its text, as in text that repeats itself
    for i, n in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        alike: dict[bytes, list[int]] = {}
        for j in range(i, i + n):
            alike.setdefault(bytes(texts[text[j]][first[j] : first[j] + windows[j] - 1 + least]), []).append(j)
        several += alike.values()
    rows = np.concatenate([single, np.array([own[0] for own in several], np.int64)])
    flat = np.concatenate([single, *(np.array(own, np.int64) for own in several)])
    ends = np.cumsum(np.concatenate([np.ones(len(single), np.int64), np.array([len(own) for own in several], np.int64)]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in keys], pa.binary()).take(pa.array(text[rows])), pa.array(gram[rows].astype(np.int64)), pa.array(windows[rows].astype(np.int32)), pa.array(at[rows].astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(begin[text[flat]] + first[flat])),
        ],
        ["key", "gram", "windows", "at", "firsts"],
    )


def _hits(low: pa.Array, bitmap: np.ndarray, bits: int) -> np.ndarray:
    bit = low.to_numpy(zero_copy_only=False).astype(np.int64) & ((1 << bits) - 1)
    return ((bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _with_text(bitmap: np.ndarray, bits: int):
    """Texts whose key's bit is set, once for a task."""

    def rows(batches):
        hold("suffix")
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            keys = batch.column("key").to_pylist()
            for i in np.flatnonzero(_hits(batch.column("low"), bitmap, bits)).tolist():
                if keys[i] not in seen:
                    if len(seen) > 300_000:
                        seen.clear()
                    seen.add(keys[i])
                    keep.append(i)
            yield batch.select(["key", "t"]).take(pa.array(keep, pa.int64()))

    return tidy(rows)


def _cut(least: int):
    """The segments of each text's anchors; a batch gives the bytes of a segment it has met before no more."""

    def rows(batches):
        hold("suffix")
        for batch in batches:
            met: set[tuple[int, int]] = set()
            out: list[list] = [[] for _ in PLACE_COLUMNS]
            held = 0
            for i in range(batch.num_rows):
                key, text = batch.column("key")[i].as_py(), batch.column("t")[i].as_py()
                for a in batch.column("found")[i].as_py():
                    segment = text[a["firsts"][0] : a["firsts"][0] + a["windows"] - 1 + least]
                    name = _name(segment)
                    new = (a["gram"], name) not in met
                    met.add((a["gram"], name))
                    held += len(segment) if new else 0
                    for column, value in zip(out, (key, a["gram"], name, a["firsts"], a["at"], segment if new else None)):
                        column.append(value)
                if held > CHUNK:
                    yield _places(out)
                    out, held, met = [[] for _ in PLACE_COLUMNS], 0, set()
            yield _places(out)

    return tidy(rows)


PLACE_COLUMNS = {"key": pa.binary(), "gram": pa.int64(), "name": pa.int64(), "firsts": pa.list_(pa.int64()), "at": pa.int32(), "segment": pa.binary()}


def _places(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PLACE_COLUMNS.values())], list(PLACE_COLUMNS))


def _name(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(piece) - (1 << 63)


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Ascending places as runs (first, last)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.concatenate([cut, [len(places) - 1]])].tolist()))


def _search(least: int):
    """A task's groups: a group's only segment is a repeat if it has several places, of the others the transform tells."""

    def one(table: pa.Table) -> pa.Table:
        hold("suffix")
        gram, name, times, size = (np.array(table.column(c).to_pylist(), np.int64) for c in ("gram", "name", "times", "size"))
        _, group, kinds = np.unique(gram, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(kinds[group] > 1)
        rows = [(int(gram[i]), int(name[i]), 0, int(size[i]) - least) for i in np.flatnonzero((times > 1))]
        segments = table.column("segment").take(pa.array(mixed)).to_pylist()
        del table
        for i, places in zip(mixed.tolist(), repeated_starts(segments, least)):
            if times[i] == 1:
                rows += [(int(gram[i]), int(name[i]), a, b) for a, b in _runs(places)]
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["gram", "name", "lo", "hi"])

    return one


PARTS = "up_gram long, up_name long, shift long, gram long, name long, times long, at int, lo int, hi int, size int, segment binary"


def halves(segment: bytes, at: int, lo: int, hi: int, gram: int, least: int):
    """The parts (shift, group, lo, hi, bytes) of a segment whose windows have their anchor lo to hi bytes from their start.

    at: the anchor's place in the segment, so that window k has it at ``at - k``.
    """
    middle, last = (lo + hi + 1) // 2, len(segment) - least
    if at >= middle:  # windows with so many bytes before the anchor: all of them have segment[at - middle : at]
        yield 0, _name(struct.pack("<qi", gram, middle) + segment[at - middle : at]), middle, hi, segment[: min(last, at - middle) + least]
    if (first := max(0, at - middle + 1)) <= last:  # the others end behind the anchor by so many bytes at least
        yield first, _name(struct.pack("<qi", gram, -middle) + segment[at : at + least - middle + 1]), lo, middle - 1, segment[first:]


def _deal_on(least: int):
    kinds = [pa.int64()] * 6 + [pa.int32()] * 4 + [pa.binary()]
    names = [x.split()[0] for x in PARTS.split(", ")]

    def rows(batches):
        hold("suffix")
        for batch in batches:
            out = []
            for gram, name, times, at, lo, hi, segment in zip(*(batch.column(c).to_pylist() for c in ("gram", "name", "times", "at", "lo", "hi", "segment"))):
                for shift, group, low, high, part in halves(segment, at, lo, hi, gram, least):
                    out.append((gram, name, shift, group, _name(part), times, at - shift, low, high, len(part), part))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(names), kinds)], names)

    return tidy(rows)


def _flagged(segments: DataFrame, least: int, task_bytes: int, most_bytes: int) -> DataFrame:
    """gram, name, lo, hi: the windows lo to hi of a segment repeat. Segments are told apart by gram and name."""
    groups = segments.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes"), F.max(F.col("hi") - F.col("lo")).alias("span"))
    hot = written(groups.filter((F.col("bytes") > most_bytes) & (F.col("kinds") > 1) & (F.col("span") > 0)).select("gram"), "suffix-hot")
    some_hot = not hot.isEmpty()
    rest = segments.join(hot, "gram", "left_anti") if some_hot else segments
    tasks = max(1, math.ceil((segments.agg(F.sum("size")).first()[0] or 0) / task_bytes))
    dealt = rest.select("gram", "name", "times", "size", "segment", F.pmod(F.xxhash64("gram"), F.lit(tasks)).alias("task"))
    found = dealt.groupBy("task").applyInArrow(_search(least), "gram long, name long, lo long, hi long")
    if not some_hot:
        return found
    large = segments.join(hot, "gram", "left_semi").select("gram", "name", "times", "at", "lo", "hi", "segment")
    parts = written(large.mapInArrow(_deal_on(least), PARTS), "suffix-parts")
    first = [F.first(c).alias(c) for c in ("at", "lo", "hi", "size")]
    finer = written(parts.groupBy("gram", "name").agg(F.sum("times").alias("times"), *first, F.max("segment").alias("segment")), "suffix-finer")
    below = _flagged(finer, least, task_bytes, most_bytes).join(parts.select("gram", "name", "up_gram", "up_name", "shift"), ["gram", "name"])
    return found.unionByName(below.select(F.col("up_gram").alias("gram"), F.col("up_name").alias("name"), (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi")))


def repeated_windows(docs: DataFrame, least: int = 200, task_bytes: int = TASK_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """See _repeated_windows; of the tables on the way only the result stays."""
    with Scratch() as scratch:
        return scratch.keep(_repeated_windows(docs, least, task_bytes, most_bytes))


def _repeated_windows(docs: DataFrame, least: int, task_bytes: int, most_bytes: int) -> DataFrame:
    """docs: key and low (hashes of the text, see _keyed) and t (bytes). key, low and found: lists (firsts, lo, hi); the windows that start lo to hi bytes from any of firsts repeat.

    For texts with copies, ``copies`` is above 1 and found is null: all their windows repeat.
    """
    every = written(docs.select("key"), "suffix-texts")
    copies = every.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1")
    found = written(docs.select("key", "t").mapInArrow(_find_anchors(least), "key binary, gram long, windows int, at int, firsts array<long>"), "suffix-anchors")
    # an anchor repeats where two places differ, in one text or not; the same place of a copy in another task is the same
    place = F.when(F.size("firsts") == 1, F.xxhash64("key", F.col("firsts")[0]))
    twice = found.select("gram", place.alias("p")).groupBy("gram").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count_if(F.col("p").isNull()).alias("again"))
    twice = twice.filter("again > 0 or a <> b").select("gram")
    wanted = found.join(twice, "gram").groupBy("key").agg(F.collect_set(F.struct("gram", "windows", "at", "firsts")).alias("found"))
    wanted = written(wanted, "suffix-wanted")
    bitmap, bits = key_bitmap(wanted.select(F.xxhash64("key").alias("key")))
    texts = docs.mapInArrow(_with_text(bitmap, bits), "key binary, t binary").groupBy("key").agg(F.first("t").alias("t"))
    places = texts.join(wanted, "key").mapInArrow(_cut(least), "key binary, gram long, name long, firsts array<long>, at int, segment binary")
    places = written(places, "suffix-places")

    # map tasks fold a hot segment's places before the shuffle
    segments = places.groupBy("gram", "name").agg(F.sum(F.size("firsts").cast("long")).alias("times"), F.max("segment").alias("segment"), F.first("at").alias("at"))
    segments = segments.select("*", F.length("segment").alias("size"), F.lit(0).alias("lo"), F.lit(least - gram_size(least)).alias("hi"))
    flagged = written(_flagged(written(segments, "suffix-segments"), least, task_bytes, most_bytes), "suffix-flagged")
    spans = places.select("key", "gram", "name", "firsts").join(flagged, ["gram", "name"])
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("firsts", "lo", "hi")).alias("found"))
    both = spans.join(copies, "key", "full_outer")
    both = both.select("key", F.xxhash64("key").alias("low"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.when(F.col("copies") > 1, None).otherwise(F.col("found")).alias("found"))
    return written(both, "suffix-spans")


def _starts(found) -> list[tuple[int, int]]:
    return [(first + x["lo"], first + x["hi"]) for x in found or () for first in x["firsts"]]


def removed_runs(found: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes (start, end) that the windows starting in the given ranges cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + least)
        else:
            out.append([lo, hi + least])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    starts = [*(a for a, _ in runs), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts))


def _text_or_digest(bitmap: np.ndarray, bits: int):
    """Texts that may have repeats go on; of the others the digest is all that is needed."""

    def rows(batches):
        for batch in batches:
            hit = _hits(batch.column("low"), bitmap, bits)
            texts = batch.column("t")
            sizes = [len(t.as_buffer()) for t in texts]
            digests = [None if h else hashlib.sha256(t.as_buffer()).hexdigest() for t, h in zip(texts, hit.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pc.if_else(pa.array(hit), texts, pa.scalar(None, texts.type))], ["doc_id", "key", "n_bytes", "sha", "t"]
            )

    return rows


def _finished(least: int):
    def rows(batches):
        hold("suffix")
        for batch in batches:
            out: list[list] = [[], [], []]
            for n, sha, text, copies, found in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "sha", "t", "copies", "found"))):
                if (copies or 1) > 1 and n >= least:
                    row = (n, 1, EMPTY_SHA)
                elif text is None:
                    row = (0, 0, sha)
                else:
                    runs = removed_runs(_starts(found), least)
                    row = (sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(text, runs)).hexdigest())
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t (bytes), key (128 bits of the bytes' SHA-256) and low (64 bits for bitmaps)."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).cast("binary").alias("t"))
    return df.select("doc_id", "t", _key("t").alias("key")).withColumn("low", F.xxhash64("key"))


def _key(raw: Column | str) -> Column:
    return F.substring(F.unhex(F.sha2(raw, 256)), 1, 16)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, task_bytes: int = TASK_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_windows(keyed.select("key", "low", "t"), least, task_bytes, most_bytes)
    bitmap, bits = key_bitmap(spans.filter("copies = 1").select(F.col("low").alias("key")))
    rows = keyed.mapInArrow(_text_or_digest(bitmap, bits), "doc_id long, key binary, n_bytes long, sha string, t binary").join(spans.drop("low"), "key", "left")
    return rows.mapInArrow(_finished(least), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cleaned(least: int, names: list[str], text_col: str, copies_col: str, found_col: str):
    def rows(batches):
        for batch in batches:
            texts = []
            for text, copies, found in zip(*(batch.column(c).to_pylist() for c in (text_col, copies_col, found_col))):
                if found or (copies or 1) > 1:
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    text = kept_bytes(raw, removed_runs(_starts(found), least)).decode("utf-8", "ignore") if found else "" if len(raw) >= least else text
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200) -> DataFrame:
    """docs with their repeated bytes removed from the text; a character that a removal cuts in two goes with it."""
    spans = repeated_windows(_keyed(docs, id_col, text_col).select("key", "low", "t"), least)
    key, copies, found = unused(docs.columns, "_key", "_copies", "_found")
    spans = spans.select(F.col("key").alias(key), F.col("copies").alias(copies), F.col("found").alias(found))
    rows = docs.withColumn(key, _key(body(text_col).cast("binary"))).join(spans, key, "left").drop(key)
    return rows.mapInArrow(_cleaned(least, docs.columns, text_col, copies, found), docs.schema)
