"""Burrows-Wheeler transform of many strings, and the places of long repeats by threshold-bounded interval expansion."""

from __future__ import annotations

import numpy as np

END, BREAK, FIRST = 0, 1, 2  # the text's end, a break between strings, the symbol of byte 0
PACKED = 7  # symbols of nine bits in a first sort key


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the strings with breaks between them and an end, and where each string starts."""
    raw = np.frombuffer(b"\0".join(strings), np.uint8).astype(np.uint16) + FIRST
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    raw[starts[1:] - 1] = BREAK
    return np.append(raw, np.uint16(END)), starts


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes' first ``depth`` symbols at least (prefix doubling).

    A place's rank is the first row of its group of equal prefixes; only groups of several are sorted further.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(PACKED, symbols.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(PACKED):
        key = key << np.uint64(9) | padded[i : i + n]
    del padded
    order = np.argsort(key).astype(np.int32)
    rank = np.empty(n + depth, np.uint32)
    rank[n:] = 0
    rows = np.arange(n, dtype=np.int32)  # where the places still to be told apart stand
    known = PACKED
    while True:
        ordered = key if len(rows) < n else key[order]
        new = np.empty(len(rows), bool)
        new[:1] = True
        new[1:] = ordered[1:] != ordered[:-1]
        first = rows[np.flatnonzero(new)]
        rank[order[rows]] = first[np.cumsum(new) - 1] + 1
        several = ~new
        several[:-1] |= ~new[1:]
        rows = rows[several]
        if known >= depth or not len(rows):
            return order
        places = order[rows]
        key = rank[places].astype(np.uint64) << np.uint64(32) | rank[np.minimum(places.astype(np.int64) + known, n)]
        by = np.argsort(key)
        order[rows] = places[by]
        key = key[by]
        known *= 2


def transform(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The symbol before each suffix, in the suffixes' order."""
    return symbols[order - 1]


def short_prefixes(bwt: np.ndarray, least: int) -> np.ndarray:
    """For each row and one past the last, whether it shares fewer than ``least`` symbols with the row before.

    Breadth first: an interval of rows that start with a string w is extended backward by each symbol c before them, to
    the interval of c w; the row after that interval, if not yet known, shares exactly len(w) symbols with it. Values
    are thus found in increasing order, and rows not reached when len(w) gets to ``least`` share as many or more.
    """
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable")
    by_symbol = by_symbol.astype(np.int32)
    back = np.empty(n, np.int32)  # the row of the suffix that is one symbol longer
    back[by_symbol] = np.arange(n, dtype=np.int32)
    following, previous = np.full(n, n, np.int32), np.full(n, -1, np.int32)  # rows with the same symbol before them
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = np.zeros(1, np.int32), np.full(1, n - 1, np.int32)
    for _ in range(least):
        sizes = hi - lo + 1
        ends = np.cumsum(sizes, dtype=np.int32)
        rows = np.arange(ends[-1], dtype=np.int32) + np.repeat(lo - (ends - sizes), sizes)
        # an interval of c w runs from the image of the first row with c to that of the last
        firsts = np.sort(back[rows[previous[rows] < np.repeat(lo, sizes)]])
        lasts = np.sort(back[rows[following[rows] > np.repeat(hi, sizes)]])
        new = ~known[lasts + 1]
        lo, hi = firsts[new], lasts[new]
        known[hi + 1] = True
        if not len(lo):
            break
    return known


def repeated_starts(strings: list[bytes], least: int) -> list[np.ndarray]:
    """For each string, the places where a substring of ``least`` bytes starts that also starts anywhere else in them."""
    if not strings:
        return []
    symbols, starts = joined(strings)
    order = suffix_order(symbols, least)
    known = short_prefixes(transform(symbols, order), least)
    group = np.cumsum(known[:-1])
    sizes = np.array([len(s) for s in strings], np.int64)
    whole = np.zeros(len(symbols), bool)  # places with ``least`` bytes of one string from there on
    for a, n in zip(starts.tolist(), sizes.tolist()):
        whole[a : a + max(0, n - least + 1)] = True
    inside = whole[order]
    several = np.bincount(group[inside], minlength=int(group[-1]) + 1) > 1
    hit = np.zeros(len(symbols), bool)
    hit[order] = inside & several[group]
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist())]
