"""Measures of many polygons at once: those of alike rings in two dimensions, read from their WKB as arrays."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np

ONE_RING = b"\x01\x03\x00\x00\x00\x01\x00\x00\x00"  # little-endian, polygon, one ring
POINT, LINE, POLYGON, MULTIPOLYGON = (b"\x01" + bytes([k, 0, 0, 0]) for k in (1, 2, 3, 6))
EMPTY = POLYGON + bytes(4)
HEAD = len(ONE_RING) + 4  # and the number of points
BOX = np.dtype([("head", f"S{len(ONE_RING)}"), ("n", "<u4"), ("xy", "<f8", (5, 2))])


def layout(raw: bytes) -> list[tuple[int, int, int]] | None:
    """Polygon, place and number of points of each ring of little-endian polygons in two dimensions; of a line, its path as one."""
    count = lambda at: int.from_bytes(raw[at : at + 4], "little")
    if raw[:5] == LINE:
        return [(-1, 9, count(5))] if count(5) and len(raw) == 9 + 16 * count(5) else None
    if raw[:5] not in (POLYGON, MULTIPOLYGON):
        return None
    found, at, several = [], 0, raw[:5] == MULTIPOLYGON
    members, at = (count(5), 9) if several else (1, 0)
    for k in range(members):
        if raw[at : at + 5] != POLYGON:
            return None
        rings, at = count(at + 5), at + 9
        for _ in range(rings):
            n, at = count(at), at + 4
            if not n or at + 16 * n > len(raw):
                return None
            found.append((k, at, n))
            at += 16 * n
    return found if found and at == len(raw) else None


def alike(raws: Sequence[bytes | None]) -> Iterator[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
    """Places of shapes of one layout, and their rings: polygon's number, points as an array (shape, point, axis)."""
    sizes: dict[int, list[int]] = defaultdict(list)
    for i, raw in enumerate(raws):
        if raw is not None and len(raw) > HEAD - 4:
            sizes[len(raw)].append(i)
    for size, of_size in sizes.items():
        rows, places = np.frombuffer(b"".join([raws[i] for i in of_size]), np.uint8).reshape(-1, size), np.array(of_size)
        while len(places):
            parts = layout(raws[places[0]])
            fixed = np.ones(size, bool)
            for _, at, n in parts or ():
                fixed[at : at + 16 * n] = False
            if parts is None:
                fixed[9:] = False  # those that begin alike are left out together
            same = (rows[:, fixed] == rows[0, fixed]).all(axis=1)
            if parts is not None:
                mine = rows if same.all() else rows[same]
                yield places[same], [(k, np.ascontiguousarray(mine[:, at : at + 16 * n]).view("<f8").reshape(-1, n, 2)) for k, at, n in parts]
            rows, places = rows[~same], places[~same]


def of_rings(measure, rings: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Area, length or envelope of shapes from those of their rings: holes take from the area."""
    each = [measure(xy) for _, xy in rings]
    if measure is envelopes:
        return np.concatenate([np.min([e[:, :2] for e in each], axis=0), np.max([e[:, 2:] for e in each], axis=0)], axis=1)
    if measure is lengths:
        return np.sum(each, axis=0)
    shells = [i == 0 or rings[i - 1][0] != k for i, (k, _) in enumerate(rings)]
    return np.sum([e if shell and k >= 0 else -e if k >= 0 else 0 * e for e, shell, (k, _) in zip(each, shells, rings)], axis=0)


def one_ring(raws: Sequence[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of polygons of one ring and as many points each, and their points as an array (polygon, point, axis)."""
    alike: dict[int, list[int]] = defaultdict(list)
    for i, raw in enumerate(raws):
        if raw is not None and len(raw) > HEAD and raw[: len(ONE_RING)] == ONE_RING and len(raw) == HEAD + 16 * int.from_bytes(raw[len(ONE_RING) : HEAD], "little"):
            alike[len(raw)].append(i)
    for size, places in alike.items():
        rows = np.frombuffer(b"".join(raws[i] for i in places), np.uint8).reshape(len(places), size)
        yield np.array(places), np.ascontiguousarray(rows[:, HEAD:]).view("<f8").reshape(len(places), -1, 2)


def areas(xy: np.ndarray) -> np.ndarray:
    d = xy - xy[:, :1]
    return np.abs((d[:, :-1, 0] * d[:, 1:, 1] - d[:, 1:, 0] * d[:, :-1, 1]).sum(axis=1)) / 2


def lengths(xy: np.ndarray) -> np.ndarray:
    d = np.diff(xy, axis=1)
    return np.hypot(d[:, :, 0], d[:, :, 1]).sum(axis=1)


def envelopes(xy: np.ndarray) -> np.ndarray:
    return np.concatenate([xy.min(axis=1), xy.max(axis=1)], axis=1)


def clear_of(raws: Sequence[bytes | None], corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which polygons lie in their boxes (xmin, ymin, xmax, ymax), and which outside them, by their envelopes."""
    held, apart = np.zeros(len(raws), bool), np.zeros(len(raws), bool)
    for places, rings in alike(raws):
        if rings[0][0] >= 0:
            of, box = of_rings(envelopes, rings), corners[places]
            held[places] = (of[:, :2] >= box[:, :2]).all(axis=1) & (of[:, 2:] <= box[:, 2:]).all(axis=1)
            apart[places] = (of[:, :2] > box[:, 2:]).any(axis=1) | (of[:, 2:] < box[:, :2]).any(axis=1)
    return held, apart


def boxes(xmin, ymin, xmax, ymax) -> list[bytes]:
    """The WKB of envelopes, as polygons that run counter-clockwise from the lower left."""
    a, b, c, d = (np.asarray(v, np.float64) for v in (xmin, ymin, xmax, ymax))
    out = np.zeros(len(a), BOX)
    out["head"], out["n"] = ONE_RING, 5
    out["xy"][:, :, 0], out["xy"][:, :, 1] = np.stack([a, c, c, a, a], axis=1), np.stack([b, b, d, d, b], axis=1)
    raw, size = out.tobytes(), BOX.itemsize
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def polygons(xy: np.ndarray) -> list[bytes]:
    """The WKB of polygons of one ring each, of as many points."""
    out = np.zeros(len(xy), np.dtype([("head", f"S{len(ONE_RING)}"), ("n", "<u4"), ("xy", "<f8", xy.shape[1:])]))
    out["head"], out["n"], out["xy"] = ONE_RING, xy.shape[1], xy
    raw, size = out.tobytes(), out.dtype.itemsize
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def points(xy: np.ndarray) -> list[bytes]:
    """The WKB of points."""
    out = np.zeros(len(xy), np.dtype([("head", f"S{len(POINT)}"), ("xy", "<f8", 2)]))
    out["head"], out["xy"] = POINT, xy
    raw, size = out.tobytes(), out.dtype.itemsize
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def paths(xy: np.ndarray) -> list[bytes]:
    """The WKB of lines of as many points."""
    out = np.zeros(len(xy), np.dtype([("head", f"S{len(LINE)}"), ("n", "<u4"), ("xy", "<f8", xy.shape[1:])]))
    out["head"], out["n"], out["xy"] = LINE, xy.shape[1], xy
    raw, size = out.tobytes(), out.dtype.itemsize
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def filled(raw: bytes, rings: list[np.ndarray]) -> list[bytes]:
    """The WKB of shapes of the layout of one, with the rings of each."""
    out = np.tile(np.frombuffer(raw, np.uint8), (len(rings[0]), 1))
    for (_, at, n), xy in zip(layout(raw), rings):
        out[:, at : at + 16 * n] = np.ascontiguousarray(xy, "<f8").reshape(len(out), -1).view(np.uint8)
    whole, size = out.tobytes(), len(raw)
    return [whole[i : i + size] for i in range(0, len(whole), size)]


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_COORD = rf"\s*{_NUMBER}\s+{_NUMBER}\s*"
_RING = rf"\s*\({_COORD}(?:,{_COORD})*\)\s*"
_RINGS = rf"\s*\({_RING}(?:,{_RING})*\)\s*"
_POLYGONS = re.compile(rf"\s*(?:POLYGON{_RINGS}|MULTIPOLYGON\s*\({_RINGS}(?:,{_RINGS})*\)\s*)", re.IGNORECASE | re.ASCII)
_SIGNS, _BUT_SIGNS = str.maketrans("(),", "   "), re.compile(r"[^(),]+")


def of_texts(texts: Sequence[str | None], made) -> list[bytes | None]:
    """The WKB of WKT of polygons in two dimensions whose rings are closed, made(text) giving it for one; others are none."""
    alike: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, text in enumerate(texts):
        if text is not None and _POLYGONS.fullmatch(text):
            alike[text.lstrip()[0].upper(), _BUT_SIGNS.sub("", text)].append(i)
    out: list[bytes | None] = [None] * len(texts)
    for places in alike.values():
        raw = made(texts[places[0]])
        parts = layout(raw)
        words = [w for i in places for w in texts[i].translate(_SIGNS).split()[1:]]
        if parts is None or len(words) != 2 * len(places) * sum(n for _, _, n in parts):
            continue  # a ring that the text leaves open
        xy = np.array(list(map(float, words))).reshape(len(places), -1, 2)
        rings = np.split(xy, np.cumsum([n for _, _, n in parts])[:-1], axis=1)
        closed = np.all([(r[:, 0] == r[:, -1]).all(axis=1) for r in rings], axis=0)
        if closed.any():
            for i, made_one in zip(np.array(places)[closed].tolist(), filled(raw, [r[closed] for r in rings])):
                out[i] = made_one
    return out


def buffered(corners: np.ndarray, d: np.ndarray, vertices: int) -> list[bytes]:
    """Boxes widened by d, their corners round with vertices (a multiple of 4) in a full circle; narrower by -d below 0."""
    angle = 2 * np.pi * np.arange(vertices // 4 + 1) / vertices
    parts = []
    for quarter, (cx, cy) in enumerate(((2, 1), (2, 3), (0, 3), (0, 1))):
        at = angle + (quarter - 1) * np.pi / 2
        parts.append(np.stack([corners[:, cx, None] + d[:, None] * np.cos(at), corners[:, cy, None] + d[:, None] * np.sin(at)], axis=2))
    wide = polygons(np.concatenate([*parts, parts[0][:, :1]], axis=1))
    a, b, c, e = corners[:, 0] - d, corners[:, 1] - d, corners[:, 2] + d, corners[:, 3] + d
    narrow = boxes(a, b, c, e)
    return [w if r > 0 else n if left else EMPTY for w, n, r, left in zip(wide, narrow, d.tolist(), ((c > a) & (e > b)).tolist())]


def tiles(corners: np.ndarray, size: float) -> list[list[bytes]]:
    """Boxes cut by squares counted from their lower left corner, column by column."""
    n = np.maximum(1, np.ceil((corners[:, 2:] - corners[:, :2]) / size - 1e-12)).astype(int)
    count = n[:, 0] * n[:, 1]
    last = np.cumsum(count)
    own = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(own)) - np.repeat(last - count, count)
    at = np.stack([nth // n[own, 1], nth % n[own, 1]], axis=1)
    low = corners[own, :2] + at * size
    high = np.minimum(corners[own, :2] + (at + 1) * size, corners[own, 2:])
    made = boxes(low[:, 0], low[:, 1], high[:, 0], high[:, 1])
    return [made[e - k : e] for e, k in zip(last.tolist(), count.tolist())]
