"""Set operations and relations of many pairs at once, where all rings run along the axes.

The coordinates of a pair, snapped as in an arrangement, are the lines of a small grid; what lies in either shape are
masks over its cells. Relations are read off the masks as arrays. Pairs of alike masks have alike results: the rings are
traced once, between numbers of grid lines, and serve them all; they get the coordinates before snapping, whose errors
add up over many pairs. Relations of single segments and boxes are read off where the segment enters and leaves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np

from landgrid.kernel import batch, codecs
from landgrid.kernel.arrange import BITS, polygons_of, rings_where
from landgrid.kernel.model import of_polygons

MOST_LINES = 16  # of a pair's grid in either direction
CLEAR = 16  # steps of the snapping grid beyond which no tolerance of an arrangement reaches
WHOLE = 1 << 29  # of integer units up to which sums of areas fit 64 bits; snapping leaves them
HELD = 20_000  # patterns of results that a process remembers


def snapping_step(largest: np.ndarray) -> np.ndarray:
    """Of the grid that coordinates up to these are snapped to."""
    return np.ldexp(1.0, np.frexp(np.maximum(largest, 1e-300))[1] - BITS)


def _snapped(rings: list[np.ndarray], step: np.ndarray) -> list[np.ndarray]:
    return [np.rint(r / step[:, None, None]) * step[:, None, None] for r in rings]


def _along_axes(rings: list[np.ndarray]) -> np.ndarray:
    """Whether all edges run along an axis and rings are closed; those of four edges are boxes."""
    good = np.ones(len(rings[0]), bool)
    for r in rings:
        d = np.diff(r, axis=1) != 0
        if r.shape[1] == 5:
            good &= (d[:, 1:, 0] != d[:, :-1, 0]).all(axis=1)
        good &= (d[:, :, 0] != d[:, :, 1]).all(axis=1) & (r[:, 0] == r[:, -1]).all(axis=1)
    return good


def _lines(rings: list[np.ndarray], axis: int) -> list[np.ndarray]:
    return [np.stack([r[:, :, axis].min(axis=1), r[:, :, axis].max(axis=1)], axis=1) if r.shape[1] == 5 else r[:, :-1, axis] for r in rings]


def _mask(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the points at x (pair, column) and y (pair, row) lie in the region, by the even-odd rule."""
    inside = np.zeros((len(x), x.shape[1], y.shape[1]), bool)
    for r in rings:
        if r.shape[1] == 5:
            (a, b), (c, e) = ((r[:, :, k].min(axis=1)[:, None], r[:, :, k].max(axis=1)[:, None]) for k in (0, 1))
            inside ^= ((x > a) & (x < b))[:, :, None] & ((y > c) & (y < e))[:, None, :]
            continue
        for k in range(r.shape[1] - 1):
            low, high = np.minimum(r[:, k, 1], r[:, k + 1, 1])[:, None], np.maximum(r[:, k, 1], r[:, k + 1, 1])[:, None]
            inside ^= (x > r[:, k, :1])[:, :, None] & ((y > low) & (y < high) & (r[:, k, :1] == r[:, k + 1, :1]))[:, None, :]
    return inside


def boxes_of(raws: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of boxes along the axes, and their corners xmin, ymin, xmax, ymax."""
    for places, rings in batch.alike(raws):
        if len(rings) == 1 and rings[0][0] >= 0 and rings[0][1].shape[1] == 5:
            good = _along_axes([rings[0][1]])
            if good.any():
                yield places[good], batch.envelopes(rings[0][1][good])


def frames_of(raws: list[bytes | None], hollow: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of boxes along the axes in integer units, and their corners with those of their hole (empty at a corner where there is none).

    Boxes with a box cut out of their inside are among them if hollow.
    """
    for places, rings in batch.alike(raws):
        parts = [xy for _, xy in rings]
        if rings[0][0] or rings[-1][0] or len(parts) > 1 + hollow or any(r.shape[1] != 5 for r in parts):
            continue
        good = _along_axes(parts) & np.all([(np.abs(r) <= WHOLE).all(axis=(1, 2)) & (r == np.rint(r)).all(axis=(1, 2)) for r in parts], axis=0)
        box = batch.envelopes(parts[0])
        hole = batch.envelopes(parts[1]) if len(parts) > 1 else np.tile(box[:, :2], 2)
        if len(parts) > 1:
            good &= (hole[:, :2] > box[:, :2]).all(axis=1) & (hole[:, 2:] < box[:, 2:]).all(axis=1)
        if good.any():
            yield places[good], np.concatenate([box, hole], axis=1)[good].astype(np.int64)


class Alike:
    """Pairs of one layout: their places, grid lines and masks. Results have the coordinates as they were given."""

    def __init__(self, places: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]):
        self.places = places
        largest = np.max([np.abs(r).max(axis=(1, 2)) for r in (*a, *b)], axis=0)
        step = snapping_step(largest)
        self.a, self.b = _snapped(a, step), _snapped(b, step)
        snapped, given = ([np.concatenate(_lines(r, k), axis=1) for k in (0, 1)] for r in ([*self.a, *self.b], [*a, *b]))
        orders = [np.argsort(v, axis=1, kind="stable") for v in snapped]
        self.x, self.y = (np.take_along_axis(v, o, axis=1) for v, o in zip(snapped, orders))
        self.given_x, self.given_y = (np.take_along_axis(v, o, axis=1) for v, o in zip(given, orders))
        self.wide, self.high = (np.diff(v, axis=1) > 0 for v in (self.x, self.y))
        mid = [(v[:, 1:] + v[:, :-1]) / 2 for v in (self.x, self.y)]
        some = self.wide[:, :, None] & self.high[:, None, :]
        self.in_a, self.in_b = (_mask(r, *mid) & some for r in (self.a, self.b))

    def kinds(self) -> Iterator[tuple[bytes, np.ndarray]]:
        """Masks, and the numbers of the pairs that have them."""
        n = len(self.places)
        bits = np.packbits(np.concatenate([v.reshape(n, -1) for v in (self.wide, self.high, self.in_a, self.in_b)], axis=1), axis=1)
        _, kind = np.unique(np.ascontiguousarray(bits).view(f"V{bits.shape[1]}").ravel(), return_inverse=True)
        order = np.argsort(kind, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
            yield bits[own[0]].tobytes(), own

    def padded(self, mask: np.ndarray) -> np.ndarray:
        """The mask with the outside around it; cells without width take their neighbour's place."""
        out = np.zeros((len(mask), mask.shape[1] + 2, mask.shape[2] + 2), bool)
        out[:, 1:-1, 1:-1] = mask
        for i in range(mask.shape[1]):
            out[:, i + 1] = np.where(self.wide[:, i, None], out[:, i + 1], out[:, i])
        for j in range(mask.shape[2]):
            out[:, :, j + 1] = np.where(self.high[:, j, None], out[:, :, j + 1], out[:, :, j])
        return out

    def matrices(self) -> np.ndarray:
        """DE-9IM matrices as rows of nine bytes."""
        a, b = self.padded(self.in_a), self.padded(self.in_b)
        some = lambda m: m.any(axis=(1, 2))
        out = np.full((len(a), 9), ord("F"), np.uint8)
        for at, m in ((0, a & b), (2, a & ~b), (6, b & ~a)):
            out[some(m), at] = ord("2")
        out[:, 8] = ord("2")
        corner = lambda m: (m[:, :-1, :-1] != m[:, 1:, :-1]) | (m[:, :-1, :-1] != m[:, :-1, 1:]) | (m[:, :-1, :-1] != m[:, 1:, 1:])
        out[some(corner(a) & corner(b)), 4] = ord("0")
        for p, q, r, s in ((a[:, 1:], a[:, :-1], b[:, 1:], b[:, :-1]), (a[:, :, 1:], a[:, :, :-1], b[:, :, 1:], b[:, :, :-1])):
            rim_a, rim_b, in_a, in_b, of_a, of_b = p ^ q, r ^ s, p & q, r & s, p | q, r | s
            for at, m in ((1, in_a & rim_b), (3, rim_a & in_b), (4, rim_a & rim_b), (5, rim_a & ~of_b), (7, rim_b & ~of_a)):
                out[some(m), at] = ord("1")
        return out


class Crossed:
    """Lines of one segment and boxes along the axes, where no tolerance decides: their places.

    Ends lie on a side's line or well off it, and no corner is near the segment's line; other pairs are left out.
    """

    def __init__(self, places: np.ndarray, path: np.ndarray, ring: np.ndarray, box_first: bool):
        step = np.ldexp(1.0, np.frexp(np.maximum(np.maximum(np.abs(path).max(axis=(1, 2)), np.abs(ring).max(axis=(1, 2))), 1e-300))[1] - BITS)
        line, box = _snapped([path, ring], step)
        corners = batch.envelopes(box)
        off, far = line[:, :, None] - corners.reshape(-1, 1, 2, 2), CLEAR * step[:, None]
        d = line[:, 1] - line[:, 0]
        side = (box[:, :4, 0] - line[:, :1, 0]) * d[:, 1:] - (box[:, :4, 1] - line[:, :1, 1]) * d[:, :1]
        good = _along_axes([box]) & (corners[:, 2:] - corners[:, :2] > far).all(axis=1) & (np.abs(side) > far * np.hypot(d[:, 0], d[:, 1])[:, None]).all(axis=1)
        good &= ((off == 0) | (np.abs(off) > far[:, :, None, None])).all(axis=(1, 2, 3)) & np.isfinite(step)
        self.places, self.box_first = places[good], box_first
        self.line, self.corners = line[good], corners[good]

    def matrices(self) -> np.ndarray:
        """DE-9IM matrices as rows of nine bytes."""
        low, high, p = self.corners[:, None, :2], self.corners[:, None, 2:], self.line[:, :1]
        with np.errstate(divide="ignore"):
            at = np.concatenate([low - p, high - p], axis=1) / (self.line[:, 1:] - p)
        enter, leave = np.maximum(at.min(axis=1).max(axis=1), 0), np.minimum(at.max(axis=1).min(axis=1), 1)
        outside = ((self.line < low) | (self.line > high)).any(axis=2)
        inside = ((self.line > low) & (self.line < high)).all(axis=2)
        out = np.full((len(self.places), 9), ord("F"), np.uint8)
        out[:, 6], out[:, 7], out[:, 8] = ord("2"), ord("1"), ord("2")
        shares = enter < leave
        out[shares, 0] = ord("1")
        out[shares & ((enter > 0) | (leave < 1)), 1] = ord("0")
        out[outside.any(axis=1), 2] = ord("1")
        for k, ends in ((3, inside), (4, ~inside & ~outside), (5, outside)):
            out[ends.any(axis=1), k] = ord("0")
        return out[:, [0, 3, 6, 1, 4, 7, 2, 5, 8]] if self.box_first else out


class Pairs:
    """The pairs of two lists of WKB that can be treated together; the rest is left to the caller."""

    def __init__(self, a: list[bytes | None], b: list[bytes | None]):
        sizes: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, (p, q) in enumerate(zip(a, b)):
            if p is not None and q is not None:
                sizes[len(p), len(q)].append(i)
        self.groups: list[Alike] = []
        self.crossed: list[Crossed] = []
        for places in sizes.values():
            for at, left in batch.alike([a[i] for i in places]):
                for own, right in batch.alike([b[places[i]] for i in at.tolist()]):
                    one, two = [r[own] for _, r in left], [r for _, r in right]
                    box_first = right[0][0] < 0
                    if box_first != (left[0][0] < 0):
                        path, rings = (two[0], one) if box_first else (one[0], two)
                        if path.shape[1] == 2 and len(rings) == 1 and rings[0].shape[1] == 5:
                            self.crossed.append(Crossed(np.array(places)[at[own]], path, rings[0], box_first))
                        continue
                    if sum(min(r.shape[1] - 1, r.shape[1] if r.shape[1] != 5 else 2) for r in (*one, *two)) > MOST_LINES:
                        continue
                    good = _along_axes(one) & _along_axes(two)
                    box = [np.concatenate(s, axis=1) for s in (one, two)]
                    good &= (box[0].min(axis=1) <= box[1].max(axis=1)).all(axis=1) & (box[1].min(axis=1) <= box[0].max(axis=1)).all(axis=1)
                    if good.any():
                        chosen = np.array(places)[at[own]][good]
                        self.groups.append(Alike(chosen, [r[good] for r in one], [r[good] for r in two]))
        self._matrices: list[np.ndarray] | None = None

    def told(self, tell: Callable[[str], object], out: list, mixed: Callable[[str], object] | None = None) -> None:
        """Puts tell(DE-9IM matrix) in the pairs' places; mixed, where given, for a line and a polygon."""
        groups = [*self.groups, *self.crossed]
        if self._matrices is None:
            self._matrices = [np.ascontiguousarray(g.matrices()).view("S9").ravel() for g in groups]
        for g, matrices in zip(groups, self._matrices):
            f = mixed if mixed and isinstance(g, Crossed) else tell
            known = {m: f(m.decode()) for m in set(matrices.tolist())}
            for i, m in zip(g.places.tolist(), matrices.tolist()):
                out[i] = known[m]

    def made(self, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], out: list) -> None:
        """Puts the WKB of the polygons where keep(in a, in b) holds in the pairs' places."""
        for g in self.groups:
            for masks, kind in g.kinds():
                key = (keep, g.x.shape[1], g.y.shape[1], masks)
                if key not in _patterns:
                    if len(_patterns) > HELD:
                        _patterns.clear()
                    i = kind[0]
                    _patterns[key] = _pattern(keep(g.in_a[i], g.in_b[i]), g.wide[i], g.high[i])
                for i, raw in zip(g.places[kind].tolist(), _filled(*_patterns[key], g.given_x[kind], g.given_y[kind])):
                    out[i] = raw


class _Rims:
    """Edges around the cells of a mask, as an arrangement has them: between numbers of grid lines, with their sides."""

    def __init__(self, mask: np.ndarray):
        cells = np.pad(mask, 1)
        below, above, west, east = cells[1:-1, :-1], cells[1:-1, 1:], cells[:-1, 1:-1], cells[1:, 1:-1]
        flat, steep = np.argwhere(below != above), np.argwhere(west != east)
        self.xy = np.concatenate([np.concatenate([flat, flat + (1, 0)], axis=1), np.concatenate([steep, steep + (0, 1)], axis=1)]).astype(float)
        self.left = np.concatenate([above[below != above], west[west != east]])
        self.right = ~self.left


def _pattern(mask: np.ndarray, wide: np.ndarray, high: np.ndarray) -> tuple[bytes, list]:
    """A region's shape, and the place, column and row numbers of each ring's points; cells without width are passed over."""
    lines = [np.append(np.flatnonzero(v), [np.flatnonzero(v)[-1] + 1] if v.any() else []).astype(int) for v in (wide, high)]
    raw = codecs.to_wkb(of_polygons(polygons_of(rings_where(_Rims(mask[np.ix_(wide, high)]), lambda side: side))))
    found = []
    for _, at, n in batch.layout(raw) or ():
        xy = np.frombuffer(raw, "<f8", 2 * n, at).reshape(n, 2).astype(int)
        found.append((at, lines[0][xy[:, 0]], lines[1][xy[:, 1]]))
    return raw, found


def _filled(raw: bytes, rings: list, x: np.ndarray, y: np.ndarray) -> list[bytes]:
    """The shape of a pattern with the grid lines of each row."""
    out = np.tile(np.frombuffer(raw, np.uint8), (len(x), 1))
    for at, columns, rows in rings:
        xy = np.stack([x[:, columns], y[:, rows]], axis=2)
        out[:, at : at + 16 * len(columns)] = np.ascontiguousarray(xy).reshape(len(x), -1).view(np.uint8)
    whole, size = out.tobytes(), len(raw)
    return [whole[i : i + size] for i in range(0, len(whole), size)]


_patterns: dict[tuple, tuple[bytes, list]] = {}
_last: list = [None, None, None]


def pairs_of(a: list[bytes | None], b: list[bytes | None]) -> Pairs:
    """Pairs of two lists, kept until the next: several operations on a batch share its masks."""
    if _last[2] is None or _last[0] != a or _last[1] != b:
        _last[:] = [a, b, Pairs(a, b)]
    return _last[2]
