"""Covers of a query area by quad cells, as key ranges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from landgrid.functions.grid import END_LEVEL, LEVEL_BIT

Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class KeyRange:
    low: int
    high: int
    inside: bool  # all that is indexed there lies in the area


def z_value(level: int, row: int, col: int) -> int:
    key = level << LEVEL_BIT
    for bit in range(LEVEL_BIT // 2):
        key |= (row >> bit & 1) << 2 * bit | (col >> bit & 1) << 2 * bit + 1
    return key


def cell_box(level: int, row: int, col: int) -> Box:
    size = 360 / 2**level
    return size * col, 180 - size * (row + 1), size * (col + 1), 180 - size * row


def cover(area: Box, contains: Callable[[Box], bool] | None = None, disjoint: Callable[[Box], bool] | None = None, last: int = END_LEVEL, split_to: int = 10) -> list[KeyRange]:
    """Key ranges of the cells that may hold features of an area, from the one cell of level 1.

    contains, disjoint: exact tests of a cell's box against the area where it is no rectangle. Cells inside give one
    range of all descendants for each level; boundary cells one key each, down to ``split_to``, below which a boundary
    cell gives the range of its descendants, to be refined.
    """
    x0, y0, x1, y1 = area
    contains = contains or (lambda b: x0 <= b[0] and y0 <= b[1] and x1 >= b[2] and y1 >= b[3])
    found: list[KeyRange] = []

    def below(level: int, row: int, col: int, first: int, inside: bool) -> None:
        for k in range(first, last - level + 1):
            n = 1 << k
            found.append(KeyRange(z_value(level + k, n * row, n * col), z_value(level + k, n * row + n - 1, n * col + n - 1), inside))

    todo = [(1, 0, 0)]
    while todo:
        level, row, col = todo.pop()
        b = cell_box(level, row, col)
        if b[0] > x1 or b[2] < x0 or b[1] > y1 or b[3] < y0 or (disjoint and disjoint(b)):
            continue
        if x0 <= b[0] and y0 <= b[1] and x1 >= b[2] and y1 >= b[3] and contains(b):
            below(level, row, col, 0, True)
        elif level >= split_to:
            below(level, row, col, 0, False)
        else:
            key = z_value(level, row, col)
            found.append(KeyRange(key, key, False))
            todo += [(level + 1, 2 * row + r, 2 * col + c) for r in (0, 1) for c in (0, 1)]
    return merged(found)


def merged(ranges: list[KeyRange]) -> list[KeyRange]:
    """Adjacent ranges of the same kind as one."""
    out: list[KeyRange] = []
    for r in sorted(ranges, key=lambda r: (r.inside, r.low)):
        if out and out[-1].inside == r.inside and r.low <= out[-1].high + 1:
            out[-1] = KeyRange(out[-1].low, max(out[-1].high, r.high), r.inside)
        else:
            out.append(r)
    return out


def coarse(ranges: list[KeyRange], at_most: int = 8) -> list[tuple[int, int]]:
    """At most so many ranges over all of the given, joined over the smallest gaps."""
    spans = [(r.low, r.high) for r in merged([KeyRange(r.low, r.high, False) for r in ranges])]
    gaps = sorted(range(1, len(spans)), key=lambda i: spans[i - 1][1] - spans[i][0])
    cuts = [0, *sorted(gaps[: at_most - 1]), len(spans)] if spans else [0]
    return [(spans[a][0], spans[b - 1][1]) for a, b in zip(cuts, cuts[1:])]


def may_hold(key: Column, ranges: list[KeyRange]) -> Column:
    """A few comparisons for the scan; exact membership is in ``kind_of``."""
    test = F.lit(False)
    for low, high in coarse(ranges):
        test = test | key.between(low, high)
    return test


def kind_of(key: Column, ranges: list[KeyRange]) -> Column:
    """2 where the key is in a range inside the area, 1 where it is in a boundary range, 0 elsewhere."""
    if not ranges:
        return F.lit(0)
    table = F.array(*(F.struct(F.lit(r.low).alias("low"), F.lit(r.high).alias("high"), F.lit(2 if r.inside else 1).alias("kind")) for r in ranges))
    hit = F.filter(table, lambda r: key.between(r["low"], r["high"]))
    return F.coalesce(F.array_max(F.transform(hit, lambda r: r["kind"])), F.lit(0))
