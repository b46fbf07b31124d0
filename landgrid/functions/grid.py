"""Quad grid with Z-order keys, fixed-degree grid and rasters, as Column functions.

The quad grid of level L has cells of 360 / 2^L degrees, counted from x = 0 and y = 180; a key holds the level in the
bits from 58 on, the row in the even and the column in the odd bits below. The index covers x and y from 0 to 180.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_LEVEL, END_LEVEL = 1, 14
LEVEL_BIT = 58
EVEN = 0x5555555555555555


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def _long(c) -> Column:
    return _col(c).cast("bigint")


def _spread(v: Column) -> Column:
    """Bits to every other place: the binary digits read to the base of 4. One use of v, so that plans stay small."""
    return F.conv(F.bin(v), 4, 10).cast("bigint")


def _gather(v: Column) -> Column:
    return F.conv(F.conv(v.bitwiseAND(F.lit(EVEN)).cast("string"), 10, 4), 2, 10).cast("bigint")


def z_encode(level, row, col) -> Column:
    key = _spread(_long(row)).bitwiseOR(F.shiftleft(_spread(_long(col)), 1))
    if isinstance(level, int):
        return key.bitwiseOR(F.lit(level << LEVEL_BIT))
    return key.bitwiseOR(_long(level) * F.lit(1 << LEVEL_BIT))


def z_level(key) -> Column:
    return F.shiftrightunsigned(_long(key), LEVEL_BIT).cast("int")


def _place(key) -> Column:
    return _long(key).bitwiseAND(F.lit((1 << LEVEL_BIT) - 1))


def z_row(key) -> Column:
    return _gather(_place(key))


def z_col(key) -> Column:
    return _gather(F.shiftrightunsigned(_place(key), 1))


def cell_size(level) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), _col(level))


def column_of(x, size) -> Column:
    return (_col(x) / _col(size)).cast("bigint")


def row_of(y, size) -> Column:
    return ((F.lit(180.0) - _col(y)) / _col(size)).cast("bigint")


def point_cell(x, y, level) -> Column:
    size = cell_size(level)
    return z_encode(level, row_of(y, size), column_of(x, size))


def point_cells(x, y, first: int = FIRST_LEVEL, last: int = END_LEVEL) -> Column:
    """The keys of the cells that hold a point, from the coarsest."""
    return F.array(*(point_cell(x, y, k) for k in range(first, last + 1)))


def cell_envelope(row, col, size) -> Column:
    size = _col(size)
    return F.struct((size * _long(col)).alias("xmin"), (F.lit(180.0) - size * (_long(row) + 1)).alias("ymin"), (size * (_long(col) + 1)).alias("xmax"), (F.lit(180.0) - size * _long(row)).alias("ymax"))


def children(level, row, col) -> Column:
    """Keys of the four cells of the next level."""
    return F.array(*(z_encode(_long(level) + 1, 2 * _long(row) + r, 2 * _long(col) + c) for r, c in ((0, 0), (1, 0), (0, 1), (1, 1))))


def descendant_range(level, row, col, down: int) -> Column:
    """Least and greatest key among a cell's descendants so many levels below."""
    n = 1 << down
    deep = _long(level) + down
    return F.struct(z_encode(deep, n * _long(row), n * _long(col)).alias("zmin"), z_encode(deep, n * _long(row) + (n - 1), n * _long(col) + (n - 1)).alias("zmax"))


def optimal_cell(xmin, ymin, xmax, ymax, first: int = FIRST_LEVEL, last: int = END_LEVEL) -> Column:
    """The key of the smallest cell that holds an envelope; -1 where the first level already takes several."""

    def single(k: Column) -> Column:
        size = cell_size(k)
        return (column_of(xmin, size) == column_of(xmax, size)) & (row_of(ymin, size) == row_of(ymax, size))

    def key(level: Column) -> Column:
        size = cell_size(level)
        return F.when(level < first, F.lit(-1).cast("bigint")).otherwise(z_encode(level, row_of(ymax, size), column_of(xmin, size)))

    # lambdas name what is used again, so that the expression stays small where filters on the key repeat it
    failing = F.array_position(F.transform(F.sequence(F.lit(first), F.lit(last)), single), False)
    level = F.coalesce(F.nullif(failing, F.lit(0)), F.lit(last - first + 2)) + (first - 2)
    return F.get(F.transform(F.array(level), key), 0)


def envelope_cells(xmin, ymin, xmax, ymax, size) -> Column:
    """The cells (row, col) that an envelope meets, as an array to explode."""
    size = _col(size)
    rows = F.sequence(row_of(ymax, size), row_of(ymin, size))
    cols = F.sequence(column_of(xmin, size), column_of(xmax, size))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("row"), c.alias("col")))))


def world_to_pixel(transform: Column, x, y) -> tuple[Column, Column]:
    """Row and column of a point under an affine transform of 6 coefficients, truncated."""
    t = [transform[i] for i in range(6)]
    det = t[1] * t[5] - t[2] * t[4]
    dx, dy = _col(x) - t[0], _col(y) - t[3]
    return ((t[1] * dy - t[4] * dx) / det).cast("int"), ((t[5] * dx - t[2] * dy) / det).cast("int")


def pixel_to_world(transform: Column, row, col) -> tuple[Column, Column]:
    t = [transform[i] for i in range(6)]
    row, col = _col(row), _col(col)
    return t[0] + col * t[1] + row * t[2], t[3] + col * t[4] + row * t[5]
