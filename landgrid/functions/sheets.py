"""National map sheets: codes such as J50E001011 (4-degree row letter, 6-degree zone, scale letter, row, column)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scale:
    letter: str
    denominator: int
    rows: int  # sheets in a 4-degree row
    cols: int

    @property
    def height(self) -> float:
        return 4 / self.rows

    @property
    def width(self) -> float:
        return 6 / self.cols


#: The divisions of a sheet of 1 : 1 million.
SCALES = {s.letter: s for s in (Scale("A", 1_000_000, 1, 1), Scale("B", 500_000, 2, 2), Scale("C", 250_000, 4, 4), Scale("D", 100_000, 12, 12), Scale("E", 50_000, 24, 24), Scale("F", 25_000, 48, 48), Scale("G", 10_000, 96, 96), Scale("H", 5_000, 192, 192))}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def scale_of(letter: str) -> Scale:
    return SCALES[letter]


def _code(scale: Scale, a: Column, b: Column, c: Column, d: Column) -> Column:
    text = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(F.chr(a + 64), text(b, 2), F.lit(scale.letter), text(c, 3), text(d, 3))


def global_row(lat, scale: Scale) -> Column:
    """Rows of a scale counted northward from the equator."""
    return F.floor(_col(lat) * F.lit(scale.rows) / 4).cast("bigint")


def global_col(lon, scale: Scale) -> Column:
    """Columns of a scale counted eastward from the prime meridian."""
    return F.floor(_col(lon) * F.lit(scale.cols) / 6).cast("bigint")


def code_of(row: Column, col: Column, scale: Scale) -> Column:
    """The code of a sheet by its global row and column."""
    a, b = F.floor(row / scale.rows).cast("int") + 1, F.floor(col / scale.cols).cast("int") + 31
    return _code(scale, a, b, (F.lit(scale.rows) - row % scale.rows).cast("int"), (col % scale.cols + 1).cast("int"))


def sheet_code(lat, lon, scale: Scale) -> Column:
    """The sheet that holds a point of the north-eastern quadrant."""
    return code_of(global_row(lat, scale), global_col(lon, scale), scale)


def _parts(code) -> tuple[Column, ...]:
    c = _col(code)
    return F.ascii(c) - 64, F.substring(c, 2, 2).cast("int"), F.substring(c, 5, 3).cast("int"), F.substring(c, 8, 3).cast("int")


def _by_letter(code, value) -> Column:
    letter = F.substring(_col(code), 4, 1)
    cases = None
    for key, scale in SCALES.items():
        cases = F.when(letter == key, F.lit(value(scale))) if cases is None else cases.when(letter == key, F.lit(value(scale)))
    return cases


def sheet_scale(code) -> Column:
    return _by_letter(code, lambda s: s.denominator)


def sheet_envelope(code) -> Column:
    """xmin, ymin, xmax, ymax in degrees."""
    a, b, c, d = _parts(code)
    height, width, rows = (_by_letter(code, f) for f in (lambda s: s.height, lambda s: s.width, lambda s: s.rows))
    south, west = (a - 1) * 4 + (rows - c) * height, (b - 31) * 6 + (d - 1) * width
    return F.struct(west.alias("xmin"), south.alias("ymin"), (west + width).alias("xmax"), (south + height).alias("ymax"))


def sheets_in_range(xmin, ymin, xmax, ymax, scale: Scale) -> Column:
    """The codes of all sheets that an envelope meets, across the lines of the larger sheets too."""
    rows = F.sequence(global_row(ymin, scale), global_row(ymax, scale))
    cols = F.sequence(global_col(xmin, scale), global_col(xmax, scale))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: code_of(r, c, scale))))


def sub_sheets(code, scale: Scale) -> Column:
    """The codes of the larger-scale sheets in a sheet, from the south-west."""
    box, eps = sheet_envelope(code), scale.height / 100
    return sheets_in_range(box["xmin"] + eps, box["ymin"] + eps, box["xmax"] - eps, box["ymax"] - eps, scale)


def super_sheet(code, scale: Scale) -> Column:
    """The smaller-scale sheet that holds a sheet."""
    box = sheet_envelope(code)
    return sheet_code((box["ymin"] + box["ymax"]) / 2, (box["xmin"] + box["xmax"]) / 2, scale)


def sheet_zone(code) -> Column:
    """The central meridian of a sheet's 6-degree zone."""
    return (F.substring(_col(code), 2, 2).cast("int") - 31) * 6 + 3


def central_meridian(lon) -> Column:
    """The central meridian of the 6-degree zone of a longitude."""
    return ((_col(lon) + 6) / 6).cast("int") * 6 - 3
