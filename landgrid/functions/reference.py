"""Spatial references: coordinate tolerances by number, and renumbered references."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_WKID = 4490
DEFAULT_TOLERANCE = 1e-10
#: Tolerances of references in degrees that the jobs use. Larger tables are given as a parameter.
TOLERANCES = {4326: 1e-8, 4490: 1e-8}


def tolerance_of(wkid: int | None, table: Mapping[int, float] = TOLERANCES) -> float:
    return table.get(wkid or 0, DEFAULT_TOLERANCE)


def tolerance(wkid, table: Mapping[int, float] = TOLERANCES) -> Column:
    """The tolerance of a column of reference numbers; the default for those that the table hasn't."""
    found = F.create_map(*(F.lit(v) for pair in sorted(table.items()) for v in pair))
    return F.coalesce(F.try_element_at(found, F.col(wkid) if isinstance(wkid, str) else wkid), F.lit(DEFAULT_TOLERANCE))


def current_wkid(wkid, renumbered: Mapping[int, int]) -> Column:
    """The number in use now, by a table of old and new numbers."""
    column = F.col(wkid) if isinstance(wkid, str) else wkid
    if not renumbered:
        return column
    found = F.create_map(*(F.lit(v) for pair in sorted(renumbered.items()) for v in pair))
    return F.coalesce(F.try_element_at(found, column), column)
