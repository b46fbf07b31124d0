"""Land-cover category codes (4 digits), region codes (6 or 12 digits) and row keys, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGION, CATEGORY, FID = 12, 4, 8  # widths in a row key
UNCLASSIFIED, UNNAMED = "9999", "未命名"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_right(c: Column | str, width: int, fill: str = "0") -> Column:
    """Fills up on the right; unlike rpad it never cuts."""
    c = _col(c)
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, fill))


def pad_left(c: Column | str, width: int, fill: str = "0") -> Column:
    c = _col(c)
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, fill))


def trim_right(c: Column | str, fill: str = "0") -> Column:
    return F.rtrim(_col(c), F.lit(fill))


def row_key(region: Column | str, category: Column | str, fid: Column | str) -> Column:
    return F.concat(pad_right(region, REGION), pad_right(category, CATEGORY), pad_left(fid, FID))


def key_region(key: Column | str) -> Column:
    return F.substring(_col(key), 1, REGION)


def key_category(key: Column | str) -> Column:
    return F.substring(_col(key), REGION + 1, CATEGORY)


def key_fid(key: Column | str) -> Column:
    return F.substring(_col(key), REGION + CATEGORY + 1, FID)


def standard_category(c: Column | str) -> Column:
    return F.rpad(F.substring(_col(c), 1, CATEGORY), CATEGORY, "0")


def category_level(c: Column | str) -> Column:
    """0 for the top 0000, 1 to 3 below it, -1 for what isn't a code of 4 digits."""
    c = _col(c)
    return F.when(F.length(c) != 4, -1).when(c == "0000", 0).when(c.endswith("00"), 1).when(c.endswith("0"), 2).otherwise(3)


def category_short(c: Column | str) -> Column:
    """The prefix that all codes of a category share; empty for the top."""
    c = _col(c)
    level = category_level(c)
    return F.when(level == 0, "").when(level == 1, F.substring(c, 1, 2)).when(level == 2, F.substring(c, 1, 3)).otherwise(c)


def category_parent(c: Column | str) -> Column:
    """The code one level up; the top's parent is the top. Codes such as 1001, whose second level is empty, lead to 1000."""
    c = _col(c)
    level = category_level(c)
    return F.when(level == 3, F.concat(F.substring(c, 1, 3), F.lit("0"))).when(level == 2, F.concat(F.substring(c, 1, 2), F.lit("00"))).otherwise("0000")


def category_at(c: Column | str, level: int) -> Column:
    """The code's ancestor of a level, or the code itself where it is of that level or above."""
    c = _col(c)
    return c if level >= 3 else F.rpad(F.substring(c, 1, level + 1 if level else 0), 4, "0")


def category_ancestors(c: Column | str, top: int = 1) -> Column:
    """The code and its ancestors of level ``top`` or below, each once; never 0000. Null where the code is above top."""
    c = _col(c)
    levels = [category_at(c, k) for k in range(max(top, 1), 4)]
    found = F.array_distinct(F.array(*levels))
    own = F.filter(found, lambda x: (category_level(x) >= max(top, 1)) & (x != "0000"))
    return F.when(category_level(c) >= max(top, 1), own)


def category_upper(c: Column | str) -> Column:
    """The first code after those of a category, for key ranges."""
    short = category_short(c)
    nxt = F.lpad((short.cast("int") + 1).cast("string"), 4, "0")
    return F.when(category_level(c) == 0, "9999").otherwise(F.rpad(F.substring(nxt, F.lit(5) - F.length(short), F.length(short)), 4, "0"))


def category_contains(outer: Column | str, inner: Column | str) -> Column:
    return _col(inner).startswith(category_short(outer))


def standard_region(c: Column | str, width: int = 6) -> Column:
    return F.rpad(F.substring(_col(c), 1, width), width, "0")


def region_level(c: Column | str) -> Column:
    """1 province, 2 city, 3 county, by the standard code of 6 digits."""
    n = F.length(trim_right(standard_region(c)))
    return F.when(n <= 2, 1).when(n <= 4, 2).otherwise(3)


def region_short(c: Column | str) -> Column:
    """The prefix that all codes of a region share: 2, 4 or 6 digits."""
    return F.substring(standard_region(c), F.lit(1), 2 * region_level(c))


def region_parent(c: Column | str) -> Column:
    level = region_level(c)
    return F.when(level == 3, F.rpad(F.substring(_col(c), 1, 4), 6, "0")).when(level == 2, F.rpad(F.substring(_col(c), 1, 2), 6, "0")).otherwise("000000")


def region_upper(c: Column | str) -> Column:
    """The first code of 6 digits after those of a region."""
    short = region_short(c)
    return F.rpad(F.lpad((short.cast("bigint") + 1).cast("string"), F.length(short), F.lit("0")), F.lit(6), F.lit("0"))


def region_contains(outer: Column | str, inner: Column | str) -> Column:
    return _col(inner).startswith(region_short(outer))


def district_of(region: Column | str, level: int) -> Column:
    """The 6-digit code of a region's district of a level."""
    return F.rpad(F.substring(_col(region), 1, 2 * level), 6, "0")
