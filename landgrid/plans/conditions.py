"""Query conditions from request parameters, and job arguments."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, replace

from landgrid.functions.dimension import ADMINISTRATIVE, names_below

PARAMETERS = ("GEOWKT", "CATEGORYCODE", "KEYWORD", "REGIONCODE", "STATISTICONLY", "STARTINDEX", "LENGTH", "X", "Y", "GNCROWKEY")


def _padded(code: str, width: int) -> str:
    return code.strip()[:width].ljust(width, "0")


def code_list(text: str | None) -> tuple[str, ...]:
    """Codes between commas or tabs, without empty ones."""
    return tuple(c.strip() for c in re.split(r"[,\t]", text or "") if c.strip())


@dataclass(frozen=True)
class FeatureQuery:
    """A request. Equal requests are equal and hash alike, so that results can be kept by request."""

    kind: str  # spatial, property or keyword
    categories: tuple[str, ...] = ()
    region: str | None = None
    wkt: tuple[str, ...] = ()
    keyword: str | None = None
    statistics_only: bool = False
    start: int = 1
    length: int = 10

    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> "FeatureQuery | None":
        """Geometry given: spatial; else category and region without keyword: property; else category: keyword; else None."""
        given = {k.upper(): v for k, v in params.items() if k.upper() in PARAMETERS and v not in (None, "")}
        categories = tuple(_padded(c, 4) for c in code_list(given.get("CATEGORYCODE")))
        region = _padded(given["REGIONCODE"], 6) if "REGIONCODE" in given else None
        base = cls("spatial", categories, region, statistics_only=str(given.get("STATISTICONLY", "")).lower() == "true", start=max(1, int(given.get("STARTINDEX", 1))), length=int(given.get("LENGTH", 10)))
        if "GEOWKT" in given:
            return replace(base, wkt=tuple(p for p in re.split(r"[;\t]", given["GEOWKT"]) if p))
        if categories and region and "KEYWORD" not in given:
            return replace(base, kind="property")
        if categories:
            return replace(base, kind="keyword", keyword=given.get("KEYWORD") or " ".join(names_below(c) for c in categories))
        return None

    @property
    def identity(self) -> "FeatureQuery":
        """The request without its page."""
        return replace(self, start=1, length=10, statistics_only=False)


def unit_parameters(params: Mapping[str, str], unit_category: str, unit_properties: Mapping[str, str], unit_wkt: str | None) -> dict[str, str]:
    """Replaces GNCROWKEY: an administrative unit by its region code (property PAC), another unit by its geometry."""
    rest = {k: v for k, v in params.items() if k.upper() != "GNCROWKEY"}
    if unit_category in ADMINISTRATIVE:
        return rest | {"REGIONCODE": unit_properties["PAC"]}
    return rest | ({"GEOWKT": unit_wkt} if unit_wkt else {})


@dataclass(frozen=True)
class RangeSpec:
    """Where a batch job works: polygons, or a district of a level (1 province, 2 city, 3 county)."""

    kind: str  # polygon or district
    wkt: tuple[str, ...] = ()
    region: str = ""
    level: int = 0

    @classmethod
    def of_unit(cls, row_key: str, wkt: str) -> "RangeSpec":
        category = row_key[12:16]
        if category in ADMINISTRATIVE:
            return cls("district", (wkt,), row_key[:6], ADMINISTRATIVE[category])
        return cls("polygon", (wkt,))

    @classmethod
    def of_polygons(cls, wkt: list[str]) -> "RangeSpec":
        return cls("polygon", tuple(w for w in wkt if re.match(r"(?i)\s*(MULTI)?POLYGON", w)))


def region_filters(row_keys: list[str]) -> dict[int, set[str]]:
    """6-digit codes by district level, from the row keys of administrative units."""
    found: dict[int, set[str]] = {1: set(), 2: set(), 3: set()}
    for key in row_keys:
        if key[12:16] in ADMINISTRATIVE:
            found[ADMINISTRATIVE[key[12:16]]].add(key[:6])
    return found


def job_arguments(args: list[str]) -> tuple[str, dict[str, str]]:
    """The application id, and the following k=v[&k=v] with keys in small letters."""
    pairs = (part.split("=", 1) for arg in args[1:] for part in arg.split("&") if "=" in part)
    return (args[0] if args else ""), {k.lower(): v for k, v in pairs}


def surface_condition(params: Mapping[str, str]) -> tuple[str, tuple[str, ...], str | None]:
    """kind (property where a region is given, else spatial), categories and region or geometry."""
    given = {k.upper(): v for k, v in params.items()}
    categories = code_list(given.get("CATEGORYCODE"))
    if given.get("REGIONCODE"):
        return "property", categories, given["REGIONCODE"]
    return "spatial", categories, given.get("GEOWKT")
