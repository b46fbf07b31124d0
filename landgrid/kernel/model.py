"""The geometry model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

Coord = tuple[float, ...]  # x, y, then z and m where the geometry has them

KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
DIMENSION = {"Point": 0, "MultiPoint": 0, "LineString": 1, "MultiLineString": 1, "Polygon": 2, "MultiPolygon": 2}


@dataclass(frozen=True)
class Geometry:
    """kind, and data by kind: a coordinate (None if empty), a list of them, of lines, of polygons (lists of rings) or geometries."""

    kind: str
    data: object
    z: bool = False
    m: bool = False
    srid: int = 0

    @property
    def empty(self) -> bool:
        if self.kind == "GeometryCollection":
            return all(g.empty for g in self.data)
        return not self.data or not any(True for _ in self.coords())

    @property
    def dimension(self) -> int:
        if self.kind == "GeometryCollection":
            return max((g.dimension for g in self.data), default=0)
        return DIMENSION[self.kind]

    def points(self) -> list[Coord]:
        return ([self.data] if self.data else []) if self.kind == "Point" else list(self.data) if self.kind == "MultiPoint" else []

    def lines(self) -> list[list[Coord]]:
        """Paths of a line, rings of a polygon."""
        if self.kind == "LineString":
            return [self.data] if self.data else []
        if self.kind == "MultiLineString":
            return [x for x in self.data if x]
        return [r for p in self.polygons() for r in p]

    def polygons(self) -> list[list[list[Coord]]]:
        if self.kind == "Polygon":
            return [self.data] if self.data else []
        return [p for p in self.data if p] if self.kind == "MultiPolygon" else []

    def members(self) -> list["Geometry"]:
        """The simple geometries that a multi geometry or collection consists of."""
        if self.kind == "GeometryCollection":
            return list(self.data)
        if self.kind.startswith("Multi"):
            return [replace(self, kind=self.kind[5:], data=x) for x in self.data]
        return [self]

    def coords(self) -> Iterator[Coord]:
        if self.kind == "GeometryCollection":
            for g in self.data:
                yield from g.coords()
        elif self.dimension == 0:
            yield from self.points()
        else:
            for line in self.lines():
                yield from line

    def envelope(self) -> tuple[float, float, float, float] | None:
        xy = [(c[0], c[1]) for c in self.coords()]
        if not xy:
            return None
        xs, ys = zip(*xy)
        return min(xs), min(ys), max(xs), max(ys)

    def interval(self, which: str) -> tuple[float, float] | None:
        """Least and greatest x, y, z or m."""
        at = {"x": 0, "y": 1, "z": 2, "m": 3 if self.z else 2}[which]
        if (which == "z" and not self.z) or (which == "m" and not self.m):
            return None
        values = [c[at] for c in self.coords()]
        return (min(values), max(values)) if values else None

    def map(self, f) -> "Geometry":
        """f on each coordinate."""
        if self.kind == "GeometryCollection":
            return replace(self, data=[g.map(f) for g in self.data])
        if self.kind == "Point":
            return replace(self, data=f(self.data) if self.data else None)
        deep = lambda x: f(x) if isinstance(x, tuple) else [deep(y) for y in x]
        return replace(self, data=deep(self.data))

    def flat(self) -> "Geometry":
        """x and y only."""
        if self.kind == "GeometryCollection":
            return replace(self, data=[g.flat() for g in self.data], z=False, m=False)
        return replace(self.map(lambda c: c[:2]), z=False, m=False) if self.z or self.m else self


def point(x: float, y: float) -> Geometry:
    return Geometry("Point", (float(x), float(y)))


def line(coords) -> Geometry:
    return Geometry("LineString", [tuple(map(float, c)) for c in coords])


def polygon(*rings) -> Geometry:
    return Geometry("Polygon", [closed([tuple(map(float, c)) for c in r]) for r in rings])


def box(xmin: float, ymin: float, xmax: float, ymax: float) -> Geometry:
    return polygon([(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)])


def closed(ring: list[Coord]) -> list[Coord]:
    return ring if not ring or ring[0] == ring[-1] else [*ring, ring[0]]


def of_points(points: list[Coord]) -> Geometry:
    return Geometry("Point", points[0]) if len(points) == 1 else Geometry("MultiPoint", points)


def of_lines(lines: list[list[Coord]]) -> Geometry:
    return Geometry("LineString", lines[0]) if len(lines) == 1 else Geometry("MultiLineString", lines)


def of_polygons(polygons: list[list[list[Coord]]]) -> Geometry:
    """A polygon, or several; none gives the empty polygon."""
    return Geometry("Polygon", polygons[0] if polygons else []) if len(polygons) <= 1 else Geometry("MultiPolygon", polygons)


def collected(parts: list[Geometry]) -> Geometry:
    parts = [p for p in parts if not p.empty]
    return parts[0] if len(parts) == 1 else Geometry("GeometryCollection", parts)


def signed_area(ring: list[Coord]) -> float:
    """Positive for counter-clockwise rings."""
    if not ring:
        return 0.0
    x0, y0 = ring[0][:2]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:])) / 2


def regrouped(rings: list[list[Coord]]) -> list[list[list[Coord]]]:
    """Polygons from rings in any order and direction: a ring inside an odd number of others is a hole of the smallest around it."""
    rings = [closed(r) for r in rings if len(r) >= 3]
    order = sorted(range(len(rings)), key=lambda i: -abs(signed_area(rings[i])))
    depth, around, polygons, shell_at = {}, {}, [], {}
    for k, i in enumerate(order):
        holders = [j for j in order[:k] if _holds(rings[j], rings[i])]
        depth[i] = len(holders)
        around[i] = holders[-1] if holders else None
        if depth[i] % 2 == 0:
            shell_at[i] = len(polygons)
            polygons.append([directed(rings[i], True)])
        else:
            polygons[shell_at[around[i]] if around[i] in shell_at else -1].append(directed(rings[i], False))
    return polygons


def directed(ring: list[Coord], counter_clockwise: bool) -> list[Coord]:
    return ring if (signed_area(ring) > 0) == counter_clockwise else ring[::-1]


def _holds(outer: list[Coord], inner: list[Coord]) -> bool:
    for c in inner[:-1]:
        side = ring_side(outer, c[0], c[1])
        if side:
            return side > 0
    mid = ((inner[0][0] + inner[1][0]) / 2, (inner[0][1] + inner[1][1]) / 2)
    return ring_side(outer, *mid) > 0


def ring_side(ring: list[Coord], x: float, y: float) -> int:
    """1 inside, 0 on the ring, -1 outside."""
    inside = False
    for a, b in zip(ring, ring[1:]):
        (ax, ay), (bx, by) = a[:2], b[:2]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return 0
        if (ay > y) != (by > y) and (cross > 0) == (by > ay):
            inside = not inside
    return 1 if inside else -1
