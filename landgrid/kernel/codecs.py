"""WKT, WKB, GeoJSON, feature-service JSON and shape-file records."""

from __future__ import annotations

import json
import math
import re
import struct

from landgrid.kernel.model import KINDS, Geometry, closed, directed, regrouped

# WKT

_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")
_BY_UPPER = {k.upper(): k for k in KINDS}


class _Tokens:
    def __init__(self, text: str):
        self.items, at = [], 0
        text = text.strip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise ValueError(f"WKT: unexpected text at {at}: {text[at:at + 20]!r}")
            self.items.append(found[1])
            at = found.end()
        self.at = 0

    def peek(self) -> str:
        return self.items[self.at].upper() if self.at < len(self.items) else ""

    def take(self, wanted: str | None = None) -> str:
        item = self.peek()
        if not item or (wanted and item != wanted):
            raise ValueError(f"WKT: expected {wanted or 'more'}, found {item or 'the end'}")
        self.at += 1
        return item


def from_wkt(text: str, kind: str | None = None) -> Geometry:
    """kind: the only kind allowed, with its multi form."""
    tokens = _Tokens(text)
    g = _wkt(tokens)
    if tokens.peek():
        raise ValueError(f"WKT: unexpected {tokens.peek()}")
    if kind and g.kind not in (kind, f"Multi{kind}"):
        raise ValueError(f"WKT: expected {kind}, found {g.kind}")
    return g


def _wkt(tokens: _Tokens) -> Geometry:
    name = tokens.take()
    if name not in _BY_UPPER:
        raise ValueError(f"WKT: unknown type {name}")
    kind, flags = _BY_UPPER[name], ""
    if tokens.peek() in ("Z", "M", "ZM"):
        flags = tokens.take()
    z, m = "Z" in flags, "M" in flags
    if tokens.peek() == "EMPTY":
        tokens.take()
        return Geometry(kind, None if kind == "Point" else [], z, m)
    if kind == "GeometryCollection":
        return Geometry(kind, _listed(tokens, _wkt), z, m)

    def coord(t: _Tokens):
        values = []
        while t.peek() not in (",", ")"):
            values.append(float(t.take()))
        if len(values) < 2 or (flags and len(values) != 2 + len(flags)):
            raise ValueError("WKT: wrong number of ordinates")
        return tuple(values[: 2 + z + m] if flags else values[:2])

    def maybe(reader, none):
        def read(t: _Tokens):
            if t.peek() == "EMPTY":
                t.take()
                return none
            return reader(t)

        return read

    path = maybe(lambda t: _listed(t, coord), [])
    ring = maybe(lambda t: closed(_listed(t, coord)), [])
    rings = maybe(lambda t: _listed(t, ring), [])
    if kind == "Point":
        return Geometry(kind, _listed(tokens, coord)[0], z, m)
    if kind == "MultiPoint":
        bare_or_not = lambda t: _listed(t, coord)[0] if t.peek() == "(" else coord(t)
        return Geometry(kind, _listed(tokens, bare_or_not), z, m)
    if kind == "LineString":
        return Geometry(kind, path(tokens), z, m)
    if kind == "Polygon":
        return Geometry(kind, rings(tokens), z, m)
    return Geometry(kind, _listed(tokens, path if kind == "MultiLineString" else rings), z, m)


def _listed(tokens: _Tokens, reader) -> list:
    tokens.take("(")
    out = [reader(tokens)]
    while tokens.peek() == ",":
        tokens.take()
        out.append(reader(tokens))
    tokens.take(")")
    return out


def _number(v: float, precision: int) -> str:
    text = f"{v:.{precision}g}"
    if "e" in text:
        text = f"{float(text):f}".rstrip("0").rstrip(".") if abs(v) < 1e15 and abs(v) >= 1e-6 else text
    return text if text != "-0" else "0"


def to_wkt(g: Geometry, precision: int = 17, multi: bool = False, flat: bool = False) -> str:
    """precision: significant digits; multi: always the multi type; flat: without z and m."""
    g = g.flat() if flat else g
    if multi:
        g = to_multi(g)
    tag = g.kind.upper() + (" " + "Z" * g.z + "M" * g.m if g.z or g.m else "")
    if g.kind == "GeometryCollection":
        return f"{tag} ({', '.join(to_wkt(x, precision) for x in g.data)})" if g.data else f"{tag} EMPTY"
    if not g.data:
        return f"{tag} EMPTY"
    coord = lambda c: " ".join(repr(v).removesuffix(".0") if precision >= 17 else _number(v, precision) for v in c)
    deep = lambda x: coord(x) if isinstance(x, tuple) else "(" + ", ".join(map(deep, x)) + ")" if x else "EMPTY"
    if g.kind == "Point":
        return f"{tag} ({coord(g.data)})"
    if g.kind == "MultiPoint":
        return f"{tag} ({', '.join('(' + coord(c) + ')' for c in g.data)})"
    return f"{tag} {deep(g.data)}"


def to_multi(g: Geometry) -> Geometry:
    if g.kind in ("Point", "LineString", "Polygon"):
        return Geometry(f"Multi{g.kind}", [g.data] if g.data else [], g.z, g.m, g.srid)
    return g


# WKB


def to_wkb(g: Geometry, little: bool = True) -> bytes:
    order, end = (b"\x01", "<") if little else (b"\x00", ">")
    n = 2 + g.z + g.m
    head = lambda kind: order + struct.pack(end + "I", KINDS.index(kind) + 1 + 1000 * g.z + 2000 * g.m)
    count = lambda x: struct.pack(end + "I", len(x))
    coord = lambda c: struct.pack(f"{end}{n}d", *c)
    path = lambda x: count(x) + b"".join(map(coord, x))
    rings = lambda x: count(x) + b"".join(map(path, x))
    if g.kind == "Point":
        return head("Point") + coord(g.data or (math.nan,) * n)
    if g.kind == "LineString":
        return head(g.kind) + path(g.data)
    if g.kind == "Polygon":
        return head(g.kind) + rings(g.data)
    if g.kind == "GeometryCollection":
        return head(g.kind) + count(g.data) + b"".join(to_wkb(x, little) for x in g.data)
    return head(g.kind) + count(g.data) + b"".join(to_wkb(x, little) for x in g.members())


def from_wkb(raw: bytes) -> Geometry:
    g, at = _wkb(memoryview(raw), 0)
    if at != len(raw):
        raise ValueError("WKB: bytes left over")
    return g


def _wkb(raw: memoryview, at: int) -> tuple[Geometry, int]:
    if len(raw) < at + 5 or raw[at] > 1:
        raise ValueError("WKB: no header")
    end = "<" if raw[at] == 1 else ">"
    (code,) = struct.unpack_from(end + "I", raw, at + 1)
    at += 5
    z, m, srid = bool(code & 0x80000000), bool(code & 0x40000000), 0
    if code & 0x20000000:
        (srid,) = struct.unpack_from(end + "I", raw, at)
        at += 4
    code &= 0x1FFFFFFF
    z, m = z or code // 1000 in (1, 3), m or code // 1000 in (2, 3)
    if not 1 <= code % 1000 <= 7:
        raise ValueError(f"WKB: unknown type {code}")
    kind, n = KINDS[code % 1000 - 1], 2 + z + m

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(end + "I", raw, at)[0], at + 4

    def path(at: int) -> tuple[list, int]:
        k, at = count(at)
        values = struct.unpack_from(f"{end}{k * n}d", raw, at)
        return [values[i : i + n] for i in range(0, k * n, n)], at + 8 * n * k

    try:
        if kind == "Point":
            c = struct.unpack_from(f"{end}{n}d", raw, at)
            return Geometry(kind, None if math.isnan(c[0]) else c, z, m, srid), at + 8 * n
        if kind == "LineString":
            data, at = path(at)
            return Geometry(kind, data, z, m, srid), at
        k, at = count(at)
        data = []
        for _ in range(k):
            if kind == "Polygon":
                x, at = path(at)
                data.append(x)
            else:
                g, at = _wkb(raw, at)
                data.append(g if kind == "GeometryCollection" else g.data)
    except struct.error as short:
        raise ValueError("WKB: it ends too early") from short
    return Geometry(kind, data, z, m, srid), at


# GeoJSON


def from_geojson(text: str | dict) -> Geometry:
    obj = json.loads(text) if isinstance(text, str) else text
    name = str(obj.get("type", "")).upper()
    if name == "FEATURE":
        return from_geojson(obj["geometry"])
    if name not in _BY_UPPER:
        raise ValueError(f"GeoJSON: unsupported type {obj.get('type')}")
    kind = _BY_UPPER[name]
    if kind == "GeometryCollection":
        return Geometry(kind, [from_geojson(x) for x in obj.get("geometries", [])])
    raw = obj.get("coordinates") or []
    sizes: set[int] = set()

    def deep(x):
        if x and not isinstance(x[0], list):
            sizes.add(len(x))
            return tuple(map(float, x[:3]))
        return [deep(y) for y in x]

    data = deep(raw) if raw else None if kind == "Point" else []
    g = Geometry(kind, data, z=bool(sizes) and min(sizes) >= 3, srid=_geojson_srid(obj))
    return g if g.z else Geometry(kind, g.map(lambda c: c[:2]).data, srid=g.srid)


def _geojson_srid(obj: dict) -> int:
    found = re.search(r"(\d+)$", str(((obj.get("crs") or {}).get("properties") or {}).get("name", "")))
    return int(found[1]) if found else 0


def to_geojson(g: Geometry, srid: int = 0) -> str:
    return json.dumps(_geojson(g) | ({"crs": {"type": "name", "properties": {"name": f"EPSG:{srid}"}}} if srid else {}))


def _geojson(g: Geometry) -> dict:
    if g.kind == "GeometryCollection":
        return {"type": g.kind, "geometries": [_geojson(x) for x in g.data]}
    deep = lambda x: [list(c) if isinstance(c, tuple) else deep(c) for c in x]
    data = (list(g.data) if g.data else []) if g.kind == "Point" else deep(g.data)
    return {"type": g.kind, "coordinates": data}


# feature-service JSON: rings, paths, points, x and y, or xmin to ymax


def from_feature_json(text: str | dict) -> Geometry:
    obj = json.loads(text) if isinstance(text, str) else text
    z, m = bool(obj.get("hasZ")), bool(obj.get("hasM"))
    srid = int((obj.get("spatialReference") or {}).get("wkid") or 0)
    n = 2 + z + m
    coords = lambda xs: [tuple(map(float, c[:n])) for c in xs]
    if "rings" in obj:
        polygons = regrouped([coords(r) for r in obj["rings"]])
        return Geometry("Polygon", polygons[0] if polygons else [], z, m, srid) if len(polygons) < 2 else Geometry("MultiPolygon", polygons, z, m, srid)
    if "paths" in obj:
        paths = [coords(p) for p in obj["paths"]]
        return Geometry("LineString", paths[0], z, m, srid) if len(paths) == 1 else Geometry("MultiLineString", paths, z, m, srid)
    if "points" in obj:
        return Geometry("MultiPoint", coords(obj["points"]), z, m, srid)
    if "xmin" in obj:
        x0, y0, x1, y1 = (float(obj[c]) for c in ("xmin", "ymin", "xmax", "ymax"))
        return Geometry("Polygon", [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]], srid=srid)
    if "x" in obj:
        if obj["x"] is None or obj["x"] == "NaN":
            return Geometry("Point", None, srid=srid)
        more = [float(obj[c]) for c in ("z", "m") if obj.get(c) is not None]
        return Geometry("Point", (float(obj["x"]), float(obj["y"]), *more), "z" in obj and obj["z"] is not None, "m" in obj and obj["m"] is not None, srid)
    raise ValueError("feature JSON: no geometry")


def to_feature_json(g: Geometry, wkid: int = 0) -> str:
    out: dict = {}
    if g.z:
        out["hasZ"] = True
    if g.m:
        out["hasM"] = True
    if g.kind == "Point":
        out = dict(zip(["x", "y", *(["z"] if g.z else []), *(["m"] if g.m else [])], g.data)) if g.data else {"x": None, "y": None}
    elif g.kind == "MultiPoint":
        out["points"] = [list(c) for c in g.data]
    elif g.dimension == 1:
        out["paths"] = [[list(c) for c in p] for p in g.lines()]
    elif g.dimension == 2 and g.kind != "GeometryCollection":
        # outer rings run clockwise here
        out["rings"] = [[list(c) for c in directed(r, i > 0)] for p in g.polygons() for i, r in enumerate(p)]
    else:
        raise ValueError(f"feature JSON has no {g.kind}")
    return json.dumps(out | ({"spatialReference": {"wkid": wkid or g.srid}} if wkid or g.srid else {}))


# shape-file records

#: Shape types without, with z and with m.
_SHAPES = {"point": (1, 11, 21), "polyline": (3, 13, 23), "polygon": (5, 15, 25), "multipoint": (8, 18, 28)}


def to_shape(g: Geometry) -> bytes:
    """The content of a shape record; measures and heights in their own blocks."""
    name = {0: "point" if g.kind == "Point" else "multipoint", 1: "polyline", 2: "polygon"}[g.dimension]
    code = _SHAPES[name][1 if g.z else 2 if g.m else 0]
    if g.empty:
        return struct.pack("<i", 0)
    z_at, m_at = 2, 3 if g.z else 2
    if g.kind == "Point":
        return struct.pack("<i2d", code, *g.data[:2]) + b"".join(struct.pack("<d", v) for v in g.data[2:]) + (struct.pack("<d", math.nan) if g.z and not g.m else b"")
    coords = list(g.data) if g.kind == "MultiPoint" else [c for p in _shape_parts(g) for c in p]
    out = struct.pack("<i4d", code, *g.envelope())
    if g.dimension:
        parts = _shape_parts(g)
        starts, at = [], 0
        for p in parts:
            starts.append(at)
            at += len(p)
        out += struct.pack(f"<2i{len(parts)}i", len(parts), len(coords), *starts)
    else:
        out += struct.pack("<i", len(coords))
    out += b"".join(struct.pack("<2d", *c[:2]) for c in coords)
    for has, k in ((g.z, z_at), (g.m, m_at)):
        if has:
            values = [c[k] for c in coords]
            out += struct.pack(f"<{len(values) + 2}d", min(values), max(values), *values)
    return out


def _shape_parts(g: Geometry) -> list[list]:
    return [directed(r, i > 0) for p in g.polygons() for i, r in enumerate(p)] if g.dimension == 2 else g.lines()


def from_shape(raw: bytes) -> Geometry:
    try:
        return _shape(raw)
    except struct.error as short:
        raise ValueError("shape: it ends too early") from short


def _shape(raw: bytes) -> Geometry:
    (code,) = struct.unpack_from("<i", raw)
    if code == 0:
        return Geometry("Point", None)
    name, which = next(((n, codes.index(code)) for n, codes in _SHAPES.items() if code in codes), (None, 0))
    if name is None:
        raise ValueError(f"shape: unknown type {code}")
    z = which == 1
    if name == "point":
        values = struct.unpack_from(f"<{(len(raw) - 4) // 8}d", raw, 4)
        m = which == 2 or (z and len(values) > 3 and not math.isnan(values[3]))
        return Geometry("Point", values[: 2 + z + m], z, m)
    at = 36
    if name == "multipoint":
        (n,) = struct.unpack_from("<i", raw, at)
        starts, at = [0], at + 4
    else:
        k, n = struct.unpack_from("<2i", raw, at)
        starts = list(struct.unpack_from(f"<{k}i", raw, at + 8))
        at += 8 + 4 * k
    flat = struct.unpack_from(f"<{2 * n}d", raw, at)
    columns, at = [flat[0::2], flat[1::2]], at + 16 * n
    m = which == 2
    if z:
        columns.append(struct.unpack_from(f"<{n}d", raw, at + 16))
        at += 16 + 8 * n
        m = len(raw) >= at + 16 + 8 * n
    if m:
        columns.append(struct.unpack_from(f"<{n}d", raw, at + 16))
    coords = list(zip(*columns))
    if name == "multipoint":
        return Geometry("MultiPoint", coords, z, m)
    parts = [coords[a:b] for a, b in zip(starts, [*starts[1:], n])]
    if name == "polyline":
        return Geometry("LineString", parts[0], z, m) if len(parts) == 1 else Geometry("MultiLineString", parts, z, m)
    polygons = regrouped(parts)
    return Geometry("Polygon", polygons[0] if polygons else [], z, m) if len(polygons) < 2 else Geometry("MultiPolygon", polygons, z, m)


