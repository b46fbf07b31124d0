"""Geometry functions on WKB columns, as Arrow UDFs over the kernel.

Null arguments give null. Text or bytes that are no geometry raise an error; st_try_from_wkt gives null instead.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.functions.grid import z_encode
from landgrid.kernel import batch, codecs, cuts, model, ops, projection, valid
from landgrid.kernel.pairs import Pairs, boxes_of, frames_of, pairs_of, snapping_step
from landgrid.kernel.model import Geometry

G, B, S, D, I, BOOL = T.BinaryType(), T.BinaryType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()  # noqa: E741
XY = T.StructType([T.StructField(c, D) for c in "xy"])
XYD = T.StructType([T.StructField(c, D) for c in ("x", "y", "distance")])
BOX = T.StructType([T.StructField(c, D) for c in ("xmin", "ymin", "xmax", "ymax")])
RANGE = T.StructType([T.StructField(c, D) for c in ("low", "high")])
VERTEX = T.ArrayType(T.StructType([T.StructField("i", I), *XYD.fields]))
PARTS = T.ArrayType(T.StructType([T.StructField("side", S), T.StructField("geom", B)]))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def _udf(f: Callable, kind: T.DataType, n_geometries: int, *columns, once: bool = False, **fixed) -> Column:
    """f on the first so many columns as geometries and the rest as they are; a geometry result becomes WKB.

    once: filters on the result aren't moved below it, which would compute it twice.
    """

    def apply(*series: pd.Series):
        out = []
        for row in zip(*series):
            if any(v is None for v in row):
                out.append(None)
                continue
            value = f(*(codecs.from_wkb(v) if i < n_geometries else v for i, v in enumerate(row)), **fixed)
            out.append(codecs.to_wkb(value) if isinstance(value, Geometry) else value)
        return pd.DataFrame([(None,) * len(kind.fields) if v is None else v for v in out], columns=kind.names) if isinstance(kind, T.StructType) else pd.Series(out, dtype=object)

    # pandas UDFs take their kind from annotations, and a fixed number of series
    names = [f"s{i}" for i in range(len(columns))]
    scope = {"apply": apply}
    exec(f"def call({', '.join(names)}):\n    return apply({', '.join(names)})", scope)  # noqa: S102
    call = scope["call"]
    call.__annotations__ = {n: pd.Series for n in names} | {"return": pd.DataFrame if isinstance(kind, T.StructType) else pd.Series}
    made = F.pandas_udf(call, kind)
    return (made.asNondeterministic() if once else made)(*map(_col, columns))


# codecs and constructors


def st_from_wkt(text, kind: str | None = None) -> Column:
    """Polygons of alike rings together."""

    def call(s: pd.Series) -> pd.Series:
        texts, one = s.tolist(), lambda t: codecs.to_wkb(codecs.from_wkt(t, kind))
        return pd.Series([one(t) if raw is None and t is not None else raw for t, raw in zip(texts, batch.of_texts(texts, one))], dtype=object)

    call.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, G)(_col(text))


def st_try_from_wkt(text) -> Column:
    return _udf(_try_wkt, G, 0, text)


def _try_wkt(text: str) -> Geometry | None:
    try:
        return codecs.from_wkt(text)
    except ValueError:
        return None


def st_as_wkt(g, precision: int = 17, multi: bool = False, flat: bool = False) -> Column:
    return _udf(codecs.to_wkt, S, 1, g, precision=precision, multi=multi, flat=flat)


def st_from_wkb(raw) -> Column:
    """Checks that bytes are WKB of either byte order, and gives little-endian."""
    return _udf(lambda r: codecs.from_wkb(bytes(r)), G, 0, raw)


def st_as_wkb(g, little: bool = True) -> Column:
    return _udf(codecs.to_wkb, B, 1, g, little=little)


def st_from_geojson(text) -> Column:
    return _udf(codecs.from_geojson, G, 0, text)


def st_as_geojson(g, srid: int = 0) -> Column:
    return _udf(codecs.to_geojson, S, 1, g, srid=srid)


def st_from_feature_json(text) -> Column:
    return _udf(codecs.from_feature_json, G, 0, text)


def st_as_feature_json(g, wkid: int = 0) -> Column:
    return _udf(codecs.to_feature_json, S, 1, g, wkid=wkid)


def st_from_shape(raw) -> Column:
    return _udf(lambda r: codecs.from_shape(bytes(r)), G, 0, raw)


def st_as_shape(g) -> Column:
    return _udf(codecs.to_shape, B, 1, g)


def st_point(x, y) -> Column:
    return _udf(model.point, G, 0, x, y)


def st_make_envelope(xmin, ymin, xmax, ymax) -> Column:
    def call(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(batch.boxes(a, b, c, d), dtype=object).where(~(a.isna() | b.isna() | c.isna() | d.isna()), None)

    call.__annotations__ = {n: pd.Series for n in "abcd"} | {"return": pd.Series}
    return F.pandas_udf(call, G)(*(_col(v).cast("double") for v in (xmin, ymin, xmax, ymax)))


def st_make_line(points) -> Column:
    """From an array of structs (x, y); those of as many points together."""

    def call(a: pa.Array) -> pa.Array:
        out: list = [None] * len(a)
        x, y = _numbers(a.values, "x"), _numbers(a.values, "y")
        starts, given = a.offsets.to_numpy(), np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False))
        sizes = np.diff(starts)[given]
        if x is None or y is None:
            return pa.array([None if ps is None else codecs.to_wkb(model.line([_place(p) for p in ps])) for ps in a.to_pylist()], pa.binary())
        for n in np.unique(sizes).tolist():
            own = given[sizes == n]
            at = starts[own][:, None] + np.arange(n)
            for i, made in zip(own.tolist(), batch.paths(np.stack([x[at], y[at]], axis=2))):
                out[i] = made
        return pa.array(out, pa.binary())

    call.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(call, G)(_col(points))


def _numbers(structs: pa.StructArray, name: str) -> np.ndarray | None:
    """A field of structs as doubles; none where some lack it."""
    at = structs.type.get_field_index(name)
    field = structs.flatten()[at] if at >= 0 else None
    return None if field is None or field.null_count else field.cast(pa.float64()).to_numpy()


def st_make_polygon(ring) -> Column:
    """From an array of structs (x, y), closed where it isn't."""
    return _udf(lambda ps: model.polygon([_place(p) for p in ps]), G, 0, ring)


def _place(p) -> tuple[float, float]:
    """Of a struct, which comes as a tuple where another of these functions made it."""
    return (p["x"], p["y"]) if isinstance(p, dict) else (p[0], p[1])


def st_points(g) -> Column:
    """All vertices as an array of structs (x, y), for column functions."""
    return _udf(lambda g: [(c[0], c[1]) for c in g.coords()], T.ArrayType(XY), 1, g)


def valid_wkt(text) -> Column:
    """Whether text begins as a polygon or several, before it is parsed."""
    return _col(text).rlike(r"(?i)^\s*(MULTI)?POLYGON")


FRAME = T.StructType([T.StructField(c, T.LongType(), False) for c in ("x0", "y0", "x1", "y1", "hx0", "hy0", "hx1", "hy1")])


def st_frame(g, hollow: bool = True) -> Column:
    """Corners of a box along the axes in integer units, and, where hollow, of the box cut out of its inside (empty at a corner of those without one).

    Null for all else. It is computed once, and filters on it aren't moved below it.
    """

    def call(a: pa.Array) -> pa.Array:
        made, known = np.zeros((len(a), 8), np.int64), np.zeros(len(a), bool)
        for places, corners in frames_of(a.to_pylist(), hollow):
            made[places], known[places] = corners, True
        return pa.StructArray.from_arrays([pa.array(c) for c in made.T.copy()], FRAME.names, mask=pa.array(~known))

    call.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(call, FRAME).asNondeterministic()(_col(g))


def st_box_step(g) -> Column:
    """The snapping step of a box along the axes, null for all else. It is computed once, as st_frame."""

    def call(a: pa.Array) -> pa.Array:
        made, known = np.zeros(len(a)), np.zeros(len(a), bool)
        for places, corners in boxes_of(a.to_pylist()):
            made[places], known[places] = snapping_step(np.abs(corners).max(axis=1)), True
        return pa.array(made, mask=~known)

    call.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(call, D).asNondeterministic()(_col(g))


# relations


def _together(put: Callable[[Pairs, list], None], f: Callable, kind: T.DataType, a, b, once: bool = False) -> Column:
    """Pairs of polygons along the axes, and for relations of segments and boxes, go together, by put(pairs, out); others by f, one by one."""

    def call(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = ([None if v is None else bytes(v) for v in s] for s in (x, y))
        out: list = [None] * len(p)
        put(pairs_of(p, q), out)
        for i, (v, w) in enumerate(zip(p, q)):
            if out[i] is None and v is not None and w is not None:
                value = f(codecs.from_wkb(v), codecs.from_wkb(w))
                out[i] = codecs.to_wkb(value) if isinstance(value, Geometry) else value
        return pd.Series(out, dtype=object)

    call.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    made = F.pandas_udf(call, kind)
    return (made.asNondeterministic() if once else made)(_col(a), _col(b))


def _relation(f: Callable, tell: Callable[[str], bool], mixed: Callable[[str], bool] | None = None) -> Callable:
    """tell: the relation of two polygons by their matrix; mixed: that of a line and a polygon, where it isn't the same."""

    def relation(a, b) -> Column:
        return _together(lambda pairs, out: pairs.told(tell, out, mixed), f, BOOL, a, b)

    relation.__doc__ = f.__doc__
    return relation


def _matching(pattern: str) -> Callable[[str], bool]:
    return lambda m: ops.matches(m, pattern)


def _meet(m: str) -> bool:
    return any(m[i] != "F" for i in (0, 1, 3, 4))


#: How the matrix of two polygons tells a relation.
TOLD: dict[str, Callable] = {
    "equals": lambda: _matching("T*F**FFF*"), "disjoint": lambda: lambda m: not _meet(m), "intersects": lambda: _meet, "within": lambda: _matching("T*F**F***"),
    "contains": lambda: _matching("T*****FF*"), "crosses": lambda: lambda m: False, "touches": lambda: lambda m: m[0] == "F" and _meet(m), "overlaps": lambda: _matching("T*T***T**"),
    "relate": _matching, "relate_matrix": lambda: str,
}
st_equals, st_disjoint, st_intersects, st_within, st_contains, st_touches = (_relation(getattr(ops, n), TOLD[n]()) for n in ("equals", "disjoint", "intersects", "within", "contains", "touches"))
st_crosses, st_overlaps = _relation(ops.crosses, TOLD["crosses"](), _matching("T*T***T**")), _relation(ops.overlaps, TOLD["overlaps"](), lambda m: False)


def st_relate(a, b, pattern: str) -> Column:
    return _together(lambda pairs, out: pairs.told(_matching(pattern), out), lambda g, h: ops.relate(g, h, pattern), BOOL, a, b)


def st_relate_matrix(a, b, once: bool = False) -> Column:
    return _together(lambda pairs, out: pairs.told(str, out), ops.relate_matrix, S, a, b, once)


def st_contains_point(g, x, y) -> Column:
    """Inside or on the boundary."""
    return _udf(lambda g, x, y: ops.locate(g, x, y) != ops.OUTSIDE, BOOL, 1, g, x, y)


# set operations


def _pair(f: Callable, keep: Callable) -> Callable:
    """keep: which of the places in either polygon are in the result."""

    def operation(a, b, once: bool = False) -> Column:
        return _together(lambda pairs, out: pairs.made(keep, out), f, G, a, b, once)

    operation.__doc__ = f.__doc__
    return operation


st_intersection, st_union = _pair(ops.intersection, operator.and_), _pair(ops.union, operator.or_)
st_difference, st_sym_difference = _pair(ops.difference, operator.gt), _pair(ops.symmetric_difference, operator.xor)


def st_clip_by_box(g, xmin, ymin, xmax, ymax, once: bool = False) -> Column:
    """Polygons along the axes go together, others one by one."""

    def call(s: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        corners = np.stack([v.to_numpy(np.float64, na_value=np.nan) for v in (a, b, c, d)], axis=1)
        given = ~np.isnan(corners).any(axis=1)
        raws = [bytes(v) if v is not None and known else None for v, known in zip(s, given.tolist())]
        boxes = batch.boxes(*corners.T)
        held, apart = batch.clear_of(raws, corners)
        out: list = [raw if own else None for raw, own in zip(raws, held.tolist())]
        pairs_of([None if done else raw for raw, done in zip(raws, (held | apart).tolist())], boxes).made(operator.and_, out)
        return pd.Series([codecs.to_wkb(ops.clip_box(codecs.from_wkb(r), *at)) if o is None and r is not None else o for r, at, o in zip(raws, corners.tolist(), out)], dtype=object)

    call.__annotations__ = {n: pd.Series for n in "sabcd"} | {"return": pd.Series}
    made = F.pandas_udf(call, G)
    return (made.asNondeterministic() if once else made)(_col(g), *(_col(v).cast("double") for v in (xmin, ymin, xmax, ymax)))


def st_clip_area(g, xmin, ymin, xmax, ymax) -> Column:
    """Area in a box without making the clipped shape."""
    return _udf(lambda g, *b: float(sum(ops.clip_area(p[:1], *b) - sum(ops.clip_area([h], *b) for h in p[1:]) for p in g.polygons())), D, 1, g, xmin, ymin, xmax, ymax)


def st_cut(g, cutter) -> Column:
    """Array of (side, geom): left, right or uncut parts. Polygons along the axes and segments along one go together."""

    def call(a: pa.Array, b: pa.Array) -> pa.Array:
        p, q = a.to_pylist(), b.to_pylist()
        out = cuts.cuts(p, q)
        for i, (v, w) in enumerate(zip(p, q)):
            if out[i] is None and v is not None and w is not None:
                out[i] = [(side, codecs.to_wkb(part)) for side, part in ops.cut(codecs.from_wkb(v), codecs.from_wkb(w))]
        return pa.array(out, pa.list_(pa.struct([("side", pa.string()), ("geom", pa.binary())])))

    call.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(call, PARTS)(_col(g), _col(cutter))


def st_tiles(g, size: float) -> Column:
    """A polygon cut by squares; boxes of a batch together."""

    def call(s: pd.Series) -> pd.Series:
        raws = [None if v is None else bytes(v) for v in s]
        out: list = [None] * len(raws)
        for places, corners in boxes_of(raws):
            for i, made in zip(places.tolist(), batch.tiles(corners, size)):
                out[i] = made
        return pd.Series([[codecs.to_wkb(t) for t in ops.tiles(codecs.from_wkb(r), size)] if o is None and r is not None else o for r, o in zip(raws, out)], dtype=object)

    call.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, T.ArrayType(B))(_col(g))


# measures and accessors


def _measure(f: Callable, kind: T.DataType) -> Callable:
    def measure(g) -> Column:
        return _udf(f, kind, 1, g)

    return measure


_UNSET = object()


def _alike(together: Callable, f: Callable, kind: T.DataType) -> Callable:
    """Polygons and lines of alike rings go together, by together(rings, one of them), others one by one."""

    def measure(g) -> Column:
        def call(s: pd.Series):
            raws = [None if v is None else bytes(v) for v in s]
            out = [None if raw is None else _UNSET for raw in raws]
            for places, rings in batch.alike(raws):
                for i, value in zip(places.tolist(), together(rings, raws[places[0]])):
                    out[i] = value  # _UNSET where it isn't told
            for i, raw in enumerate(raws):
                if out[i] is _UNSET:
                    out[i] = f(codecs.from_wkb(raw))
            return pd.DataFrame([(None,) * len(kind.fields) if v is None else v for v in out], columns=kind.names) if isinstance(kind, T.StructType) else pd.Series(out, dtype=object)

        call.__annotations__ = {"s": pd.Series, "return": pd.DataFrame if isinstance(kind, T.StructType) else pd.Series}
        return F.pandas_udf(call, kind)(_col(g))

    return measure


def _batched(together: Callable, f: Callable, kind: T.DataType) -> Callable:
    """Measures by those of rings as arrays."""
    return _alike(lambda rings, _: batch.of_rings(together, rings).tolist(), f, kind)


def _where_clear(together: Callable, f: Callable, kind: T.DataType) -> Callable:
    """By together(rings), or one by one where that gives none."""
    return _alike(lambda rings, _: [_UNSET if v is None else v for v in together(rings)], f, kind)


def _constant(value: Callable, f: Callable, kind: T.DataType) -> Callable:
    """What shapes of one layout have in common."""
    return _alike(lambda rings, raw: [value(rings, raw)] * len(rings[0][1]), f, kind)


def _of_lines(value: Callable, f: Callable, kind: T.DataType) -> Callable:
    """Of a line's points as arrays; polygons have none."""
    return _alike(lambda rings, _: value(rings[0][1]) if rings[0][0] < 0 else [None] * len(rings[0][1]), f, kind)


def _real(g: Geometry, which: int) -> float | None:
    return float(g.data[which]) if g.kind == "Point" and g.data and len(g.data) > which else None


def _place_of(which: int) -> Callable:
    """x or y of a point."""

    def measure(g) -> Column:
        def call(s: pd.Series) -> pd.Series:
            raws = [None if v is None else bytes(v) for v in s]
            flat = [raw is not None and len(raw) == len(batch.POINT) + 16 and raw[: len(batch.POINT)] == batch.POINT for raw in raws]
            xy = np.frombuffer(b"".join([raw[len(batch.POINT) :] for raw, p in zip(raws, flat) if p]), "<f8").reshape(-1, 2)
            known = iter(xy[:, which].tolist() if not np.isnan(xy).any() else [_real(codecs.from_wkb(raw), which) for raw, p in zip(raws, flat) if p])
            return pd.Series([None if raw is None else next(known) if p else _real(codecs.from_wkb(raw), which) for raw, p in zip(raws, flat)], dtype=object)

        call.__annotations__ = {"s": pd.Series, "return": pd.Series}
        return F.pandas_udf(call, D)(_col(g))

    return measure


st_area = _batched(batch.areas, lambda g: float(ops.area(g)), D)

def st_areas(parts) -> Column:
    """The area of each of an array's geometries."""

    def call(a: pa.Array) -> pa.Array:
        raws = a.flatten().to_pylist()
        out = [None] * len(raws)
        for places, rings in batch.alike(raws):
            for i, value in zip(places.tolist(), batch.of_rings(batch.areas, rings).tolist()):
                out[i] = value
        known = iter([float(ops.area(codecs.from_wkb(r))) if v is None and r is not None else v for r, v in zip(raws, out)])
        return pa.array([None if n is None else [next(known) for _ in range(n)] for n in pc.list_value_length(a).to_pylist()], pa.list_(pa.float64()))

    call.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(call, T.ArrayType(D))(_col(parts))


st_length = _batched(batch.lengths, lambda g: float(ops.length(g)), D)
st_envelope = _batched(batch.envelopes, lambda g: g.envelope(), BOX)
st_centroid = _measure(ops.centroid, XY)
st_label_point = _measure(ops.label_point, XY)
st_convex_hull = _measure(lambda g: ops.convex_hull(g), G)
st_is_convex = _measure(ops.is_convex, BOOL)
st_boundary = _measure(ops.boundary, G)
st_make_valid = _where_clear(valid.made_valid, lambda g: codecs.to_wkb(ops.make_valid(g)), G)
st_is_simple = _where_clear(valid.simple, ops.is_simple, BOOL)
st_dimension = _constant(lambda rings, _: 1 if rings[0][0] < 0 else 2, lambda g: g.dimension, I)
st_coord_dimension = _measure(lambda g: 2 + g.z + g.m, I)
st_geometry_type = _constant(lambda _, raw: model.KINDS[raw[1] - 1], lambda g: g.kind, S)
st_srid = _measure(lambda g: g.srid, I)


def st_is_empty(g) -> Column:
    def call(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else v == batch.EMPTY if v[:9] == batch.ONE_RING and len(v) > batch.HEAD or v == batch.EMPTY else codecs.from_wkb(bytes(v)).empty for v in s], dtype=object)

    call.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, BOOL)(_col(g))


st_is_3d = _measure(lambda g: g.z, BOOL)
st_is_measured = _measure(lambda g: g.m, BOOL)
st_num_points = _constant(lambda rings, _: sum(xy.shape[1] for _, xy in rings), lambda g: sum(1 for _ in g.coords()), I)
st_num_geometries = _measure(lambda g: len(g.members()), I)
st_num_interior_rings = _measure(lambda g: max(0, len(g.data) - 1) if g.kind == "Polygon" else None, I)
st_exterior_ring = _measure(lambda g: Geometry("LineString", g.data[0], g.z, g.m) if g.kind == "Polygon" and g.data else None, G)
st_is_closed = _of_lines(lambda xy: (xy[:, 0] == xy[:, -1]).all(axis=1).tolist(), lambda g: all(p[0] == p[-1] for p in g.lines()) if g.dimension == 1 else None, BOOL)
st_start_point = _of_lines(lambda xy: batch.points(xy[:, 0]), lambda g: codecs.to_wkb(Geometry("Point", g.data[0], g.z, g.m)) if g.kind == "LineString" and g.data else None, G)
st_end_point = _of_lines(lambda xy: batch.points(xy[:, -1]), lambda g: codecs.to_wkb(Geometry("Point", g.data[-1], g.z, g.m)) if g.kind == "LineString" and g.data else None, G)
st_to_multi = _measure(codecs.to_multi, G)
st_x, st_y = _place_of(0), _place_of(1)
st_z = _measure(lambda g: _real(g, 2) if g.z else None, D)
st_m = _measure(lambda g: _real(g, 2 + g.z) if g.m else None, D)


def _nth(items: list, n: int):
    return items[n - 1] if 1 <= n <= len(items) else None


def st_point_n(g, n: int) -> Column:
    """The n-th vertex of a line, from 1."""
    return _udf(lambda g: Geometry("Point", c, g.z, g.m) if g.kind == "LineString" and (c := _nth(g.data, n)) else None, G, 1, g)


def st_interior_ring_n(g, n: int) -> Column:
    return _udf(lambda g: Geometry("LineString", r, g.z, g.m) if g.kind == "Polygon" and (r := _nth(g.data[1:], n)) else None, G, 1, g)


def st_geometry_n(g, n: int) -> Column:
    return _udf(lambda g: _nth(g.members(), n), G, 1, g)


def st_interval(g, which: str) -> Column:
    """Least and greatest x, y, z or m."""
    return _udf(lambda g: g.interval(which), RANGE, 1, g)


def st_distance(a, b) -> Column:
    return _udf(ops.distance, D, 2, a, b)


def st_nearest_coordinate(g, x, y) -> Column:
    return _udf(ops.nearest_coordinate, XYD, 1, g, x, y)


def st_nearest_vertices(g, x, y, n: int = 1, within: float = float("inf")) -> Column:
    return _udf(lambda g, x, y: ops.nearest_vertices(g, x, y, n, within), VERTEX, 1, g, x, y)


def st_geodesic_distance(lon1, lat1, lon2, lat2) -> Column:
    return _udf(ops.geodesic_distance, D, 0, lon1, lat1, lon2, lat2)


# processing


def st_buffer(g, d, vertices: int = ops.FULL_CIRCLE) -> Column:
    """All within d, or what stays of a polygon for a negative d; boxes of a batch together."""

    def call(s: pd.Series, d: pd.Series) -> pd.Series:
        raws = [None if v is None or pd.isna(r) else bytes(v) for v, r in zip(s, d)]
        out: list = [None] * len(raws)
        for places, corners in boxes_of(raws) if vertices % 4 == 0 else ():
            for i, r, made in zip(places.tolist(), (by := d.to_numpy(np.float64)[places]).tolist(), batch.buffered(corners, by, vertices)):
                out[i] = made if r else None
        return pd.Series([codecs.to_wkb(ops.buffer(codecs.from_wkb(r), float(w), vertices)) if o is None and r is not None else o for r, w, o in zip(raws, d, out)], dtype=object)

    call.__annotations__ = {"s": pd.Series, "d": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, G)(_col(g), _col(d).cast("double"))


def st_offset_curve(g, d, join: str = "round", miter_limit: float = 4.0) -> Column:
    return _udf(ops.offset_curve, G, 1, g, d, join=join, miter_limit=miter_limit)


def st_simplify(g, tolerance) -> Column:
    return _udf(ops.generalize, G, 1, g, tolerance)


def st_densify(g, longest) -> Column:
    return _udf(ops.densify, G, 1, g, longest)


def st_affine(g, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """x' = a x + b y + c, y' = d x + e y + f; z and m stay."""
    return _udf(lambda g: g.map(lambda v: (a * v[0] + b * v[1] + c, d * v[0] + e * v[1] + f, *v[2:])), G, 1, g)


def st_to_zone(g, meridian) -> Column:
    """Degrees to metres in the zone of a central meridian."""
    return _udf(lambda g, m: projection.projected(g, projection.to_zone, m), G, 1, g, meridian)


def st_from_zone(g, meridian) -> Column:
    return _udf(lambda g, m: projection.projected(g, projection.from_zone, m), G, 1, g, meridian)


def st_to_mercator(g) -> Column:
    return _udf(lambda g: projection.projected(g, projection.to_mercator), G, 1, g)


def st_from_mercator(g) -> Column:
    return _udf(lambda g: projection.projected(g, projection.from_mercator), G, 1, g)


# aggregates


def _aggregate(f: Callable) -> Callable:
    def call(series: pd.Series) -> bytes:
        return codecs.to_wkb(f(*(codecs.from_wkb(bytes(v)) for v in series if v is not None)))

    call.__annotations__ = {"series": pd.Series, "return": bytes}
    return F.pandas_udf(call, B)


def st_union_agg(g) -> Column:
    """All of a group dissolved; a group is held by one task, see dissolve for large ones."""
    return _aggregate(ops.union)(_col(g))


def st_convex_hull_agg(g) -> Column:
    return _aggregate(ops.convex_hull)(_col(g))


def envelope_agg(box) -> list[Column]:
    """Aggregates for the envelope of envelopes (structs xmin to ymax)."""
    box = _col(box)
    return [F.min(box["xmin"]).alias("xmin"), F.min(box["ymin"]).alias("ymin"), F.max(box["xmax"]).alias("xmax"), F.max(box["ymax"]).alias("ymax")]


_SIDE = 12  # bits of a place's row and column in the extent


def _by_steps(df: DataFrame, keys: list[str], geom: str, agg: Callable, group: int) -> DataFrame:
    """A key's geometries merge with those that lie in the same cell of a quad tree over the extent, then with those of the cell above it.

    A cell with more than ``group`` geometries goes to several tasks, so that no task holds many of them at once.
    """
    part = df.select(*keys, F.col(geom).alias("geom"))
    most = part.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    depth = min(_SIDE, math.ceil(math.log(max(1, most / group), 4)))
    if depth:
        part = part.withColumn("_b", st_envelope("geom")).withColumn("_x", F.col("_b.xmin") + F.col("_b.xmax")).withColumn("_y", F.col("_b.ymin") + F.col("_b.ymax"))
        x0, x1, y0, y1 = part.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
        place = lambda c, lo, hi: F.coalesce(F.least(F.floor((F.col(c) - lo) / max(hi - lo, 1e-300) * (1 << _SIDE)), F.lit((1 << _SIDE) - 1)), F.lit(0))
        part = part.withColumn("_z", z_encode(0, place("_y", y0 or 0.0, y1 or 0.0), place("_x", x0 or 0.0, x1 or 0.0))).select(*keys, "geom", "_z")
    for level in range(depth, 0, -1):
        cells = part.withColumn("_cell", F.shiftright("_z", 2 * (_SIDE - level)))
        sizes = cells.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_cell").alias("_c")).agg(F.count("*").alias("_n"))
        same = F.col("_cell") == F.col("_c")
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        lots = cells.join(sizes, same).withColumn("_lot", F.pmod(F.xxhash64("geom"), F.ceil(F.col("_n") / group)))
        part = lots.groupBy(*keys, "_cell", "_lot").agg(agg("geom").alias("geom")).select(*keys, "geom", F.shiftleft("_cell", 2 * (_SIDE - level)).alias("_z"))
    # a given number of partitions stays: few rows may be much work
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return part.repartition(tasks, *keys).groupBy(*keys).agg(agg("geom").alias(geom))


def dissolve(df: DataFrame, keys: list[str], geom: str = "geom", group: int = 512) -> DataFrame:
    return _by_steps(df, keys, geom, st_union_agg, group)


def hulls(df: DataFrame, keys: list[str], geom: str = "geom", group: int = 4096) -> DataFrame:
    return _by_steps(df, keys, geom, st_convex_hull_agg, group)
