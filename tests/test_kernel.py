"""The kernel against JTS, which comes with Spark, and by invariants."""

import math
import random

import pytest

from landgrid.kernel import codecs, ops
from landgrid.kernel.model import Geometry, box, line, point, polygon


@pytest.fixture(scope="module")
def jts(spark):
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    return lambda g: reader.read(codecs.to_wkt(g))


def star(rng, cx, cy, r, n, hole=False):
    ring = [(cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    rings = [ring] + ([[(cx + r * 0.2 * math.cos(2 * math.pi * k / 5), cy + r * 0.2 * math.sin(2 * math.pi * k / 5)) for k in range(5)]] if hole else [])
    return polygon(*rings)


def square(rng):
    x, y = rng.randint(0, 4), rng.randint(0, 4)
    return box(x, y, x + rng.randint(1, 4), y + rng.randint(1, 4))


@pytest.mark.parametrize("text", [
    "POINT (1 2)", "POINT Z (1 2 3)", "POINT ZM (1 2 3 4)", "LINESTRING (0 0, 1 1.5)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", "MULTIPOINT ((1 2), (3 4))",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "POINT EMPTY", "MULTILINESTRING M ((0 0 1, 1 1 2), (3 3 1, 4 4 1))", "POLYGON EMPTY",
])
def test_codecs_round_trip(text):
    g = codecs.from_wkt(text.lower().replace("zm", "ZM"))
    assert codecs.to_wkt(g) == text
    assert codecs.from_wkb(codecs.to_wkb(g)) == g == codecs.from_wkb(codecs.to_wkb(g, little=False))
    if not g.empty:
        assert codecs.to_wkt(codecs.from_feature_json(codecs.to_feature_json(g))) == text
        assert codecs.to_wkt(codecs.from_shape(codecs.to_shape(g))) == text
        if not g.m:
            assert codecs.from_geojson(codecs.to_geojson(g)).data == g.data


@pytest.mark.parametrize("text", ["POINT 1 2", "POLYGON ((0 0, 1 1)", "CIRCLE (1 2)", "POINT (1)", ""])
def test_bad_text(text):
    with pytest.raises(ValueError):
        codecs.from_wkt(text)


def test_bad_bytes():
    for raw in (b"", b"\x05\x01", codecs.to_wkb(box(0, 0, 1, 1))[:-3], codecs.to_wkb(point(1, 2)) + b"x"):
        with pytest.raises(ValueError):
            codecs.from_wkb(raw)


def test_overlay(jts):
    rng = random.Random(5)
    for i in range(60):
        a, b = (star(rng, 0, 0, 5, rng.randint(3, 12), i % 2), star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3), 4, rng.randint(3, 10), i % 4 == 0)) if i % 3 else (square(rng), square(rng))
        p, q = jts(ops.make_valid(a)), jts(ops.make_valid(b))
        for f, name in ((ops.intersection, "intersection"), (ops.union, "union"), (ops.difference, "difference"), (ops.symmetric_difference, "symDifference")):
            mine, theirs = f(a, b), getattr(p, name)(q)
            assert math.isclose(ops.area(mine), theirs.getArea(), abs_tol=1e-7), name
            assert mine.empty or jts(mine).isValid()
        both, common = ops.area(ops.union(a, b)), ops.area(ops.intersection(a, b))
        assert math.isclose(both + common, ops.area(ops.make_valid(a)) + ops.area(ops.make_valid(b)), abs_tol=1e-7)


def test_relations(jts):
    rng = random.Random(6)
    kinds = [lambda: square(rng), lambda: line([(rng.randint(0, 8), rng.randint(0, 8)) for _ in range(rng.randint(2, 4))]), lambda: point(rng.randint(0, 8), rng.randint(0, 8)),
        lambda: Geometry("MultiPoint", [(float(rng.randint(0, 8)), float(rng.randint(0, 8))) for _ in range(3)]), lambda: star(rng, 4, 4, 4, 6), lambda: Geometry("MultiPolygon", [box(0, 0, 2, 2).data, box(4, 4, 6, 6).data])]
    names = ("intersects", "contains", "within", "touches", "crosses", "overlaps", "disjoint")
    for _ in range(150):
        a, b = rng.choice(kinds)(), rng.choice(kinds)()
        p, q = jts(a), jts(b)
        if p.isValid() and q.isValid():
            assert ops.relate_matrix(a, b) == p.relate(q).toString(), (a, b)
            for name in names:
                assert getattr(ops, name)(a, b) == getattr(p, name)(q), (name, a, b)
            assert ops.equals(a, b) == p.equalsTopo(q)
            assert math.isclose(ops.distance(a, b), p.distance(q), abs_tol=1e-9)


def test_buffers_and_hulls(jts):
    rng = random.Random(7)
    for i in range(12):
        g = [star(rng, 0, 0, 5, 8, i % 2), line([(0, 0), (4, 1), (3, 5)]), point(1, 2), square(rng)][i % 4]
        valid = ops.make_valid(g)
        theirs = jts(valid).buffer(1.0, 24).getArea()
        assert math.isclose(ops.area(ops.buffer(g, 1.0)), theirs, rel_tol=2e-3)
        assert math.isclose(ops.area(ops.convex_hull(g)), jts(valid).convexHull().getArea(), abs_tol=1e-9)
        if g.dimension == 2:
            assert math.isclose(ops.area(ops.buffer(g, 0)), ops.area(valid), abs_tol=1e-9)
            assert math.isclose(ops.area(ops.buffer(g, -0.3)), jts(valid).buffer(-0.3, 24).getArea(), rel_tol=5e-3, abs_tol=1e-6)
            assert ops.locate(valid, *ops.label_point(valid)) == ops.INSIDE
    assert ops.buffer(point(0, 0), -1).empty and ops.buffer(box(0, 0, 1, 1), -1).empty
    hull = ops.convex_hull(star(rng, 0, 0, 5, 9))
    assert ops.convex_hull(hull) == hull and ops.is_convex(hull)


def test_cut_and_tiles():
    parts = dict(ops.cut(box(0, 0, 4, 4), line([(1, -1), (1, 5)])))
    assert (ops.area(parts["left"]), ops.area(parts["right"])) == (4, 12)
    assert ops.cut(box(0, 0, 4, 4), line([(9, 0), (9, 4)]))[0][0] == "uncut"
    tiles = ops.tiles(polygon([(0, 0), (5, 0), (0, 5)]), 2)
    assert math.isclose(sum(map(ops.area, tiles)), 12.5)
    clipped = ops.clip_box(polygon([(0, 0), (5, 0), (0, 5)]), 1, 1, 3, 3)
    assert math.isclose(ops.area(clipped), ops.clip_area([polygon([(0, 0), (5, 0), (0, 5)]).data[0]], 1, 1, 3, 3))


def test_processing():
    ring = box(0, 0, 10, 10)
    dense = ops.densify(ring, 1.0)
    assert len(dense.data[0]) == 41 and len(ops.generalize(dense, 0.01).data[0]) == 5
    assert ops.boundary(ring).kind == "LineString" and ops.boundary(line([(0, 0), (1, 1)])).kind == "MultiPoint"
    bow = polygon([(0, 0), (2, 2), (2, 0), (0, 2)])
    assert not ops.is_simple(bow) and ops.is_simple(ring) and math.isclose(ops.area(ops.make_valid(bow)), 2)
    assert ops.is_simple(line([(0, 0), (1, 1), (2, 0)])) and not ops.is_simple(line([(0, 0), (2, 2), (2, 0), (0, 2)]))
    assert ops.nearest_coordinate(ring, 12, 5) == (10, 5, 2) and ops.nearest_coordinate(ring, 5, 5) == (5, 5, 0)
    assert [v[0] for v in ops.nearest_vertices(line([(0, 0), (1, 0), (5, 0)]), 0.9, 0, 2)] == [1, 0]
    side = ops.offset_curve(line([(0, 0), (10, 0)]), 2.0)
    assert side.data == [(0, -2), (10, -2)]
    assert math.isclose(ops.geodesic_distance(0, 0, 1, 0), 111319.490793, abs_tol=1e-5)
    assert ops.centroid(ring) == (5, 5)


def test_union_of_many():
    parts = [box(i, 0, i + 1.5, 1) for i in range(20)]
    merged = ops.union(*parts)
    assert merged.kind == "Polygon" and math.isclose(ops.area(merged), 20.5) and len(merged.data[0]) == 5
    mixed = ops.union(box(0, 0, 1, 1), point(0.5, 0.5), point(3, 3), line([(0.5, 0.5), (2, 0.5)]))
    assert mixed.kind == "GeometryCollection" and math.isclose(ops.length(mixed.data[1]), 1)
