"""Operations on many pairs at once against those of one pair at a time."""

import operator
import random

import pytest

from landgrid.functions import st
from landgrid.kernel import batch, codecs, model, ops
from landgrid.kernel.pairs import Pairs
from landgrid.plans import queries, service_queries  # noqa: F401

SET_OPERATIONS = ((ops.intersection, operator.and_), (ops.union, operator.or_), (ops.difference, operator.gt), (ops.symmetric_difference, operator.xor))


def box(rng) -> model.Geometry:
    x, y = rng.randrange(8), rng.randrange(8)
    return model.box(x, y, x + rng.randrange(1, 8), y + rng.randrange(1, 8))


def frame(rng) -> model.Geometry:
    x, y, w, h = rng.randrange(6), rng.randrange(6), rng.randrange(3, 9), rng.randrange(3, 9)
    return model.polygon([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], [(x + 1, y + 1), (x + 1, y + h - 1), (x + w - 1, y + h - 1), (x + w - 1, y + 1)])


def corner(rng) -> model.Geometry:
    x, y, w, h = rng.randrange(6), rng.randrange(6), rng.randrange(2, 8), rng.randrange(2, 8)
    return model.polygon([(x, y), (x + w, y), (x + w, y + 1), (x + 1, y + 1), (x + 1, y + h), (x, y + h)])


def couples(n: int, unit: float = 1.0) -> list:
    rng, kinds = random.Random(11), (box, frame, corner)
    made = [(rng.choice(kinds)(rng), rng.choice(kinds)(rng)) for _ in range(n)]
    return [tuple(g.map(lambda c: (c[0] * unit, c[1] * unit)) for g in p) for p in made]


@pytest.mark.parametrize("unit", [1.0, 0.0117])
def test_relations_and_set_operations_of_many_are_those_of_each(unit):
    given = couples(400, unit)
    pairs = Pairs(*([codecs.to_wkb(p[k]) for p in given] for k in (0, 1)))
    matrices: list = [None] * len(given)
    pairs.told(str, matrices)
    meet = [i for i, (a, b) in enumerate(given) if ops._envelopes_meet(a, b)]
    assert [i for i, m in enumerate(matrices) if m is not None] == meet and len(meet) > 200
    assert [matrices[i] for i in meet] == [ops.relate_matrix(*given[i]) for i in meet]
    for f, keep in SET_OPERATIONS:
        made: list = [None] * len(given)
        pairs.made(keep, made)
        for i in meet:
            got, want = codecs.from_wkb(made[i]), f(*given[i])
            assert ops.area(got) == pytest.approx(ops.area(want)) and got.kind == want.kind and len(got.members()) == len(want.members())
            if unit != 1.0:  # a union of shapes made valid one by one, each on its own grid, may keep a step between them
                continue
            assert {(round(x, 7), round(y, 7)) for x, y in got.coords()} == {(round(x, 7), round(y, 7)) for x, y in want.coords()}


def test_what_is_no_shape_along_the_axes_is_left():
    triangle, line = codecs.from_wkt("POLYGON ((0 0, 4 0, 0 4, 0 0))"), codecs.from_wkt("LINESTRING (0 0, 2 0)")
    spike = codecs.from_wkt("POLYGON ((0 0, 2 0, 2 1, 2 0, 0 0))")
    square = codecs.to_wkb(model.box(1, 1, 3, 3))
    raws = [codecs.to_wkb(g) for g in (triangle, spike, codecs.from_wkt("POLYGON EMPTY"), codecs.from_wkt("POINT (1 1)"), codecs.from_wkt("POLYGON Z ((0 0 1, 2 0 1, 2 2 1, 0 2 1, 0 0 1))"))]
    out: list = [None] * (len(raws) + 1)
    Pairs([*raws, None], [square] * len(out)).told(str, out)
    assert out == [None] * len(out)
    assert not Pairs([codecs.to_wkb(line)], [square]).groups


def test_measures_of_alike_rings():
    given = [p[0] for p in couples(60)] + [codecs.from_wkt("MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((5 5, 7 5, 7 7, 5 5)))"), codecs.from_wkt("LINESTRING (0 0, 3 4, 3 5)")]
    seen = set()
    for places, rings in batch.alike([codecs.to_wkb(g) for g in given]):
        for f, one in ((batch.areas, ops.area), (batch.lengths, ops.length), (batch.envelopes, lambda g: g.envelope())):
            for i, value in zip(places.tolist(), batch.of_rings(f, rings).tolist()):
                assert value == pytest.approx(one(given[i]))
        seen |= set(places.tolist())
    assert seen == set(range(len(given)))


def test_columns_of_pairs(spark):
    given = couples(50) + [(codecs.from_wkt("POLYGON ((0 0, 4 0, 0 4, 0 0))"), model.box(1, 1, 3, 3))]
    rows = [(i, *(bytearray(codecs.to_wkb(g)) for g in p)) for i, p in enumerate(given)] + [(99, None, bytearray(codecs.to_wkb(given[0][0])))]
    names = ("equals", "disjoint", "intersects", "within", "contains", "crosses", "touches", "overlaps")
    df = spark.createDataFrame(rows, "i int, a binary, b binary")
    found = {r.i: r for r in df.select("i", st.st_relate_matrix("a", "b").alias("m"), st.st_area(st.st_union("a", "b")).alias("u"), st.st_is_empty(st.st_intersection("a", "b")).alias("e"),
        *(getattr(st, f"st_{n}")("a", "b").alias(n) for n in names)).collect()}
    for i, (a, b) in enumerate(given):
        r = found[i]
        assert r.m == ops.relate_matrix(a, b) and r.u == pytest.approx(ops.area(ops.union(a, b))) and r.e == ops.intersection(a, b).empty
        assert [r[n] for n in names] == [getattr(ops, n)(a, b) for n in names], i
    assert found[99].m is None and found[99].u is None and found[99].contains is None


def test_buffers_and_tiles_of_boxes(spark):
    given = [model.box(0, 0, 250, 130), model.box(5, 7, 30, 400), codecs.from_wkt("POLYGON ((0 0, 250 0, 0 250, 0 0))")]
    df = spark.createDataFrame([(i, bytearray(codecs.to_wkb(g))) for i, g in enumerate(given)] + [(9, None)], "i int, g binary")
    found = {r.i: r for r in df.select("i", st.st_buffer("g", st.F.lit(25.0)).alias("w"), st.st_buffer("g", st.F.lit(-15.0)).alias("n"), st.st_tiles("g", 100.0).alias("t")).collect()}
    for i, g in enumerate(given):
        for raw, d in ((found[i].w, 25.0), (found[i].n, -15.0)):
            got, want = codecs.from_wkb(bytes(raw)), ops.buffer(g, d)
            assert ops.area(got) == pytest.approx(ops.area(want)) and ops.area(ops.symmetric_difference(got, want)) == pytest.approx(0, abs=1e-3)
        assert [codecs.from_wkb(bytes(t)).envelope() for t in found[i].t] == [t.envelope() for t in ops.tiles(g, 100.0)]
    assert found[9].w is None and found[9].t is None


def test_polygon_list_leaves_out_what_only_touches_the_slanted_side(spark, tmp_path):
    at = [((k * 7919) % 20_000, (k * 104_729) % 20_000, k) for k in range(60_000)]
    touching = [k for x, y, k in at if x >= 3000 and y >= 3000 and x + y == 15_000][:3]
    inside = [k for x, y, k in at if x >= 3000 and y >= 3000 and x + y < 14_000][:3]
    spark.createDataFrame([(k, f"Customer#{k}") for k in touching + inside], "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    found = service_queries.service_polygon_list(spark, str(tmp_path)).collect()
    assert len(touching) == 3 and sorted(int(r.rowkey[-8:]) for r in found) == sorted(inside)


@pytest.mark.parametrize("unit", [1.0, 0.0117])
def test_segments_and_boxes_of_many_are_those_of_each(unit):
    rng = random.Random(5)
    given = [(model.line([(rng.randrange(10) * unit, rng.randrange(10) * unit) for _ in range(2)]), box(rng).map(lambda c: (c[0] * unit, c[1] * unit))) for _ in range(600)]
    given += [(b, a) for a, b in given[:300]]
    pairs = Pairs(*([codecs.to_wkb(p[k]) for p in given] for k in (0, 1)))
    matrices: list = [None] * len(given)
    pairs.told(str, matrices)
    told = [i for i, m in enumerate(matrices) if m is not None]
    assert len(told) > 400 and any(i >= 600 for i in told)
    assert [matrices[i] for i in told] == [ops.relate_matrix(*given[i]) for i in told] and len({matrices[i] for i in told}) > 12
    touching = [i for i, (a, b) in enumerate(given) if ops.touches(a, b) and matrices[i] is not None]
    assert touching == [i for i in told if matrices[i][0] == "F" and any(matrices[i][k] != "F" for k in (1, 3, 4))]


def test_columns_of_lines_and_boxes(spark):
    rng = random.Random(8)
    shapes = [model.line([(rng.randrange(10), rng.randrange(10)) for _ in range(2)]) for _ in range(60)] + [model.line([(0, 0), (4, 4), (9, 0)]), model.line([(0, 0), (4, 4), (9, 0), (0, 0)]), box(rng)]
    shapes += [codecs.from_wkt(t) for t in ("LINESTRING Z (0 0 1, 3 4 2)", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "POINT (1 2)", "POINT EMPTY", "LINESTRING EMPTY", "MULTIPOINT ((1 2), (3 4))")]
    given = [(g, box(rng)) for g in shapes]
    df = spark.createDataFrame([(i, *(bytearray(codecs.to_wkb(g)) for g in p)) for i, p in enumerate(given)] + [(999, None, None)], "i int, a binary, b binary")
    names = ("equals", "disjoint", "intersects", "within", "contains", "crosses", "touches", "overlaps")
    found = {r.i: r for r in df.select("i", *(getattr(st, f"st_{n}")("a", "b").alias(n) for n in names), *(getattr(st, f"st_{n}")("b", "a").alias(f"{n}2") for n in names),
        st.st_is_closed("a").alias("closed"), st.st_num_points("a").alias("points"), st.st_dimension("a").alias("dimension"), st.st_geometry_type("a").alias("type"),
        st.st_as_wkt(st.st_start_point("a")).alias("start"), st.st_z(st.st_end_point("a")).alias("z"), st.st_x(st.st_end_point("a")).alias("x"), st.st_y("a").alias("y")).collect()}
    for i, (a, b) in enumerate(given):
        r = found[i]
        assert [r[n] for n in names] == [getattr(ops, n)(a, b) for n in names], i
        assert [r[f"{n}2"] for n in names] == [getattr(ops, n)(b, a) for n in names], i
        ends = a.data if a.kind == "LineString" else []
        assert (r.closed, r.points, r.dimension, r.type) == (all(p[0] == p[-1] for p in a.lines()) if a.dimension == 1 else None, sum(1 for _ in a.coords()), a.dimension, a.kind)
        assert (r.start, r.x) == ((codecs.to_wkt(model.Geometry("Point", ends[0], a.z)), ends[-1][0]) if ends else (None, None))
        assert r.y == (2.0 if a == codecs.from_wkt("POINT (1 2)") else None) and r.z == (2.0 if a.z else None)
    assert not any(v is not None for k, v in found[999].asDict().items() if k != "i")


def test_lines_from_points(spark):
    rows = [(1, [(0.0, 1.0), (2.0, 3.0)]), (2, [(0.0, 1.0), (2.0, 3.0), (4.0, 5.0)]), (3, None), (4, []), (5, [(7.0, 1.0), (2.0, 3.0)])]
    df = spark.createDataFrame(rows, "i int, p array<struct<x: double, y: double>>").coalesce(1)
    found = {r.i: r.w for r in df.select("i", st.st_as_wkt(st.st_make_line("p")).alias("w")).collect()}
    assert found == {1: "LINESTRING (0 1, 2 3)", 2: "LINESTRING (0 1, 2 3, 4 5)", 3: None, 4: "LINESTRING EMPTY", 5: "LINESTRING (7 1, 2 3)"}
    turned = spark.createDataFrame([(1, [(5, 2)])], "i int, p array<struct<y: int, x: int>>").select(st.st_as_wkt(st.st_make_line("p")))
    assert turned.first()[0] == "LINESTRING (2 5)"
    with pytest.raises(Exception):
        spark.createDataFrame([(1, [(None, 2.0)])], "i int, p array<struct<x: double, y: double>>").select(st.st_make_line("p")).collect()
