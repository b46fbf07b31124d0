"""Golden values of codes, grids, sheets and measures."""

import math

import pytest
from pyspark.sql import functions as F

from landgrid.functions import codes, dimension, grid, measure, sheets, text


@pytest.fixture
def one(spark):
    row = spark.range(1)
    return lambda *columns: tuple(row.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_category_codes(one):
    for code, level, parent in (("0000", 0, "0000"), ("0100", 1, "0000"), ("0110", 2, "0100"), ("0111", 3, "0110"), ("1001", 3, "1000"), ("0601", 3, "0600"), ("01", -1, "0000")):
        assert one(codes.category_level(F.lit(code))) == (level,)
        if level >= 0:
            assert one(codes.category_parent(F.lit(code))) == (parent,)
    assert one(codes.category_ancestors(F.lit("0111"))) == (["0100", "0110", "0111"],)
    assert one(codes.category_ancestors(F.lit("1001"))) == (["1000", "1001"],)
    assert one(codes.category_ancestors(F.lit("0111"), 2)) == (["0110", "0111"],)
    assert one(codes.category_upper(F.lit("0110")), codes.category_upper(F.lit("0100"))) == ("0120", "0200")
    assert one(codes.category_contains(F.lit("1000"), F.lit("1001")), codes.category_contains(F.lit("1000"), F.lit("1101"))) == (True, False)


def test_region_codes(one):
    for code, level in (("330000", 1), ("330100", 2), ("330110", 3), ("331000", 2), ("330103001", 3)):
        assert one(codes.region_level(F.lit(code))) == (level,)
    assert one(codes.region_short(F.lit("500000"))) == ("50",)
    assert one(codes.row_key(F.lit("3301"), F.lit("01"), F.lit("7"))) == ("330100000000010000000007",)
    assert one(codes.pad_left(F.lit("123456789"), 8)) == ("123456789",)


def test_dimension(spark):
    rows = {r["code"]: r for r in dimension.category_dimension(spark).collect()}
    assert len(rows) == 172 and rows["0111" if "0111" in rows else "0110"]["parent"] == "0100"
    assert dimension.names_below("0100").split() == ["耕地", "水田", "旱地"]
    regions = dimension.region_dimension(spark.createDataFrame([("110101",), ("110102",), ("130100",)], "code string"))
    assert [tuple(r) for r in dimension.province_ranges(regions).orderBy("province").collect()] == [("110000", 2, 0), ("130000", 1, 2)]


def test_z_values(one):
    for key, level, row, col in ((3746994889986513098, 13, 3400, 2731), (4035225266181007629, 14, 6803, 5474), (818262, 0, 750, 609)):
        assert one(grid.z_level(F.lit(key)), grid.z_row(F.lit(key)), grid.z_col(F.lit(key))) == (level, row, col)
        assert one(grid.z_encode(level, F.lit(row), F.lit(col))) == (key,)
    assert one(grid.z_encode(0, F.lit(749), F.lit(599)), grid.z_encode(14, F.lit(2458), F.lit(5303))) == (816763, 4035225266163927918)


def test_point_cells(one):
    cells = one(grid.point_cells(F.lit(116.53335571289062), F.lit(39.942169189453125)))[0]
    assert cells[:3] == [288230376151711744, 576460752303423491, 864691128455135245]
    assert cells[-2:] == [3746994889986422671, 4035225266180644414]


def test_sheets(one):
    lat, lon = F.lit(39.942), F.lit(116.533)
    assert one(*(sheets.sheet_code(lat, lon, sheets.scale_of(s)) for s in "EGD")) == ("J50E001011", "J50G002041", "J50D001006")
    box = one(sheets.sheet_envelope(F.lit("J50E001011")))[0]
    assert box["xmin"] == 116.5 and math.isclose(box["ymin"], 39 + 5 / 6)
    assert one(*(sheets.central_meridian(F.lit(x)) for x in (73.6, 116.5, 120.0, 134.7))) == (75, 117, 123, 135)
    assert len(one(sheets.sub_sheets(F.lit("J50D001006"), sheets.scale_of("E")))[0]) == 4
    # across the line of two sheets of 1 : 1 million
    across = one(sheets.sheets_in_range(F.lit(119.9), F.lit(39.9), F.lit(120.1), F.lit(40.1), sheets.scale_of("B")))[0]
    assert sorted(across) == ["J50B001002", "J51B001001", "K50B002002", "K51B002001"]


def test_measures(one):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((120, 30), (121, 30), (121, 31), (120, 31), (120, 30))))
    area, flat, rim = one(measure.ellipsoid_ring_area(ring), measure.ring_area(ring), measure.path_length(ring))
    assert math.isclose(area, 10642393438.71167, rel_tol=1e-9) and flat == 1 and rim == 4
    assert math.isclose(one(measure.ellipsoid_ring_area(F.reverse(ring)))[0], -area)
    assert one(measure.point_in_ring(ring, F.lit(120.5), F.lit(30.5)), measure.point_in_ring(ring, F.lit(121.5), F.lit(30.5))) == (True, False)
    metres = one(measure.ellipsoid_distance(*map(F.lit, (120.0, 30.0, 120.0, 30.01))))[0]
    assert math.isclose(metres, 1108.5, abs_tol=1)


def test_raster_cells(one):
    level = [F.lit(5.0)] * 8
    slope = [F.lit(float(h)) for h in (110, 110, 100, 90, 90, 90, 100, 110)]
    size = F.lit(10.0)
    assert one(measure.raster_cell_surface(F.lit(5.0), level, size)) == (100.0,)
    assert math.isclose(one(measure.raster_cell_surface(F.lit(100.0), slope, size))[0], 141.4213562373095)
    assert one(measure.raster_cell_surface(F.lit(5.0), [F.lit(None).cast("double")] * 8, size)) == (100.0,)


def test_text(one):
    assert one(text.property_map(F.lit("A:1\tB:2:3\tC\t:x"))) == ({"A": "1", "B": "2", "": "x"},)
    assert one(text.property_map(F.lit("A:1\tA:2"))) == ({"A": "2"},)
    assert one(text.tokens(F.lit("Abc 耕地 d1"))) == (["abc", "耕", "地", "d1"],)
    box = F.struct(*(F.lit(float(i)).alias(c) for i, c in enumerate(("xmin", "ymin", "xmax", "ymax"))))
    assert tuple(one(text.parse_envelope(text.format_envelope(box)))[0]) == (0.0, 1.0, 2.0, 3.0)


def test_projections(one):
    from landgrid.kernel.projection import from_zone, to_zone

    east, north = one(*measure.gauss_kruger(F.lit(116.5), F.lit(39.9), F.lit(117.0)))
    assert math.isclose(east, to_zone(116.5, 39.9, 117.0)[0], abs_tol=1e-6) and math.isclose(north, to_zone(116.5, 39.9, 117.0)[1], abs_tol=1e-6)
    lon, lat = from_zone(east, north, 117.0)
    assert math.isclose(lon, 116.5, abs_tol=1e-9) and math.isclose(lat, 39.9, abs_tol=1e-9)
    x, y = one(*measure.web_mercator(F.lit(116.5), F.lit(39.9)))
    assert one(*(F.round(c, 9) for c in measure.from_web_mercator(F.lit(x), F.lit(y)))) == (116.5, 39.9)
