"""Functions that no registered query uses."""

import math

from pyspark.sql import functions as F

from landgrid.functions import codes, grid, sheets, st, text
from landgrid.operators import raster, stats
from landgrid.sources import records, sinks


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_geometry_accessors(spark):
    rings = st.st_from_wkt(F.lit("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))"))
    path = st.st_from_wkt(F.lit("LINESTRING Z (0 0 1, 3 4 2)"))
    many = st.st_from_wkt(F.lit("MULTIPOINT ((1 2), (3 4))"))
    wkt = st.st_as_wkt
    assert one(spark, st.st_num_interior_rings(rings), wkt(st.st_interior_ring_n(rings, 1)), wkt(st.st_exterior_ring(rings)), st.st_is_simple(rings)) == (1, "LINESTRING (1 1, 1 2, 2 2, 2 1, 1 1)", "LINESTRING (0 0, 4 0, 4 4, 0 4, 0 0)", True)
    assert one(spark, st.st_coord_dimension(path), wkt(st.st_start_point(path)), st.st_z(st.st_end_point(path)), st.st_m(st.st_end_point(path)), st.st_srid(path)) == (3, "POINT Z (0 0 1)", 2.0, None, 0)
    assert one(spark, wkt(st.st_geometry_n(many, 2)), wkt(st.st_geometry_n(many, 3)), wkt(st.st_to_multi(path))) == ("POINT (3 4)", None, "MULTILINESTRING Z ((0 0 1, 3 4 2))")
    centre, points = one(spark, st.st_centroid(st.st_make_envelope(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(4.0))), st.st_points(path))
    assert tuple(centre) == (1.0, 2.0) and [tuple(p) for p in points] == [(0.0, 0.0), (3.0, 4.0)]
    assert one(spark, wkt(st.st_make_valid(st.st_from_wkt(F.lit("LINESTRING (0 0, 0 0, 1 1)")))), st.st_x(st.st_point(F.lit(1.5), F.lit(2.5))), st.st_y(st.st_point(F.lit(1.5), F.lit(2.5)))) == ("LINESTRING (0 0, 1 1)", 1.5, 2.5)


def test_geometry_from_points_and_projections(spark):
    corners = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((116, 39), (117, 39), (117, 40))))
    triangle = st.st_make_polygon(corners)
    assert one(spark, st.st_area(triangle), st.st_num_points(triangle), st.st_num_points(st.st_make_line(corners))) == (0.5, 4, 3)
    metric = st.st_to_zone(triangle, F.lit(117))
    area, back, mercator = one(spark, st.st_area(metric), st.st_area(st.st_from_zone(metric, F.lit(117))), st.st_area(st.st_from_mercator(st.st_to_mercator(triangle))))
    assert math.isclose(back, 0.5, abs_tol=1e-9) and math.isclose(mercator, 0.5, abs_tol=1e-9) and math.isclose(area, 4.77e9, rel_tol=0.02)


def test_codes_grid_and_sheets(spark):
    assert one(spark, codes.region_parent(F.lit("330110")), codes.region_parent(F.lit("330100")), codes.region_upper(F.lit("330100")), codes.region_contains(F.lit("330000"), F.lit("330110"))) == ("330100", "330000", "330200", True)
    assert sorted(one(spark, grid.children(F.lit(1), F.lit(0), F.lit(0)))[0]) == sorted(one(spark, *(grid.z_encode(2, F.lit(r), F.lit(c)) for r in (0, 1) for c in (0, 1))))
    affine = F.array(*map(F.lit, (100.0, 10.0, 0.0, 500.0, 0.0, -10.0)))
    x, y = grid.pixel_to_world(affine, F.lit(2.0), F.lit(3.0))
    assert one(spark, x, y, *grid.world_to_pixel(affine, F.lit(134.0), F.lit(476.0))) == (130.0, 480.0, 2, 3)
    assert one(spark, sheets.sheet_scale(F.lit("J50E001011"))) == (50_000,)
    assert tuple(one(spark, text.parse_point(text.format_point(F.lit(1.5), F.lit(2.0))))[0]) == (1.5, 2.0)


def test_rasters(spark):
    sheets_table = spark.createDataFrame([("s", [0.0, 10.0, 0.0, 0.0, 0.0, -10.0], 2, 2, [1.0, 20000.0, 3.0, -10000.0])], "sheet string, geotransform array<double>, n_rows int, n_cols int, data array<float>")
    cells = raster.explode_raster(sheets_table)
    assert sorted((r["row"], r["col"], r["height"]) for r in cells.collect()) == [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 3.0), (1, 1, 0.0)]
    total = raster.total_surface(raster.cell_surfaces(cells, 10.0, "sheet"), "sheet").first()
    assert total["cells"] == 4 and total["surface"] >= 400


def test_logs_and_files(spark, tmp_path):
    log = spark.createDataFrame([("S",), ("E",), ("S",)], "status string")
    assert {tuple(r) for r in stats.outcome_counts(log).collect()} == {("S", 2), ("E", 1)}
    for i in range(4):
        (tmp_path / f"{i}.txt").write_text("a\nb\n")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    assert records.small_files(spark, str(tmp_path)).count() == 8
    spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_sheet_ingest(spark, tmp_path):
    table = spark.range(1).select(F.lit("k").alias("rowkey"), F.lit("0111").alias("category"), *(F.lit(v).alias(c) for c, v in zip(("xmin", "ymin", "xmax", "ymax"), (116.1, 39.6, 116.4, 39.9))))
    table = table.withColumn("geom", st.st_make_envelope("xmin", "ymin", "xmax", "ymax"))
    written = sinks.ingest_sheets(table, str(tmp_path / "sheets"), sheets.scale_of("E")).collect()
    assert len(written) == 6 and all(r["n"] == 1 for r in written)
