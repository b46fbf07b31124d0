"""Affine transforms, spatial references and table administration."""

import math

import pytest
from pyspark.sql import functions as F

from landgrid.functions import reference
from landgrid.functions.affine import Affine
from landgrid.plans.cover import cell_box, coarse, cover, z_value
from landgrid.sources import admin


def test_affine():
    t = Affine.rotate(0.3, (1, 2)).then(Affine.scale(2, 3)).then(Affine.shear(0.5, 0)).then(Affine.shift(4, 5))
    x, y = t.on(7, 8)
    assert all(math.isclose(a, b) for a, b in zip(t.inverse().on(x, y), (7, 8)))
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(Affine.rotate(math.pi / 2).on(1, 0), (0, 1)))
    assert Affine.flip_x(0, 10).on(3, 1) == (7, 1) and Affine.flip_y(0, 10).on(3, 1) == (3, 9)
    assert Affine.box_to_box((0, 0, 2, 4), (10, 10, 20, 30)).on(1, 1) == (15, 15)
    with pytest.raises(ValueError):
        Affine.scale(0, 1).inverse()


def test_references(spark):
    row = spark.range(1).select(reference.tolerance(F.lit(4490)).alias("a"), reference.tolerance(F.lit(1)).alias("b"), reference.current_wkid(F.lit(102100), {102100: 3857}).alias("c"), reference.current_wkid(F.lit(5), {}).alias("d")).first()
    assert tuple(row) == (1e-8, 1e-10, 3857, 5) and reference.tolerance_of(None) == 1e-10


def test_admin(spark):
    admin.create_database(spark, "lg")
    admin.create_feature_table(spark, "lg.features")
    admin.create_index_table(spark, "lg.idx")
    assert admin.tables(spark, "lg") == ["features", "idx"] and admin.exists(spark, "lg.idx")
    rows = admin.sample_rows(spark, 1, 5, ["a", "b"])
    admin.put(spark, "lg.t", rows)
    admin.put(spark, "lg.t", admin.sample_rows(spark, 6, 7, ["a", "b"], random=True))
    assert spark.table("lg.t").count() == 7
    assert {tuple(r) for r in admin.dump(spark, "lg.t", ["2"]).collect()} == {("2", "a", "2"), ("2", "b", "2")}
    admin.drop_table(spark, "lg.t")
    assert not admin.exists(spark, "lg.t")
    admin.drop_database(spark, "lg", with_tables=True)


def test_covers_hold_all_cells_of_an_area():
    area = (116.3, 39.3, 117.1, 40.1)
    ranges = cover(area)
    spans = coarse(ranges)
    assert len(spans) <= 8
    for level in (1, 5, 9, 12, 14):
        size = 360 / 2**level
        for x, y in ((116.31, 39.31), (117.09, 40.09), (116.7, 39.7)):
            row, col = int((180 - y) / size), int(x / size)
            key = z_value(level, row, col)
            hit = [r for r in ranges if r.low <= key <= r.high]
            assert hit and any(a <= key <= b for a, b in spans)
            box = cell_box(level, row, col)
            if any(r.inside for r in hit):
                assert area[0] <= box[0] and box[2] <= area[2] and area[1] <= box[1] and box[3] <= area[3]
