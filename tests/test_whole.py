"""Registered queries run over their whole tables."""

import math

import pyarrow.parquet as pq
import pytest

from landgrid.plans import queries, synth


@pytest.mark.parametrize("name, column", [("point_cells", "k"), ("sheets_in_range", "k"), ("st_tiles", "rowkey")])
def test_every_feature_has_rows(spark, data, name, column):
    assert queries.QUERIES[name](spark, data).select(column).distinct().count() == pq.read_metadata(f"{data}/customer.parquet").num_rows


def test_every_event_is_mapped(spark, data):
    assert queries.property_map(spark, data).count() == pq.read_metadata(f"{data}/events.parquet").num_rows


def test_buffers_and_offset_curves_of_every_rectangle(spark, data):
    sides = {r["rowkey"]: (r["x1"] - r["x0"], r["y1"] - r["y0"]) for r in synth.layer(spark, data, 1).collect()}
    assert len(sides) == pq.read_metadata(f"{data}/customer.parquet").num_rows
    around = {"round": 4 * 24 * 40 * math.sin(math.pi / 96), "bevel": 80 * math.sqrt(2), "miter": 160, "square": 320 * math.tan(math.pi / 8)}
    curves = {r["rowkey"]: r for r in queries.st_offset_curve(spark, data).collect()}
    assert set(curves) == set(sides)
    for key, (w, h) in sides.items():
        assert all(math.isclose(curves[key][join], 2 * (w + h) + more, abs_tol=2e-3) for join, more in around.items())
    assert {r["rowkey"] for r in queries.st_buffer(spark, data).select("rowkey").collect()} == set(sides)
