"""Areas of boxes by expressions against those of the parts, for boxes, copies, sides that touch and other shapes."""

import random

import pytest

from landgrid.functions import st
from landgrid.kernel import codecs, model
from landgrid.operators import overlay
from landgrid.plans import queries


def layer(spark, name, n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        x, y, w, h = 116 + rng.randrange(5) * 0.1, 39 + rng.randrange(5) * 0.1, 0.1 * rng.randrange(1, 4), 0.1 * rng.randrange(1, 4)
        shape = model.polygon([(x, y), (x + w, y), (x, y + h)]) if i % 6 == 0 else model.box(x, y, x + w, y + h)
        rows += [(f"{i % 4}", bytearray(codecs.to_wkb(shape)), *shape.envelope())] * (1 + i % 2)
    return spark.createDataFrame(rows, f"{name} string, geom binary, xmin double, ymin double, xmax double, ymax double")


def test_areas_are_those_of_the_parts(spark):
    features, regions = layer(spark, "category", 18, 1), layer(spark, "region", 12, 2)
    one = {(r["region"], r["category"]): r["area"] for r in overlay.area_statistics(features, regions, size=0.25).collect()}
    each = {(r["region"], r["category"]): r["area"] for r in overlay.area_statistics(features, regions, measure=st.st_area("part"), size=0.25).collect()}
    assert set(one) == set(each) and all(one[k] == pytest.approx(v, abs=1e-9) for k, v in each.items())


def test_boxes_go_without_their_geometry(spark, data):
    """Of the three joins, the one of boxes sums no parts from Python."""
    plan = queries.area_statistics(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    first = plan.split("Join Inner")[0]
    assert "Python" not in first and "geom" not in first
