"""Pairs of boxes and frames by expressions against the geometry functions."""

import random

import pytest
from pyspark.sql import functions as F

from landgrid.functions import st
from landgrid.kernel import codecs, model
from landgrid.operators import framed, jobs
from landgrid.plans import queries

PAIR = ("rowkey", "other")
RELATIONS = {n: n for n in ("intersects", "disjoint", "touches", "contains", "within", "overlaps", "equals")}
AREAS = {n: n for n in ("intersection", "union", "difference", "sym_difference")}


def layers(spark, kinds, unit=1):
    """Boxes, frames and other shapes on few coordinates, some of them twice."""
    rng, sides = random.Random(3), []
    for side in (0, 1):
        rows = []
        for i in range(12):
            x, y, w, h = rng.randrange(5), rng.randrange(5), rng.randrange(3, 8), rng.randrange(3, 8)
            rim = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
            kind = kinds[side][i % len(kinds[side])]
            holes = [[(x + 1, y + 1), (x + 1, y + h - 1), (x + w - 1, y + h - 1), (x + w - 1, y + 1)]] if kind == "frame" else []
            shape = model.polygon(rim[:3] if kind == "other" else rim, *holes).map(lambda c: (c[0] * unit, c[1] * unit))
            rows.append((f"{i // 2}", bytearray(codecs.to_wkb(shape)), x, y, x + w, y + h))
        sides.append(spark.createDataFrame(rows, "rowkey string, geom binary, x0 bigint, y0 bigint, x1 bigint, y1 bigint"))
    return sides[0], jobs.other(sides[1], rowkey="other", geom="geom2")


def wanted(a, b, columns):
    return sorted(framed.overlap_join(a, b).select(*PAIR, *columns).toPandas().itertuples(index=False, name=None))


def found(df):
    return sorted(df.toPandas().itertuples(index=False, name=None))


@pytest.mark.parametrize("kinds, holes, unit", [(("box", "other"), (False, False), 1), (("box", "frame", "other"), (True, True), 1)])
def test_pairs_of_frames_are_those_of_shapes(spark, kinds, holes, unit):
    a, b = layers(spark, (kinds, kinds[::-1]), unit)
    g = ("geom", "geom2")
    assert found(framed.relations(a, b, PAIR, holes, **RELATIONS)) == wanted(a, b, [getattr(st, f"st_{n}")(*g).alias(n) for n in RELATIONS])
    assert found(framed.areas(a, b, PAIR, holes, **AREAS)) == wanted(a, b, [F.round(st.st_area(getattr(st, f"st_{n}")(*g))).cast("bigint").alias(n) for n in AREAS])
    if not any(holes):
        assert found(framed.relations(a, b, PAIR, m="relate_matrix", r=("relate", "T*T***T**"))) == wanted(a, b, [st.st_relate_matrix(*g).alias("m"), st.st_relate(*g, "T*T***T**").alias("r")])


def test_boxes_that_only_touch_or_are_apart(spark):
    """Pairs that no overlap join has, by the expressions themselves."""
    a, b = layers(spark, (("box",), ("box",)))
    corners = [F.col(f"f.{c}") for c in ("x0", "y0", "x1", "y1")]
    a, b = (s.withColumn("f", st.st_frame(g)).select(g, *(c.alias(n) for c, n in zip(corners, names))) for s, g, names in ((a, "geom", framed.LEFT), (b, "geom2", framed.RIGHT)))
    moved = b.withColumns({n: F.col(n) + 4 for n in framed.RIGHT}).withColumn("geom2", st.st_make_envelope(*framed.RIGHT))
    rows = a.crossJoin(moved).select(framed.Pair((False, False)).kind().alias("kind"), st.st_relate_matrix("geom", "geom2").alias("m")).distinct().collect()
    assert all(framed.MATRICES[r["kind"]] == r["m"] for r in rows) and {r["m"] for r in rows} >= {"FF2FF1212", "FF2F01212", "FF2F11212"}


@pytest.mark.parametrize("name", ["st_relate", "st_set_operations", "st_relations", "frame_set_operations", "frame_relations"])
def test_no_pair_of_frames_goes_to_python(spark, data, name):
    """One of the three joins has no Python worker above it, and geometries in none of its columns."""
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan()
    above = plan.children().apply(0).toString().split("Join Inner")[0]
    assert "Python" not in above and "geom" not in above
