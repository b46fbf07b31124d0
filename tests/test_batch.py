"""Measures of many polygons at once against those of one at a time, stored tables, and bounded results."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgrid.functions import st
from landgrid.kernel import batch, codecs, model, ops
from landgrid.sources import sinks
from landgrid.sources.store import stored_once


def shapes(n: int = 200) -> list:
    rng = random.Random(3)
    out: list = [None]
    for _ in range(n):
        x, y, w, h = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(1, 9), rng.uniform(1, 9)
        ring = [(x, y), (x + w, y + rng.random()), (x + w, y + h)] + ([(x, y + h)] if rng.random() < 0.5 else [])
        out.append(model.polygon(ring))
    out.append(codecs.from_wkt("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"))
    out.append(codecs.from_wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 7 5, 7 7, 5 5)))"))
    out += [codecs.from_wkt(t) for t in ("POINT (1 2)", "LINESTRING (0 0, 3 4)", "POLYGON EMPTY", "POLYGON Z ((0 0 1, 1 0 1, 1 1 1, 0 0 1))")]
    return out


def test_measures_of_many_are_those_of_each():
    given = shapes()
    raws = [None if g is None else codecs.to_wkb(g) for g in given]
    seen = set()
    for places, xy in batch.one_ring(raws):
        for i, a, n, e in zip(places.tolist(), batch.areas(xy), batch.lengths(xy), batch.envelopes(xy)):
            assert a == pytest.approx(ops.area(given[i])) and n == pytest.approx(ops.length(given[i])) and tuple(e) == given[i].envelope()
            seen.add(i)
    assert seen == set(range(1, 201))
    assert batch.boxes([1.0], [2], [3], [4]) == [codecs.to_wkb(model.box(1.0, 2.0, 3.0, 4.0))]


def test_columns_of_mixed_shapes(spark):
    given = shapes(20)
    docs = spark.createDataFrame([(i, None if g is None else bytearray(codecs.to_wkb(g))) for i, g in enumerate(given)], "i int, g binary")
    found = {r.i: r for r in docs.select("i", st.st_area("g").alias("a"), st.st_length("g").alias("n"), st.st_envelope("g").alias("e")).collect()}
    for i, g in enumerate(given):
        if g is None:
            assert found[i].a is None and found[i].n is None
            continue
        assert found[i].a == pytest.approx(ops.area(g)) and found[i].n == pytest.approx(ops.length(g))
        assert (found[i].e.xmin, found[i].e.ymax) == ((g.envelope()[0], g.envelope()[3]) if g.envelope() else (None, None))
    made = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (None, 2.0, 3.0, 4.0)], "a double, b double, c double, d double").select(st.st_make_envelope("a", "b", "c", "d").alias("g")).collect()
    assert bytes(made[0].g) == codecs.to_wkb(model.box(1.0, 2.0, 3.0, 4.0)) and made[1].g is None


def test_unions_of_far_shapes_are_those_of_all():
    rng = np.random.default_rng(2)
    boxes = [model.box(x, y, x + w, y + h) for x, y, w, h in rng.integers(1, 60, (80, 4)).astype(float)] + [model.box(500.0, 500.0, 510.0, 510.0), model.box(510.0, 510.0, 520.0, 520.0)]
    merged = ops.union(*boxes)
    inside = np.zeros((600, 600), bool)
    for b in boxes:
        x0, y0, x1, y1 = map(int, b.envelope())
        inside[x0:x1, y0:y1] = True
    assert ops.area(merged) == pytest.approx(inside.sum())
    groups = ops._apart(boxes, 1e-9)
    assert sorted(map(len, groups))[0] == 2 and sum(map(len, groups)) == len(boxes)


def test_dissolving_by_place(spark):
    rng = random.Random(4)
    rows = [(i % 2, float(x), float(y)) for i in range(300) for x, y in [(rng.randrange(300), rng.randrange(300))]] + [(1, 7.0, 7.0)] * 40
    boxes = spark.createDataFrame(rows, "key int, x double, y double").withColumn("geom", st.st_make_envelope("x", "y", F.col("x") + 9, F.col("y") + 9))
    found = {r.key: r.a for r in st.dissolve(boxes, ["key"], group=6).select("key", st.st_area("geom").alias("a")).collect()}
    for key in (0, 1):
        inside = np.zeros((320, 320), bool)
        for k, x, y in rows:
            if k == key:
                inside[int(x) : int(x) + 9, int(y) : int(y) + 9] = True
        assert found[key] == pytest.approx(inside.sum())


def test_results_beyond_their_bound_are_an_error(spark):
    assert sorted(r["id"] for r in json.loads(sinks.result_json(spark.range(3), at_most=3))) == [0, 1, 2]
    with pytest.raises(ValueError):
        sinks.result_json(spark.range(4), at_most=3)


def test_tables_are_stored_once(spark):
    times = []

    def write(path):
        times.append(path)
        spark.range(5).write.parquet(path)

    assert [stored_once(spark, "here", "five", write).count() for _ in range(2)] == [5, 5] and len(times) == 1
