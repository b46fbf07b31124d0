"""Validity, and cuts, of many polygons at once against those of one at a time."""

import random

import pytest

from landgrid.functions import st
from landgrid.kernel import batch, codecs, model, ops, valid


def rings(n: int, unit: float, points: int = 30) -> list[model.Geometry]:
    rng = random.Random(n)
    return [model.polygon([(rng.randrange(points) * unit, rng.randrange(points) * unit) for _ in range(n)]) for _ in range(250)]


@pytest.mark.parametrize("unit", [1.0, 0.0117])
@pytest.mark.parametrize(("n", "least"), [(3, 240), (4, 240), (5, 140), (6, 80)])
def test_validity_of_many_is_that_of_each(n, least, unit):
    given = rings(n, unit)
    raws, made, simple = [codecs.to_wkb(g) for g in given], [None] * len(given), [None] * len(given)
    for places, alike in batch.alike(raws):
        for i, v, s in zip(places.tolist(), valid.made_valid(alike), valid.simple(alike)):
            made[i], simple[i] = v, s
    told = [i for i, v in enumerate(made) if v is not None]
    assert len(told) >= least and [made[i] for i in told] == [codecs.to_wkb(ops.make_valid(given[i])) for i in told]
    clear = [i for i, s in enumerate(simple) if s is not None]
    assert len(clear) >= 225 and [simple[i] for i in clear] == [ops.is_simple(given[i]) for i in clear]
    # what was made valid is simple
    for _, alike in batch.alike([made[i] for i in told]):
        assert False not in valid.simple(alike)


def test_simple_shapes_of_several_polygons():
    rng, seen = random.Random(7), {True: 0, False: 0}
    given = [model.of_polygons([model.polygon([(rng.randrange(12), rng.randrange(12)) for _ in range(3)]).data for _ in range(rng.choice((2, 3)))]) for _ in range(600)]
    given += [codecs.from_wkt("MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0)), ((2 2, 4 2, 4 4, 2 2)))"), codecs.from_wkt("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 4 2, 4 4, 2 2))")]
    for places, alike in batch.alike([codecs.to_wkb(g) for g in given]):
        for i, s in zip(places.tolist(), valid.simple(alike)):
            if s is not None:
                seen[s] += 1
                assert s == ops.is_simple(given[i]), given[i]
    assert min(seen.values()) > 50


def test_columns_made_valid(spark):
    texts = ["POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))", "polygon((0 0,4 4,4 0,0 4))", " POLYGON  (( 1e0 +1, 5. 5, 5 .5, 1 5, 1 1 ))", "POLYGON ((0 0, 2 0, 2 1, 2 0, 0 0))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",
        "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0)), ((5 5, 9 5, 9 9, 5 5)))", "POLYGON EMPTY", "POINT (1 2)", "LINESTRING (0 0, 0 0, 1 1)", "POLYGON Z ((0 0 1, 4 4 1, 4 0 1, 0 4 1, 0 0 1))", "POLYGON ((0 0, 0 0, 0 0, 0 0))", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).withColumn("g", st.st_from_wkt("t"))
    found = {r.i: r for r in df.select("i", "g", st.st_make_valid("g").alias("v"), st.st_is_simple("g").alias("s")).collect()}
    for i, t in enumerate(texts):
        g = None if t is None else codecs.from_wkt(t)
        assert (None if found[i].g is None else bytes(found[i].g)) == (None if g is None else codecs.to_wkb(g)), t
        assert (None if found[i].v is None else bytes(found[i].v)) == (None if g is None else codecs.to_wkb(ops.make_valid(g))), t
        assert found[i].s == (None if g is None else ops.is_simple(g)), t


def test_texts_of_alike_rings():
    texts = [f"POLYGON (({i} 0, 4 {i}.5, -4e-1 0, {i} 0), (1 1, 2 1, 2 2, 1 1))" for i in range(5)] + ["POLYGON ((1 2 3, 4 5 6, 1 2 3))", "POLYGON ((0 0, 1 1, 1 0), (1 1, 2 1, 2 2, 1 1))", "POLYGON ((0 0, 1 1, 1_0 0, 0 0))", None, ""]
    made = batch.of_texts(texts, lambda t: codecs.to_wkb(codecs.from_wkt(t)))
    assert made[:5] == [codecs.to_wkb(codecs.from_wkt(t)) for t in texts[:5]] and made[5:] == [None] * 5
    for bad in ("POLYGON ((0 0, 1 1)", "POLYGON ((0 0, 1, 1 0, 0 0))"):
        assert batch.of_texts([bad], lambda t: b"") == [None]
