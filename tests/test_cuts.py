"""Cuts of many polygons along the axes at once against those of one at a time."""

import random

import pytest

from pyspark.sql import functions as F

from landgrid.functions import st
from landgrid.kernel import codecs, model, ops
from landgrid.kernel.cuts import cuts
from landgrid.plans import queries, shape_queries  # noqa: F401


def couples(n: int, unit: float) -> list:
    rng, out = random.Random(2), []
    for _ in range(n):
        x, y, w, h = rng.randrange(6), rng.randrange(6), rng.randrange(3, 9), rng.randrange(3, 9)
        corner = [(x, y), (x + w, y), (x + w, y + 1), (x + 1, y + 1), (x + 1, y + h), (x, y + h)]
        hole = [(x + 1, y + 1), (x + 1, y + h - 1), (x + w - 1, y + h - 1), (x + w - 1, y + 1)]
        box = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        g = rng.choice((model.polygon(corner), model.polygon(box), model.polygon(box, hole)))
        x, y, d = rng.randrange(14), rng.randrange(14), rng.choice((-20, -3, 3, 20, 1))
        c = model.line([(x, y - d), (x, y + d)] if rng.random() < 0.5 else [(x - d, y), (x + d, y)])
        out.append(tuple(s.map(lambda v: (v[0] * unit, v[1] * unit)) for s in (g, c)))
    return out


@pytest.mark.parametrize("unit", [1.0, 0.0117])
def test_cuts_of_many_are_those_of_each(unit):
    given = couples(800, unit)
    made = cuts(*([codecs.to_wkb(p[k]) for p in given] for k in (0, 1)))
    told = [i for i, m in enumerate(made) if m is not None]
    assert len(told) > 700 and sum(made[i][0][0] != "uncut" for i in told) > 80
    in_order = (lambda parts: parts) if unit == 1.0 else sorted  # parts of one size may change places by rounding
    for i in told:
        assert in_order(made[i]) == in_order([(side, codecs.to_wkb(part)) for side, part in ops.cut(*given[i])]), given[i]


def test_columns_cut(spark):
    given = couples(60, 1.0)
    given += [(codecs.from_wkt(a), codecs.from_wkt(b)) for a, b in (("POLYGON ((0 0, 4 0, 0 4, 0 0))", "LINESTRING (1 -1, 1 5)"), ("LINESTRING (0 0, 4 0)", "LINESTRING (1 -1, 1 5)"), ("POLYGON EMPTY", "LINESTRING (1 -1, 1 5)"),
        ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "LINESTRING (-1 1, 2 1, 2 9)"), ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "LINESTRING (0 0, 4 4)"), ("POLYGON Z ((0 0 1, 4 0 1, 4 4 1, 0 4 1, 0 0 1))", "LINESTRING (1 -1, 1 5)"))]
    rows = [(i, *(bytearray(codecs.to_wkb(g)) for g in p)) for i, p in enumerate(given)] + [(999, bytearray(codecs.to_wkb(given[0][0])), None)]
    df = spark.createDataFrame(rows, "i int, a binary, b binary").coalesce(1).select("i", st.st_cut("a", "b").alias("p"))
    assert df.schema["p"].dataType == st.PARTS
    found = {r.i: r.p for r in df.collect()}
    for i, p in enumerate(given):
        assert [(r.side, bytes(r.geom)) for r in found[i]] == [(side, codecs.to_wkb(part)) for side, part in ops.cut(*p)], i
    assert found[999] is None


def test_areas_of_arrays(spark):
    shapes = [codecs.from_wkt(t) for t in ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON Z ((0 0 1, 4 0 1, 0 4 1, 0 0 1))", "POLYGON EMPTY", "LINESTRING (0 0, 1 1)")]
    raws = [bytearray(codecs.to_wkb(g)) for g in shapes]
    df = spark.createDataFrame([(1, raws), (2, None), (3, []), (4, [raws[1], None, raws[0]])], "i int, g array<binary>").coalesce(1)
    assert {r.i: r.a for r in df.select("i", st.st_areas("g").alias("a")).collect()} == {1: [16.0, 8.0, 0.0, 0.0], 2: None, 3: [], 4: [8.0, None, 16.0]}


def test_rows_of_one_key_are_cut_each(spark, tmp_path):
    spark.createDataFrame([(7, "a"), (7, "b"), (8, "c")], "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    found = shape_queries.concave_cut(spark, str(tmp_path)).groupBy("k", "both", "lower").agg(F.count("*").alias("n")).collect()
    w, h = {k: 50 + k * 31 % 450 for k in (7, 8)}, {k: 50 + k * 17 % 450 for k in (7, 8)}
    assert {tuple(r) for r in found} == {(k, w[k] * 25 + 25 * (h[k] - 25), (w[k] - 25) * 25, n) for k, n in ((7, 2), (8, 1))}
