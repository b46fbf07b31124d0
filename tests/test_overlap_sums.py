"""Sums of common areas against those of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landgrid.kernel import boxes
from landgrid.operators import jobs, spatial

CLASSED = "category string, x0 bigint, y0 bigint, x1 bigint, y1 bigint"


def rectangles(rng: random.Random, n: int, names: list, span: int = 3000, turned: bool = False) -> list[tuple]:
    out = []
    for _ in range(n):
        x, y = rng.randrange(-span, span), rng.randrange(-span, span)
        out.append((rng.choice(names), x, y, x + rng.randrange(-200 if turned else 1, 900), y + rng.randrange(-200 if turned else 1, 900)))
    return out


def layers(spark, left: list, right: list):
    a = spark.createDataFrame(left, CLASSED)
    b = spark.createDataFrame(right, CLASSED.replace("category", "region"))
    return a, b.select("region", *(F.col(c).alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"))))


@pytest.mark.parametrize("turned", [False, True])
def test_sums_are_those_of_all_pairs(spark, turned):
    rng = random.Random(3)
    left = rectangles(rng, 300, ["a", "b", None, "c"], turned=turned)
    left, right = left + left[:100], rectangles(rng, 300, ["r", "s", None], turned=turned)
    want: dict = {}
    for c, x0, y0, x1, y1 in left:
        for r, u0, v0, u1, v1 in right:
            if x0 < u1 and u0 < x1 and y0 < v1 and v0 < y1:  # as the SQL, where corners have changed sides too
                want[c, r] = want.get((c, r), 0) + (min(x1, u1) - max(x0, u0)) * (min(y1, v1) - max(y0, v0))
    a, b = layers(spark, [*left, ("a", None, 1, 2, 3)], right)
    assert {(r[0], r[1]): r[2] for r in spatial.overlap_sums(a, b, "category", "region").collect()} == want and len(want) == 12


def test_copies_in_one_place_are_no_pairs(spark):
    many = spark.range(60_000).select(F.concat(F.lit("c"), F.col("id") % 2).alias("category"), F.lit("r").alias("region12"), *(F.lit(v).cast("bigint").alias(c) for c, v in (("x0", 400), ("y0", 400), ("x1", 600), ("y1", 700))))
    sums = jobs.area_statistics(many, many)
    assert "Join" not in sums._jdf.queryExecution().toString()
    assert sorted(map(tuple, sums.collect())) == [("r", c, 30_000 * 60_000 * 60_000) for c in ("c0", "c1")]
    assert sums.columns == ["region", "category", "area"]


def test_dense_cells_are_added_up():
    rng = np.random.default_rng(5)
    sides = []
    for n, classes in ((4000, 2), (3000, 3)):
        low = rng.integers(-30, 90, (n, 2))
        sides.append((np.concatenate([low, low + rng.integers(1, 60, (n, 2))], axis=1), rng.integers(1, 4, n), rng.integers(0, classes, n)))
    (p, p_n, p_kind), (q, q_n, q_kind) = sides
    sums, want = boxes.Sums(50), np.zeros((2, 3), np.int64)
    for s, k in ((0, 2), (1, 3)):
        sums.numbers(s, pa.array(range(k)))
    sums._compared = None  # all classes are dense enough
    wide, high = (np.clip(np.minimum(p[:, None, k + 2], q[:, k + 2]).clip(max=50) - np.maximum(p[:, None, k], q[:, k]).clip(min=0), 0, None) for k in (0, 1))
    sums.add(0, 0, *sides)
    np.add.at(want, (p_kind[:, None].repeat(len(q), 1), q_kind[None].repeat(len(p), 0)), wide * high * p_n[:, None] * q_n)
    assert (sums.area[:2, :3] == want).all() and sorted(sums.rows()) == [(i, j, int(want[i, j])) for i in range(2) for j in range(3)]


def test_cells_over_several_batches_and_many_classes():
    schema = pa.schema([("category", pa.int64()), ("region", pa.string()), ("area", pa.int64())])
    rows = [(0, c, s, k if s == 0 else None, None if s == 0 else f"r{k}", c * 10, 0, c * 10 + 5, 5, 2) for c in range(3) for k in range(40) for s in (0, 1)]
    names = ["cell_row", "cell_col", "side", "category", "region", "x0", "y0", "x1", "y1", "times"]
    table = pa.table({n: pa.array(v, pa.string() if n == "region" else pa.int64()) for n, v in zip(names, zip(*rows))})
    found = pa.Table.from_batches(boxes.sums_of(table.to_batches(max_chunksize=7), 10, schema), schema)
    assert found.num_rows == 1600 and set(found["area"].to_pylist()) == {3 * 25 * 4}
    assert not list(boxes.sums_of([], 10, schema))
