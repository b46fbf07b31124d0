"""Features that share a row key, and clips by boxes that go together."""

import operator
import random

import duckdb

from landgrid.functions import st
from landgrid.kernel import codecs, model, ops
from landgrid.kernel.pairs import pairs_of
from landgrid.plans import queries


def test_polygon_cut_counts_rows_that_share_a_key(spark, data, tmp_path):
    customers = spark.read.parquet(f"{data}/customer.parquet")
    customers.unionByName(customers.limit(100)).write.parquet(f"{tmp_path}/customer.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    wanted = connection.sql(queries.ORACLE_SQL["polygon_cut"]).fetchall()
    assert [tuple(r) for r in queries.polygon_cut(spark, str(tmp_path)).select("area", "features").collect()] == wanted


def test_clips_together_are_those_one_by_one(spark):
    rng, rows = random.Random(5), []
    for i in range(300):
        x, y, w, h = (rng.randrange(1, 9) for _ in range(4))
        shape = model.box(x, y, x + w, y + h) if i % 3 else model.polygon([(x, y), (x + w, y), (x, y + h)])
        box = (float(a := rng.randrange(9)), float(b := rng.randrange(9)), a + rng.randrange(1, 9) + 0.0, b + rng.randrange(1, 9) + 0.0)
        rows.append((i, bytearray(codecs.to_wkb(shape)), *box))
    rows += [(300, None, 0.0, 0.0, 1.0, 1.0), (301, rows[0][1], None, 0.0, 1.0, 1.0)]
    given = spark.createDataFrame(rows, "i int, geom binary, a double, b double, c double, d double")
    found = {r["i"]: r["p"] for r in given.select("i", st.st_clip_by_box("geom", "a", "b", "c", "d").alias("p")).collect()}
    assert found[300] is None and found[301] is None
    for i, raw, *box in rows[:300]:
        got, want = codecs.from_wkb(bytes(found[i])), ops.clip_box(codecs.from_wkb(bytes(raw)), *box)
        assert (got.kind, set(got.coords())) == (want.kind, set(want.coords())) and ops.area(got) == ops.area(want)


def test_results_keep_the_coordinates_given():
    x0, x1, cut = 116.2003, 116.3127, 117.15 - 0.8496
    made = [None]
    pairs_of([codecs.to_wkb(model.box(x0, 39.1, x1, 39.2))], [codecs.to_wkb(model.box(cut, 39.0, 120.0, 40.0))]).made(operator.and_, made)
    assert codecs.from_wkb(made[0]).envelope() == (cut, 39.1, x1, 39.2)
