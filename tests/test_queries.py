"""Every registered query of the library against its SQL in DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from landgrid.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


def rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, duck, name):
    found = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.ORACLE_SQL:
        wanted = duck.sql(queries.ORACLE_SQL[name]).df()
        columns = sorted(found.columns)
        assert columns == sorted(wanted.columns)
        assert rows(found, columns) == rows(wanted, columns)
    else:
        assert len(found) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_join_finds_what_testing_all_finds(spark, data):
    from landgrid.operators import jobs, spatial
    from landgrid.plans import synth

    a = synth.layer(spark, data, 1).select("rowkey", "x0", "y0", "x1", "y1")
    b = jobs.other(synth.layer(spark, data, 2), rowkey="other")
    key = ["rowkey", "other", "overlap"]
    by_all = lambda left, right: left.join(right, F.expr("x0 < u1 and u0 < x1 and y0 < v1 and v0 < y1")).withColumn("overlap", spatial.overlap_area())
    found, wanted = ({tuple(r) for r in f(a, b).select(*key).collect()} for f in (spatial.overlap_join, by_all))
    assert found == wanted and len(found) == 20 and sum(r[2] for r in found) == 511282


def test_index_finds_what_a_scan_finds(spark, data):
    from landgrid.operators import spatial
    from landgrid.plans import synth

    layer = spatial.with_index(synth.degrees(synth.layer(spark, data, 1)))
    index = spatial.build_index(layer)
    for area in ((116.3, 39.3, 117.15, 40.12), (116.0, 39.0, 118.0, 41.0), (117.0, 39.5, 117.01, 39.51)):
        wanted = {r[0] for r in layer.filter(f"xmin <= {area[2]} and xmax >= {area[0]} and ymin <= {area[3]} and ymax >= {area[1]}").select("rowkey").collect()}
        assert {r[0] for r in spatial.box_query(layer, area).select("rowkey").collect()} == wanted
        assert wanted <= {r[0] for r in spatial.index_join(index, layer, area).select("rowkey").collect()}


def test_filters_reach_the_scan(spark, data, tmp_path):
    from landgrid.operators import features
    from landgrid.plans import synth
    from landgrid.sources import sinks

    sinks.write_features(synth.layer(spark, data, 1), str(tmp_path / "f"))
    table = spark.read.parquet(str(tmp_path / "f"))
    plan = features.scan(table, "120000", ["0100"]).select("rowkey", "area")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(rowkey,12)" in plan and "StringStartsWith(category,01)" in plan
    assert "caption" not in plan.split("ReadSchema")[1].split("\n")[0]
