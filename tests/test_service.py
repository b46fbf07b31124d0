"""Conditions, the query service, records, JSON, shape files, sinks, streams and commands."""

import json
import math

import pytest
from pyspark.sql import functions as F

from landgrid import cli
from landgrid.functions import st
from landgrid.functions.sheets import scale_of
from landgrid.kernel import codecs, ops
from landgrid.kernel.model import box, polygon
from landgrid.operators import keyword, overlay, spatial
from landgrid.plans import synth
from landgrid.plans.conditions import FeatureQuery, RangeSpec, job_arguments, region_filters, surface_condition, unit_parameters
from landgrid.plans.service import FeatureService
from landgrid.sources import json as feature_json
from landgrid.sources import records, shapefile, sinks
from landgrid.streaming import stats as streams


@pytest.fixture(scope="module")
def features(spark, data):
    layer = synth.degrees(synth.layer(spark, data, 1)).withColumn("geom", st.st_make_envelope("xmin", "ymin", "xmax", "ymax"))
    return spatial.with_index(layer).withColumn("properties", F.lit(None).cast("map<string,string>")).cache()


@pytest.fixture(scope="module")
def service(features):
    return FeatureService(features, keyword.build_keyword_index(features), features, kept=2)


def test_conditions():
    q = FeatureQuery.from_params({"categorycode": "01,0110", "regioncode": "1101", "length": "5"})
    assert (q.kind, q.categories, q.region, q.length, q.start) == ("property", ("0100", "0110"), "110100", 5, 1)
    assert FeatureQuery.from_params({"GEOWKT": "POLYGON EMPTY", "CATEGORYCODE": "0100\t0200"}).categories == ("0100", "0200")
    assert FeatureQuery.from_params({"CATEGORYCODE": "0100"}).keyword.startswith("耕地")
    assert FeatureQuery.from_params({"REGIONCODE": "11"}) is None
    assert q == FeatureQuery.from_params({"CATEGORYCODE": "0100,0110", "REGIONCODE": "110100", "LENGTH": "5"}) and hash(q.identity) == hash(q.identity)
    assert unit_parameters({"GNCROWKEY": "k", "X": "1"}, "1115", {"PAC": "110101"}, None) == {"X": "1", "REGIONCODE": "110101"}
    assert unit_parameters({"GNCROWKEY": "k"}, "1131", {}, "W") == {"GEOWKT": "W"}
    assert RangeSpec.of_unit("110000000000111200000019", "W").level == 1 and RangeSpec.of_unit("110000000000113100000019", "W").kind == "polygon"
    assert region_filters(["110000000000111200000019", "110101000000111500000001"]) == {1: {"110000"}, 2: set(), 3: {"110101"}}
    assert job_arguments(["app", "A=1&b=2", "c=x=y"]) == ("app", {"a": "1", "b": "2", "c": "x=y"})
    assert surface_condition({"regioncode": "11", "categorycode": "01"}) == ("property", ("01",), "11")


def test_service(service, features):
    area = box(116.3, 39.3, 117.15, 40.12)
    params = {"GEOWKT": codecs.to_wkt(area), "CATEGORYCODE": "0000"}
    rows = features.select("rowkey", "geom").collect()
    wanted = {r["rowkey"] for r in rows if ops.intersects(area, codecs.from_wkb(bytes(r["geom"])))}
    assert {r["rowkey"] for r in service.feature_list(params).collect()} == wanted
    assert service._list(service.condition(params)) is service._list(service.condition(params))
    page = service.page(params | {"STARTINDEX": "3", "LENGTH": "4"}).collect()
    assert [r["rowkey"] for r in page] == sorted(wanted)[2:6] and "geom" not in page[0]
    stats = {r["category"]: r for r in service.statistics(params | {"STATISTICONLY": "true"}).collect()}
    exact = sum(ops.area(ops.intersection(area, codecs.from_wkb(bytes(r["geom"])))) for r in rows)
    assert math.isclose(sum(r["area"] for c, r in stats.items() if c.endswith("00")), exact, rel_tol=1e-9)
    assert math.isclose(sum(r["area_percent"] for c, r in stats.items() if c.endswith("00")), 1)
    star = polygon([(116.2, 39.2), (117.8, 39.4), (117.0, 40.9)])
    found = {r["rowkey"] for r in service.feature_list({"GEOWKT": codecs.to_wkt(star)}).collect()}
    assert found == {r["rowkey"] for r in rows if ops.intersects(star, codecs.from_wkb(bytes(r["geom"])))}


def test_service_by_property_keyword_and_point(service, features):
    one = features.orderBy("rowkey").first()
    listed = service.feature_list({"REGIONCODE": one["region12"], "CATEGORYCODE": one["category"]})
    assert one["rowkey"] in {r["rowkey"] for r in listed.collect()}
    assert service.feature(one["rowkey"]).count() == 1
    x, y = (one["xmin"] + one["xmax"]) / 2, (one["ymin"] + one["ymax"]) / 2
    hit = service.point(x, y).collect()
    assert len(hit) == 1 and hit[0]["xmin"] <= x <= hit[0]["xmax"]
    word = one["caption"].lower()
    assert service.keywords(word).count() >= 1
    assert service.feature_list({"CATEGORYCODE": "0000", "KEYWORD": one["caption"]}).count() >= 1
    assert service.keyword_statistics({"CATEGORYCODE": "0000", "KEYWORD": one["caption"]}).count() >= 1
    assert service.feature_list({}).count() == 0
    by_unit = service.condition({"GNCROWKEY": one["rowkey"], "CATEGORYCODE": "0100"})
    assert by_unit.kind == "spatial"


def test_polygon_jobs(spark):
    rows = [("a", "110101000000", "0111", polygon([(0, 0), (4, 0), (0, 4)])), ("b", "120101000000", "0211", polygon([(1, 1), (5, 1), (5, 5), (1, 5)], [(2, 2), (3, 2), (3, 3), (2, 3)]))]
    table = spark.createDataFrame([(k, r, c, bytearray(codecs.to_wkb(g))) for k, r, c, g in rows], "rowkey string, region12 string, category string, geom binary")
    layer = overlay.with_envelope(table)
    window = polygon([(0.5, 0.5), (4.5, 0.5), (2.5, 6)])
    ranges = overlay.with_envelope(spark.createDataFrame([("w", bytearray(codecs.to_wkb(window)))], "id string, geom binary"))
    exact = {r[0]: ops.area(ops.intersection(window, r[3])) for r in rows}
    clipped = {r["category"]: ops.area(codecs.from_wkb(bytes(r["geom"]))) for r in overlay.clip(layer, overlay.Range(ranges), size=1.0).collect()}
    assert {c: round(a, 9) for c, a in clipped.items()} == {"0111": round(exact["a"], 9), "0211": round(exact["b"], 9)}
    assert [r["region6"] for r in overlay.clip(layer, overlay.Range(districts=("110000",), level=1)).collect()] == ["110101"]
    areas = {r["category"]: r["area"] for r in overlay.area_statistics(layer, ranges.withColumnRenamed("id", "region"), size=1.0).collect()}
    assert math.isclose(areas["0111"], exact["a"]) and math.isclose(areas["0211"], exact["b"])
    changed = overlay.change_detection(layer, layer, overlay.Range(ranges), ["0100"], size=1.0).collect()
    assert [(r["region6"], r["category1"], r["category2"]) for r in changed] == [("120101", "0111", "0211")]
    assert math.isclose(ops.area(codecs.from_wkb(bytes(changed[0]["geom"]))), ops.area(ops.intersection(ops.intersection(window, rows[0][3]), rows[1][3])))
    pieces = overlay.grid_pieces(layer, 1.0)
    assert math.isclose(pieces.agg(F.sum("area")).first()[0], sum(ops.area(r[3]) for r in rows))
    cut = overlay.cut_area(pieces, ranges, 1.0).first()
    assert math.isclose(cut["area"], sum(exact.values())) and cut["features"] == 2
    wide = overlay.buffer(layer, overlay.Range(districts=("110000",), level=1), 0.5).first()
    assert ops.area(codecs.from_wkb(bytes(wide["geom"]))) > ops.area(rows[0][3])


def test_records(spark, tmp_path):
    lines = ["NAME:x\tPAC:110101\t4\t1\t7\t110101\tpark\t0111\tPolygon\tPOLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "4\t1\t8\t1102\t\t1\tPolygon\tPOLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))", "4\t1\t9\t1102\tz\tab\tPolygon\tPOLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))", "1\t2\t3\t4\t5\t0111\tPolygon\tPOLYGON ((broken", ""]
    path = tmp_path / "r.txt"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    good, bad = records.split_rejects(records.features_of(records.loader_records(records.read_lines(spark, str(path)))))
    rows = {r["fid"]: r for r in good.collect()}
    assert rows["7"]["rowkey"] == "110101000000011100000007" and rows["7"]["properties"] == {"NAME": "x", "PAC": "110101"} and rows["7"]["area"] == 1
    assert (rows["8"]["category"], rows["8"]["caption"], rows["8"]["region12"]) == ("9999", "未命名", "110200000000")
    assert sorted(r["error"] for r in bad.collect()) == ["category", "geometry", "geometry"]
    extract = tmp_path / "e.txt"
    extract.write_text("110101000000011100000007\ta\tb\tPOLYGON ((0 0, 3 0, 3 1, 0 1, 0 0))\n")
    row = records.features_of(records.extract_records(records.read_lines(spark, str(extract)))).first()
    assert row["rowkey"] == "110101000000011100000007" and row["area"] == 3 and row["length"] == 8
    assert cli.upload(spark, str(path), str(tmp_path / "t")) == (2, 3)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert records.feature_counts(spark, str(path)).first()["n"] == 5
    metric = records.with_metric_measures(good.filter("fid = '7'")).first()
    assert math.isclose(metric["area"], 1.23e10, rel_tol=0.02) and math.isclose(metric["length"], 4.43e5, rel_tol=0.02)


def test_json(spark, tmp_path):
    square = {"rings": [[[0, 0], [0, 1], [1, 1], [1, 0], [0, 0]]]}
    document = {"displayFieldName": "a", "geometryType": "esriGeometryPolygon", "spatialReference": {"wkid": 4490}, "fields": [{"name": "a", "type": "esriFieldTypeOID"}], "features": [{"attributes": {"a": "1{"}, "geometry": square}, {"attributes": {"a": "2"}, "geometry": {"x": 1, "y": 2}}]}
    (tmp_path / "class.json").write_text(json.dumps(document, indent=1))
    rows = feature_json.read_enclosed(spark, str(tmp_path / "class.json")).withColumn("wkt", st.st_as_wkt("geom")).collect()
    assert [r["attributes"]["a"] for r in rows] == ["1{", "2"] and rows[1]["wkt"] == "POINT (1 2)"
    assert tuple(feature_json.feature_class_fields(spark, str(tmp_path / "class.json")).first()) == ("a", "OID", "bigint")
    (tmp_path / "stream.json").write_text("".join(json.dumps(f, indent=2) for f in document["features"]) + "\n{\"other\": 1}")
    stream = feature_json.read_unenclosed(spark, str(tmp_path / "stream.json"))
    assert sorted(r["attributes"]["a"] for r in stream.collect()) == ["1{", "2"]
    back = feature_json.to_feature_class(stream.withColumn("a", F.col("attributes")["a"]), ["a"])
    assert len(json.loads(back)["features"]) == 2
    shapes = stream.withColumn("a", F.col("attributes")["a"])
    feature_json.to_geojson_lines(shapes, ["a"]).coalesce(1).write.text(str(tmp_path / "lines"))
    (tmp_path / "collection").mkdir()
    (tmp_path / "collection" / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": "1"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    assert sorted(r["properties"]["a"] for r in feature_json.read_geojson(spark, str(tmp_path / "lines")).collect()) == ["1{", "2"]
    assert feature_json.read_geojson(spark, str(tmp_path / "collection")).select(st.st_as_wkt("geom").alias("w")).first()["w"] == "POINT (1 2)"


def test_shapefiles_and_sinks(spark, features, tmp_path):
    few = features.orderBy("rowkey").limit(5)
    base = str(tmp_path / "shapes" / "five")
    (tmp_path / "shapes").mkdir()
    assert shapefile.write_shapefile(few, base, ["rowkey", "caption"]) == 5
    back = shapefile.read_shapefiles(spark, str(tmp_path / "shapes"))
    pairs = {(r["attributes"]["rowkey"], round(ops.area(codecs.from_wkb(bytes(r["geom"]))), 12)) for r in back.collect()}
    assert pairs == {(r["rowkey"], round(ops.area(codecs.from_wkb(bytes(r["geom"]))), 12)) for r in few.collect()}
    with pytest.raises(ValueError):
        shapefile.write_shapefile(few, base, ["rowkey"], at_most=2)
    sinks.write_index(spatial.build_index(features), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).filter("cat2 = '01'").count() == features.filter("category like '01%'").count()
    written = sinks.ingest_cells(few.select("rowkey", "category", "geom", "xmin", "ymin", "xmax", "ymax"), str(tmp_path / "cells"), 0.05)
    assert written.agg(F.sum("n")).first()[0] >= 5
    sheets = sinks.sheet_pieces(few.select("rowkey", "category", "geom", "xmin", "ymin", "xmax", "ymax"), scale_of("G"))
    assert sheets.agg(F.sum("area")).first()[0] > 1000  # square metres
    sinks.write_lines(few.select("rowkey", "geom"), str(tmp_path / "text"), one_file=True)
    assert records.wkt_lines(spark, str(tmp_path / "text")).count() == 0 and spark.read.text(str(tmp_path / "text")).count() == 5
    assert sinks.zip_folder(str(tmp_path / "text"), str(tmp_path / "text.zip")) >= 1
    assert len(json.loads(sinks.result_json(few.select("rowkey")))) == 5 and json.loads(sinks.result_json({"a": "b"})) == {"a": "b"}


def test_aggregates_and_functions(spark):
    boxes = spark.range(40).select((F.col("id") % 2).alias("key"), st.st_make_envelope(F.col("id").cast("double"), F.lit(0.0), F.col("id") + 2.5, F.lit(1.0)).alias("geom"))
    merged = st.dissolve(boxes, ["key"], group=4).withColumn("a", st.st_area("geom")).collect()
    assert [round(r["a"], 9) for r in sorted(merged, key=lambda r: r["key"])] == [40.5, 40.5]
    hull = st.hulls(boxes, ["key"], group=8).withColumn("a", st.st_area("geom")).collect()
    assert sorted(round(r["a"], 9) for r in hull) == [40.5, 40.5]
    row = spark.sql("select 'LINESTRING ZM (0 0 1 5, 3 4 2 6)' as w, 'bad' as bad, cast(null as string) as none").select(
        st.st_try_from_wkt("bad").alias("bad"), st.st_try_from_wkt("none").alias("none"), st.st_from_wkt("w").alias("g"))
    row = row.select("bad", "none", st.st_length("g").alias("l"), st.st_is_3d("g").alias("z"), st.st_is_measured("g").alias("m"), st.st_interval("g", "m").alias("i"), st.st_as_wkt(st.st_end_point("g")).alias("e"), st.st_as_wkt("g", flat=True).alias("f"),
        st.st_as_wkt(st.st_affine("g", 2.0, 0.0, 1.0, 0.0, 1.0, 0.0)).alias("t"), st.st_num_points("g").alias("n"), st.st_is_closed("g").alias("c"), st.st_as_wkt(st.st_point_n("g", 3)).alias("p3")).first()
    assert (row["bad"], row["none"], row["l"], row["z"], row["m"], tuple(row["i"]), row["n"], row["c"], row["p3"]) == (None, None, 5.0, True, True, (5.0, 6.0), 2, False, None)
    assert row["e"] == "POINT ZM (3 4 2 6)" and row["f"] == "LINESTRING (0 0, 3 4)" and row["t"] == "LINESTRING ZM (1 0 1 5, 7 4 2 6)"


def test_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    stream = streams.read_stream(spark, str(tmp_path / "in"), schema, per_trigger=10)
    streams.start(streams.windowed(stream, late="3650 days"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    batch = streams.windowed(events).agg(F.sum("n")).first()[0]
    assert batch == events.count()
    total = stream.withColumns({"category": F.col("event_type"), "area": F.col("value"), "length": F.col("value")})
    query = streams.category_stats(total).writeStream.outputMode("complete").trigger(availableNow=True).format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination(120)
    assert spark.table("running").agg(F.sum("cnt")).first()[0] == events.count()
    assert streams.sessions(events).agg(F.sum("n")).first()[0] == events.count()
