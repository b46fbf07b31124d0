"""Feature JSON: documents with a list of features, and streams of feature objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions import st

FEATURE = "attributes map<string,string>, geometry string"
FEATURE_CLASS = "displayFieldName string, geometryType string, spatialReference struct<wkid:int>, fields array<struct<name:string,type:string,alias:string,length:int>>, features array<string>"
#: Field types of feature classes and the types of their columns.
FIELD_TYPES = {
    "SmallInteger": "smallint", "Integer": "int", "Single": "float", "Double": "double", "String": "string", "Date": "timestamp", "OID": "bigint",
    "Geometry": "binary", "Blob": "binary", "Raster": "binary", "GUID": "string", "GlobalID": "string", "XML": "string",
}


def _parsed(objects: DataFrame) -> DataFrame:
    """attributes and geom of feature objects (column feature); what isn't one gives nulls."""
    f = objects.withColumn("f", F.from_json("feature", FEATURE))
    return f.select(F.col("f.attributes").alias("attributes"), st.st_from_feature_json("f.geometry").alias("geom"))


def read_enclosed(spark: SparkSession, path: str) -> DataFrame:
    """The features of documents that hold a feature class each."""
    docs = spark.read.text(path, wholetext=True)
    return _parsed(docs.select(F.explode(F.from_json("value", FEATURE_CLASS)["features"]).alias("feature")))


def feature_class_fields(spark: SparkSession, path: str) -> DataFrame:
    """name, type and column type of the fields that documents declare."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", FEATURE_CLASS)["fields"]).alias("f"))
    kind = F.regexp_replace("f.type", "^esriFieldType", "")
    types = F.create_map(*(F.lit(v) for pair in FIELD_TYPES.items() for v in pair))
    return docs.select(F.col("f.name").alias("name"), kind.alias("type"), types[kind].alias("column_type")).distinct()


def objects_in(text: str) -> Iterator[str]:
    """The outermost objects of a text of objects one after another, by matching braces outside strings."""
    depth, start, quoted, escaped = 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : i + 1]


def _objects(batches):
    for batch in batches:
        for text in batch.column("value").to_pylist():
            found = [o for o in objects_in(text) if '"attributes"' in o or '"geometry"' in o]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["feature"])


def parse_lines(lines: DataFrame) -> DataFrame:
    """attributes and geom of the feature objects in column value."""
    return _parsed(lines.select("value").mapInArrow(_objects, "feature string"))


def read_unenclosed(spark: SparkSession, path: str, line_delimited: bool = False) -> DataFrame:
    """The features of files of feature objects; splittable where each line holds whole objects."""
    return parse_lines(spark.read.text(path, wholetext=not line_delimited))


def to_feature_json(features: DataFrame, attributes: list[str], wkid: int = 4490) -> DataFrame:
    """A line of feature JSON for each feature, in column value."""
    kept = F.to_json(F.struct(*attributes))
    return features.select(F.concat(F.lit('{"attributes":'), kept, F.lit(',"geometry":'), st.st_as_feature_json("geom", wkid), F.lit("}")).alias("value"))


def to_geojson_lines(features: DataFrame, properties: list[str], srid: int = 0) -> DataFrame:
    """A line of GeoJSON for each feature, in column value."""
    kept = F.to_json(F.struct(*properties))
    return features.select(F.concat(F.lit('{"type":"Feature","properties":'), kept, F.lit(',"geometry":'), st.st_as_geojson("geom", srid), F.lit("}")).alias("value"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """properties and geom of GeoJSON features: a line each, or the features of collections in files of their own."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.coalesce(F.from_json("value", "features array<string>")["features"], F.split(F.trim("value"), "\n"))).alias("f"))
    parsed = lines.withColumn("o", F.from_json("f", "properties map<string,string>, geometry string"))
    return parsed.filter("o.geometry is not null").select(F.col("o.properties").alias("properties"), st.st_from_geojson("o.geometry").alias("geom"))


def to_feature_class(features: DataFrame, attributes: list[str], geometry_type: str = "esriGeometryPolygon", wkid: int = 4490) -> str:
    """One document; the result is gathered on the driver, so it is for small results."""
    import json

    objects = [json.loads(r["value"]) for r in to_feature_json(features, attributes, wkid).collect()]
    fields = [{"name": a, "type": "esriFieldTypeString", "alias": a} for a in attributes]
    return json.dumps({"displayFieldName": attributes[0] if attributes else "", "fieldAliases": {a: a for a in attributes}, "geometryType": geometry_type, "spatialReference": {"wkid": wkid}, "fields": fields, "features": objects})
