"""Shape files: geometry (.shp) and attributes (.dbf), read by Spark's binary reader and parsed in tasks."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.kernel import codecs
from landgrid.kernel.model import Geometry

FILE_CODE = 9994


def parse_shp(content: bytes) -> list[Geometry]:
    if len(content) < 100 or struct.unpack_from(">i", content)[0] != FILE_CODE:
        raise ValueError("not a shape file")
    found, at = [], 100
    while at + 8 <= len(content):
        (words,) = struct.unpack_from(">i", content, at + 4)
        found.append(codecs.from_shape(content[at + 8 : at + 8 + 2 * words]))
        at += 8 + 2 * words
    return found


def parse_dbf(content: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    n, header, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), content[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        record, place, row = content[header + i * size : header + (i + 1) * size], 1, {}
        for name, width in fields:
            row[name] = record[place : place + width].decode(encoding, "replace").strip()
            place += width
        rows.append(row)
    return rows


def _parse(encoding: str):
    def rows(batches):
        for batch in batches:
            for name, shp, dbf in zip(*(batch.column(c).to_pylist() for c in ("layer", "shp", "dbf"))):
                shapes = parse_shp(shp)
                attributes = parse_dbf(dbf, encoding) if dbf else [{} for _ in shapes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(shapes)), pa.array([list(a.items()) for a in attributes], pa.map_(pa.string(), pa.string())), pa.array([codecs.to_wkb(g) for g in shapes], pa.binary())],
                    ["layer", "attributes", "geom"],
                )

    return rows


def read_shapefiles(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """layer (the file's name), attributes and geom of all shape files under a path; a task holds one file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.(?i:shp|dbf)$", 1)
    base = files.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("base"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("kind"), name.alias("layer"), "content").filter("kind in ('shp', 'dbf')")
    shp, dbf = (base.filter(F.col("kind") == k).select("base", *(["layer"] if k == "shp" else []), F.col("content").alias(k)) for k in ("shp", "dbf"))
    return shp.join(dbf, "base", "left").mapInArrow(_parse(encoding), "layer string, attributes map<string,string>, geom binary")


def build_shp(shapes: list[Geometry]) -> bytes:
    records, box = b"", None
    kind = 0
    for i, g in enumerate(shapes):
        raw = codecs.to_shape(g)
        kind = kind or struct.unpack_from("<i", raw)[0]
        records += struct.pack(">2i", i + 1, len(raw) // 2) + raw
        e = g.envelope()
        if e:
            box = e if box is None else (min(box[0], e[0]), min(box[1], e[1]), max(box[2], e[2]), max(box[3], e[3]))
    head = struct.pack(">i5i i", FILE_CODE, 0, 0, 0, 0, 0, 50 + len(records) // 2) + struct.pack("<2i8d", 1000, kind, *(box or (0.0,) * 4), 0, 0, 0, 0)
    return head + records


def build_dbf(rows: list[dict[str, str]], names: list[str], width: int = 64) -> bytes:
    fields = b"".join(n.encode()[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14 for n in names)
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + len(fields), 1 + width * len(names))
    body = b"".join(b" " + b"".join(str(r.get(n) or "").encode()[:width].ljust(width) for n in names) for r in rows)
    return head + fields + b"\x0d" + body + b"\x1a"


def write_shapefile(features: DataFrame, base: str, attributes: list[str], at_most: int = 200_000) -> int:
    """base.shp and base.dbf on the driver, for results up to a bound; larger ones belong in tables."""
    rows = features.select(*attributes, "geom").limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} features; write a table instead")
    with open(f"{base}.shp", "wb") as out:
        out.write(build_shp([codecs.from_wkb(bytes(r["geom"])) for r in rows]))
    with open(f"{base}.dbf", "wb") as out:
        out.write(build_dbf([r.asDict() for r in rows], attributes))
    return len(rows)
