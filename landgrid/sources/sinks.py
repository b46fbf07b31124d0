"""Tables of features, index, cells and sheets; text, archives and task results."""

from __future__ import annotations

import json
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions import st
from landgrid.functions.sheets import Scale, sheet_envelope, sheet_zone, sheets_in_range
from landgrid.kernel import codecs
from landgrid.operators.overlay import grid_pieces
from landgrid.sources.shapefile import build_dbf, build_shp


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by province and sorted by row key, so that key ranges prune folders and row groups.

    Rows are dealt by key range, not by province: a province with a third of all features goes to many tasks.
    """
    keyed = features.withColumn("province", F.substring("rowkey", 1, 2))
    keyed.repartitionByRange("rowkey").sortWithinPartitions("province", "rowkey").write.mode(mode).partitionBy("province").parquet(path)


def write_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by level-1 category and sorted by key."""
    index.repartitionByRange("cat2", "zvalue", "rowkey").sortWithinPartitions("cat2", "zvalue").write.mode(mode).partitionBy("cat2").parquet(path)


def ingest_cells(features: DataFrame, path: str, size: float = 0.2, mode: str = "overwrite") -> DataFrame:
    """Cuts features by the fixed grid and writes the pieces by cell; returns the pieces written by cell."""
    pieces = grid_pieces(features, size)
    pieces.repartitionByRange("cell_col", "cell_row", "rowkey").write.mode(mode).partitionBy("cell_col", "cell_row").parquet(path)
    return features.sparkSession.read.parquet(path).groupBy("cell_col", "cell_row").agg(F.count("*").alias("n"))


def sheet_pieces(features: DataFrame, scale: Scale) -> DataFrame:
    """Features cut by map sheets, each piece in its sheet's 6-degree zone: sheet, rowkey, category, geom, area, length."""
    sheets = features.withColumn("sheet", F.explode(sheets_in_range("xmin", "ymin", "xmax", "ymax", scale))).withColumn("_b", sheet_envelope("sheet"))
    cut = sheets.select("sheet", "rowkey", "category", st.st_clip_by_box("geom", "_b.xmin", "_b.ymin", "_b.xmax", "_b.ymax", once=True).alias("geom")).filter(~st.st_is_empty("geom"))
    moved = cut.withColumn("geom", st.st_to_zone("geom", sheet_zone("sheet")))
    return moved.withColumns({"area": st.st_area("geom"), "length": st.st_length("geom")})


def ingest_sheets(features: DataFrame, path: str, scale: Scale, mode: str = "overwrite") -> DataFrame:
    sheet_pieces(features, scale).repartitionByRange("sheet", "rowkey").write.mode(mode).partitionBy("sheet").parquet(path)
    return features.sparkSession.read.parquet(path).groupBy("sheet").agg(F.count("*").alias("n"))


def write_lines(df: DataFrame, path: str, geom: str | None = "geom", one_file: bool = False) -> None:
    """Tab-separated lines, the geometry last as WKT. one_file: in a single file, for small results."""
    columns = [F.col(c).cast("string") for c in df.columns if c != geom] + ([st.st_as_wkt(geom)] if geom else [])
    lines = df.select(F.concat_ws("\t", *columns).alias("value"))
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)


def zip_folder(folder: str, archive: str) -> int:
    """All files below a local folder into an archive; returns their number."""
    files = sorted(p for p in Path(folder).rglob("*") if p.is_file() and Path(archive).resolve() != p.resolve())
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for p in files:
            out.write(p, p.relative_to(folder))
    return len(files)


def result_json(result: DataFrame | dict[str, str], at_most: int = 100_000) -> str:
    """A task's result as JSON text: rows as a list of objects, or paths as an object.

    More than ``at_most`` rows are an error: they belong in files, whose paths are then the result.
    """
    if isinstance(result, dict):
        return json.dumps(result)
    rows = [r["row"] for r in result.limit(at_most + 1).select(F.to_json(F.struct("*")).alias("row")).collect()]
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} rows; write them to files and give their paths")
    return "[" + ",".join(rows) + "]"


def write_by_cell(indexed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Features with their zvalue in its order, so that key ranges prune files and row groups."""
    indexed.repartitionByRange("zvalue", "rowkey").sortWithinPartitions("zvalue", "rowkey").write.mode(mode).parquet(path)


def write_words(words: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A keyword index in the order of its terms, so that a query reads its terms' row groups; a frequent term goes to several tasks."""
    words.repartitionByRange("term", "rowkey").sortWithinPartitions("term").write.mode(mode).parquet(path)


def _write_shapes(folder: str, attributes: list[str]):
    def rows(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        shapes, values = [], []
        for batch in batches:
            shapes += [codecs.from_wkb(g) for g in batch.column("geom").to_pylist()]
            values += batch.select(attributes).to_pylist()
        if not shapes:
            return
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        layer = f"part-{TaskContext.get().partitionId():06d}"
        for kind, content in (("shp", build_shp(shapes)), ("dbf", build_dbf(values, attributes))):
            # an attempt writes under a name of its own, and the last move stays
            own = f"{place}/_{layer}-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(content)
            store.move(own, f"{place}/{layer}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([layer]), pa.array([len(shapes)], pa.int64())], ["layer", "n"])

    return rows


def write_shapefiles(features: DataFrame, folder: str, attributes: list[str], rows_per_file: int = 50_000) -> DataFrame:
    """A shape file and its attributes for each task, of about so many features; returns layer and n by file."""
    texts = features.select(*(F.col(a).cast("string").alias(a) for a in attributes), "geom")
    parts = max(1, -(-features.count() // rows_per_file))
    return texts.repartition(parts, *attributes).mapInArrow(_write_shapes(folder, attributes), "layer string, n long")


def save_result(spark: SparkSession, url: str, table: str, task: str, result: str, properties: dict[str, str]) -> None:
    """Appends (task, result) to a table of a database; where it is and how to log in come from the caller."""
    spark.createDataFrame([(task, result)], "task string, result string").write.jdbc(url, table, mode="append", properties=properties)
