"""Rasters of heights as tables (row, col, height), with row 0 in the north."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.functions.measure import NEIGHBOURS, raster_cell_surface, raster_value


def explode_raster(rasters: DataFrame) -> DataFrame:
    """Rasters as arrays (sheet, geotransform, n_rows, n_cols, data) to rows (sheet, geotransform, row, col, height)."""
    cells = rasters.select("sheet", "geotransform", "n_cols", F.posexplode("data").alias("pos", "h"))
    return cells.select("sheet", "geotransform", F.floor(F.col("pos") / F.col("n_cols")).alias("row"), (F.col("pos") % F.col("n_cols")).cast("bigint").alias("col"), raster_value(F.col("h")).alias("height"))


def cell_surfaces(cells: DataFrame, size: float, *keys: str) -> DataFrame:
    """The surface area of each cell from its height and its neighbours'.

    Every cell gives its height to the cells around it, so that one aggregation by cell brings all nine together.
    """
    given = [F.struct(F.lit(-1).alias("i"), F.col("row").alias("r"), F.col("col").alias("c"))]
    given += [F.struct(F.lit(i).alias("i"), (F.col("row") - dr).alias("r"), (F.col("col") - dc).alias("c")) for i, (dr, dc) in enumerate(NEIGHBOURS)]
    spread = cells.select(*keys, raster_value(F.col("height")).alias("h"), F.explode(F.array(*(g.cast("struct<i:int,r:bigint,c:bigint>") for g in given))).alias("g"))
    spread = spread.select(*keys, F.col("g.r").alias("row"), F.col("g.c").alias("col"), "g.i", "h")
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("h"))).alias(f"h{i}")
    met = spread.groupBy(*keys, "row", "col").agg(at(-1), *map(at, range(8))).filter(F.col("h-1").isNotNull())
    surface = raster_cell_surface(F.col("h-1"), [F.col(f"h{i}") for i in range(8)], F.lit(float(size)))
    return met.select(*keys, "row", "col", F.col("h-1").alias("height"), surface.alias("surface"))


def total_surface(surfaces: DataFrame, *keys: str) -> DataFrame:
    return surfaces.groupBy(*keys).agg(F.sum("surface").alias("surface"), F.count("*").alias("cells"))
