"""The spatial index and joins on envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from landgrid.functions.grid import envelope_cells, optimal_cell, point_cells, z_level
from landgrid.functions.measure import box_overlap, boxes_meet
from landgrid.kernel import boxes
from landgrid.plans.cover import Box, cover, kind_of, may_hold


def build_index(features: DataFrame) -> DataFrame:
    """zvalue, level, cat2, category, rowkey of each feature with an envelope in degrees that the grid holds."""
    keyed = features.withColumn("zvalue", optimal_cell("xmin", "ymin", "xmax", "ymax"))
    return keyed.filter("zvalue >= 0").select("zvalue", z_level("zvalue").alias("level"), F.substring("category", 1, 2).alias("cat2"), "category", "rowkey")


def with_index(features: DataFrame) -> DataFrame:
    return features.withColumn("zvalue", optimal_cell("xmin", "ymin", "xmax", "ymax"))


def box_query(indexed: DataFrame, area: Box) -> DataFrame:
    """Features that meet an envelope, with ``inside``: whether the index alone tells that they lie in it.

    Key ranges of the cover go to the scan; boundary candidates are tested on their envelope.
    """
    ranges = cover(area)
    meets = boxes_meet(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), *map(F.lit, area))
    found = indexed.filter(may_hold(F.col("zvalue"), ranges)).withColumn("_kind", kind_of(F.col("zvalue"), ranges))
    return found.filter((F.col("_kind") == 2) | ((F.col("_kind") == 1) & meets)).withColumn("inside", F.col("_kind") == 2).drop("_kind")


def index_join(index: DataFrame, features: DataFrame, area: Box) -> DataFrame:
    """Row keys from the index table by key range, then their features."""
    ranges = cover(area)
    keys = index.filter(may_hold(F.col("zvalue"), ranges) & (kind_of(F.col("zvalue"), ranges) > 0)).select("rowkey").distinct()
    return features.join(keys, "rowkey", "left_semi")


def point_query(indexed: DataFrame, x: float, y: float) -> DataFrame:
    """The feature of the finest cell that holds a point; of several the one of least key."""
    cells = [r for r in indexed.sparkSession.range(1).select(point_cells(F.lit(x), F.lit(y)).alias("c")).first()["c"]]
    hit = indexed.filter(F.col("zvalue").isin(cells)).filter((F.col("xmin") <= x) & (F.col("xmax") >= x) & (F.col("ymin") <= y) & (F.col("ymax") >= y))
    return hit.orderBy(F.desc(z_level("zvalue")), "rowkey").limit(1)


def explode_cells(features: DataFrame, size: float, *keep: str) -> DataFrame:
    """A row for each fixed-grid cell that a feature's envelope meets: cell_row, cell_col."""
    cells = features.withColumn("_cell", F.explode(envelope_cells("xmin", "ymin", "xmax", "ymax", F.lit(size))))
    return cells.select(*(keep or features.columns), F.col("_cell.row").alias("cell_row"), F.col("_cell.col").alias("cell_col"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to a given number of tasks: the input may be one small file, and few rows may be much work."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _int_cells(df: DataFrame, size: int, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    index = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor((F.col(hi) - 1) / size))
    return df.withColumn("cell_col", F.explode(index(x0, x1))).withColumn("cell_row", F.explode(index(y0, y1)))


def overlap_join(left: DataFrame, right: DataFrame, size: int = 500) -> DataFrame:
    """Pairs of rectangles with a common area, each once.

    left has x0, y0, x1, y1 and right u0, v0, u1, v1, in integer units. Both sides go to the square cells they meet and
    join on the cell; of the cells that a pair shares, the one with the lower left corner of their overlap reports it.
    """
    cells = dealt(_int_cells(left, size, "x0", "y0", "x1", "y1"), "cell_row", "cell_col").join(_int_cells(right, size, "u0", "v0", "u1", "v1"), ["cell_row", "cell_col"])
    corner = lambda a, b, cell: (F.col(a) >= F.col(cell) * size) | (F.col(b) >= F.col(cell) * size)  # noqa: E731  both begin before the cell's end
    pairs = cells.filter("x0 < u1 and u0 < x1 and y0 < v1 and v0 < y1").filter(corner("x0", "u0", "cell_col") & corner("y0", "v0", "cell_row"))
    return pairs.withColumn("overlap", overlap_area()).drop("cell_row", "cell_col")


def overlap_sums(left: DataFrame, right: DataFrame, left_class: str, right_class: str, size: int = 500) -> DataFrame:
    """Area that the rectangles of each class of left and right have in common: both classes, area.

    As overlap_join, but no pair becomes a row: copies count once with their number, and the rectangles of a cell are
    compared, or added up, in its task.
    """
    corners = ("x0", "y0", "x1", "y1")
    renamed = right.select(right_class, *(F.col(c).alias(n) for c, n in zip(("u0", "v0", "u1", "v1"), corners)))
    none = {n: F.lit(None).cast(df.schema[n].dataType) for df, n in ((left, left_class), (right, right_class))}
    sides = []
    for k, (df, own) in enumerate(((left, left_class), (renamed, right_class))):
        once = df.groupBy(own, *corners).agg(F.count("*").alias("times"))
        classes = [F.col(c) if c == own else none[c].alias(c) for c in (left_class, right_class)]
        sides.append(_int_cells(once, size, *corners).select("cell_row", "cell_col", F.lit(k).alias("side"), *classes, *(F.col(c).cast("bigint").alias(c) for c in corners), "times"))
    cells = dealt(sides[0].unionAll(sides[1]), "cell_row", "cell_col").sortWithinPartitions("cell_row", "cell_col")
    made = T.StructType([left.schema[left_class], right.schema[right_class], T.StructField("area", T.LongType())])
    made = T.StructType([T.StructField(f.name, f.dataType) for f in made])
    arrow = to_arrow_schema(made)
    return cells.mapInArrow(lambda batches: boxes.sums_of(batches, size, arrow), made).groupBy(left_class, right_class).agg(F.sum("area").alias("area"))


def overlap_area() -> Column:
    return box_overlap(*map(F.col, ("x0", "y0", "x1", "y1", "u0", "v0", "u1", "v1")))


def grid_pieces(features: DataFrame, size: int = 500) -> DataFrame:
    """Rectangles cut by the lines of a square grid: cell_row, cell_col, the piece's corners, area and perimeter."""
    cells = _int_cells(features, size, "x0", "y0", "x1", "y1")
    low = lambda c, cell: F.greatest(F.col(c), F.col(cell) * size)
    high = lambda c, cell: F.least(F.col(c), (F.col(cell) + 1) * size)
    cut = cells.withColumns({"px0": low("x0", "cell_col"), "py0": low("y0", "cell_row"), "px1": high("x1", "cell_col"), "py1": high("y1", "cell_row")})
    w, h = F.col("px1") - F.col("px0"), F.col("py1") - F.col("py0")
    return cut.select("rowkey", "category", "cell_row", "cell_col", "px0", "py0", "px1", "py1", (w * h).alias("area"), (2 * (w + h)).alias("length"))
