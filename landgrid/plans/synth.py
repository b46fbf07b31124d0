"""Feature layers derived from the test tables' integer keys; one SQL text serves Spark and other engines.

Coordinates are integers of 1e-4 degrees, so that areas and sums are exact. A feature is a rectangle x0, y0 to x1, y1.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = 10_000  # of coordinates in a degree
ORIGIN_X, ORIGIN_Y, SPAN = 1_160_000, 390_000, 20_000


def layer_sql(table: str, key: str, caption: str, mx: int, my: int) -> str:
    return f"""
      SELECT k, caption, region12, category, fid, region12 || category || fid AS rowkey, x0, y0, x0 + w AS x1, y0 + h AS y1,
             w * h AS area, 2 * (w + h) AS length
      FROM (SELECT k, caption, {ORIGIN_X} + (k * {mx}) % {SPAN} AS x0, {ORIGIN_Y} + (k * {my}) % {SPAN} AS y0,
                   50 + (k * 31) % 450 AS w, 50 + (k * 17) % 450 AS h,
                   rpad(cast(110000 + (k % 7) * 10000 + (k % 5) * 100 + (k % 3) AS string), 12, '0') AS region12,
                   lpad(cast(1 + k % 10 AS string), 2, '0') || cast(k % 3 AS string) || cast(k % 4 AS string) AS category,
                   lpad(cast(k AS string), 8, '0') AS fid
            FROM (SELECT cast({key} AS bigint) AS k, {caption} AS caption FROM {table}) AS keys) AS boxes"""


LAYER_1 = layer_sql("customer", "c_custkey", "c_name", 7919, 104729)
LAYER_2 = layer_sql("part", "p_partkey", "p_name", 6007, 9973)


def layer(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    table, text = (("customer", LAYER_1), ("part", LAYER_2))[number - 1]
    return spark.sql(text.replace(f"FROM {table})", "FROM {source})"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def degrees(features: DataFrame) -> DataFrame:
    """The features with their envelope in degrees: xmin, ymin, xmax, ymax."""
    return features.withColumns({name: F.col(c) / F.lit(float(UNIT)) for name, c in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))})


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square raster of heights; row 0 is the northernmost. 40 x 40 cells are over the layers' extent, and it grows south and east with the first layer."""
    n = 40 * math.ceil(math.sqrt(max(1, spark.read.parquet(f"{sf_dir}/customer.parquet").count() / 1500)))
    cells = spark.range(n * n).select(F.floor(F.col("id") / n).alias("row"), (F.col("id") % n).alias("col"))
    return cells.withColumn("height", ((F.col("row") * 37 + F.col("col") * 53) % 200).cast("double"))


_SIDE = "(SELECT unnest(range(cast(40 * ceil(sqrt(greatest(1, count(*) / 1500.0))) AS bigint))) AS {} FROM customer)"
RASTER = f"SELECT r AS row, c AS col, cast((r * 37 + c * 53) % 200 AS double) AS height FROM {_SIDE.format('r')}, {_SIDE.format('c')}"
