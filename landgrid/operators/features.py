"""Access to feature tables by row key, region and category; projections and paging.

A feature table has rowkey (region 12, category 4, id 8), region12, category, caption and measures. Filters on these
columns are plain predicates, so that they reach the scan and prune partitions and row groups.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.functions.codes import category_contains, district_of

BROADCAST_KEYS = 100_000  # key lists up to here may be broadcast; larger ones are joined


def get(features: DataFrame, key: str) -> DataFrame:
    return features.filter(F.col("rowkey") == key)


def multi_get(features: DataFrame, keys: DataFrame | Iterable[str]) -> DataFrame:
    """Features whose row key is in a list or in the column rowkey of keys; keys without a feature give nothing."""
    if isinstance(keys, DataFrame):
        return features.join(keys.select("rowkey").distinct(), "rowkey", "left_semi")
    found = sorted(set(keys))
    if len(found) > BROADCAST_KEYS:
        return multi_get(features, features.sparkSession.createDataFrame([(k,) for k in found], "rowkey string"))
    return features.filter(F.col("rowkey").isin(found))


def key_range(features: DataFrame, start: str, stop: str) -> DataFrame:
    return features.filter((F.col("rowkey") >= start) & (F.col("rowkey") < stop))


def short_region(code: str) -> str:
    code = code[:6].ljust(6, "0")
    n = len(code.rstrip("0"))
    return code[: 2 if n <= 2 else 4 if n <= 4 else 6]


def short_category(code: str) -> str:
    code = code[:4].ljust(4, "0")
    return "" if code == "0000" else code[:2] if code.endswith("00") else code[:3] if code.endswith("0") else code


def in_region(code: str | None, column: str = "rowkey") -> Column:
    """Region prefix; None and the country mean everywhere."""
    return F.lit(True) if not code or not code.strip("0") else F.col(column).startswith(short_region(code))


def in_categories(codes: Iterable[str] | None, column: str = "category") -> Column:
    """Any of the categories, with all below them; none given, or the top, means all."""
    prefixes = sorted({short_category(c) for c in codes or ()})
    if not prefixes or "" in prefixes:
        return F.lit(True)
    return reduce(or_, (F.col(column).startswith(p) for p in prefixes))


def scan(features: DataFrame, region: str | None = None, categories: Iterable[str] | None = None) -> DataFrame:
    return features.filter(in_region(region) & in_categories(categories))


def in_districts(codes: Iterable[str], level: int, column: str = "region12") -> Column:
    """The district of a level (1 province, 2 city, 3 county) is one of the codes."""
    return district_of(column, level).isin(sorted(set(codes)))


def category_subtree(dimension: DataFrame, code: str) -> DataFrame:
    """The rows of a category dimension (code, name) at or below a code."""
    return dimension.filter(category_contains(F.lit(code), F.col("code")))


def positions(features: DataFrame) -> DataFrame:
    """The list projection: key, caption, a representative point and the stored measures, not the geometry."""
    return features.select("rowkey", "caption", F.lit(1).cast("bigint").alias("cnt"), "area", "length", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))


def detail(features: DataFrame, geometry: Iterable[str] = ("geom",)) -> DataFrame:
    """All but the geometry columns."""
    return features.drop(*geometry)


def page(features: DataFrame, start: int = 1, length: int = 10, order: str = "rowkey") -> DataFrame:
    """Rows start to start + length - 1, counted from 1, in the order of the key; a start below 1 means 1."""
    return features.orderBy(order).offset(max(start, 1) - 1).limit(length)


def batches(keys: DataFrame, size: int, order: str = "rowkey") -> DataFrame:
    """The keys with the number of their batch of ``size`` in key order.

    Numbers come from each range partition's count and the rows before it, so that no task sorts all rows. The number
    of partitions is given, as adaptive execution may join partitions of an open number, and not alike in both branches.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = keys.select(order).distinct().repartitionByRange(n, order).withColumn("part", F.spark_partition_id())
    counts = parts.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    numbered = parts.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(order))).join(F.broadcast(before), "part")
    return numbered.select(order, F.floor((F.coalesce("before", F.lit(0)) + F.col("n") - 1) / size).cast("bigint").alias("batch"))
