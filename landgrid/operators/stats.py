"""Statistics by category, their rollup in the code hierarchy, and conditional sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.functions.codes import category_ancestors

MEASURES = ("cnt", "area", "length")


def category_stats(features: DataFrame, *keys: str) -> DataFrame:
    """Count and sums of area and length by category (and other keys first)."""
    return features.groupBy(*keys, "category").agg(F.count("*").alias("cnt"), F.sum("area").alias("area"), F.sum("length").alias("length"))


def merge_stats(*parts: DataFrame) -> DataFrame:
    """One table from partial statistics by category."""
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("category").agg(*(F.sum(m).alias(m) for m in MEASURES))


def rollup(stats: DataFrame, top: int = 1) -> DataFrame:
    """Each base row once for every ancestor of level ``top`` or below; sums by code."""
    up = stats.withColumn("category", F.explode(category_ancestors("category", top)))
    return up.groupBy("category").agg(*(F.sum(m).alias(m) for m in MEASURES))


def summary(stats: DataFrame) -> DataFrame:
    """One row of totals over base rows."""
    return stats.agg(*(F.sum(m).alias(m) for m in MEASURES))


def rollup_percent(stats: DataFrame, top: int = 1) -> DataFrame:
    """The rollup with each measure's share of the total of all base rows; null where the total is 0."""
    total = summary(stats).select(*(F.col(m).alias(f"_{m}") for m in MEASURES))
    rolled = rollup(stats, top).crossJoin(F.broadcast(total))  # one row
    return rolled.select("category", *MEASURES, *(F.try_divide(F.col(m).cast("double"), F.col(f"_{m}")).alias(f"{m}_percent") for m in MEASURES))


def top_level(codes: list[str]) -> int:
    """The least level among requested categories, from which results roll up; 1 at least."""
    levels = [0 if c == "0000" else 1 if c.endswith("00") else 2 if c.endswith("0") else 3 for c in codes]
    return max(1, min(levels, default=1))


def two_column_sum(df: DataFrame, first: Column, second: Column, above: float = 60_000) -> DataFrame:
    """Count, sum and whole average in thousands of the values above a limit, for two columns; rows without both count for neither."""
    both = df.select(first.alias("a"), second.alias("b")).filter("a is not null and b is not null")
    sums = both.agg(*(f for c in ("a", "b") for f in (F.count_if(F.col(c) > above).alias(f"count_{c}"), F.sum(F.when(F.col(c) > above, F.col(c))).alias(f"sum_{c}"))))
    average = lambda c: F.floor(F.try_divide(F.col(f"sum_{c}") / 1000, F.col(f"count_{c}"))).cast("bigint").alias(f"average_{c}")
    return sums.select("*", average("a"), average("b"))


def area_by(df: DataFrame, *keys: str, value: str = "area") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def extent(features: DataFrame, *keys: str) -> DataFrame:
    """The envelope of envelopes x0, y0, x1, y1."""
    grouped = features.groupBy(*keys) if keys else features
    return grouped.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def outcome_counts(log: DataFrame, status: str = "status") -> DataFrame:
    return log.groupBy(status).agg(F.count("*").alias("n"))
