"""Databases and tables: create, list, drop, fill with test rows, show."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE_COLUMNS = (
    "rowkey STRING, region12 STRING, category STRING, fid STRING, caption STRING, properties MAP<STRING, STRING>, feature_type STRING, geom BINARY, srid INT, "
    "xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE, position STRUCT<x: DOUBLE, y: DOUBLE>, cnt BIGINT, area DOUBLE, length DOUBLE, zvalue BIGINT, province STRING"
)
INDEX_COLUMNS = "zvalue BIGINT, level INT, category STRING, rowkey STRING, cat2 STRING"


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def drop_database(spark: SparkSession, name: str, with_tables: bool = False) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` {'CASCADE' if with_tables else 'RESTRICT'}")


def create_feature_table(spark: SparkSession, name: str) -> None:
    """An empty feature table, partitioned by province."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({FEATURE_COLUMNS}) USING parquet PARTITIONED BY (province)")


def create_index_table(spark: SparkSession, name: str) -> None:
    """An empty spatial index, partitioned by level-1 category."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({INDEX_COLUMNS}) USING parquet PARTITIONED BY (cat2)")


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Without views of the session."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def sample_rows(spark: SparkSession, first: int, last: int, columns: Iterable[str], random: bool = False, seed: int = 0) -> DataFrame:
    """rowkey from first to last and a value for each column: the key itself, or a random number below 1000."""
    rows = spark.range(first, last + 1)
    value = (lambda i: F.floor(F.rand(seed + i) * 1000).cast("string")) if random else (lambda i: F.col("id").cast("string"))
    return rows.select(F.col("id").cast("string").alias("rowkey"), *(value(i).alias(c) for i, c in enumerate(columns)))


def put(spark: SparkSession, name: str, rows: DataFrame) -> None:
    rows.write.mode("append").insertInto(name) if exists(spark, name) else rows.write.saveAsTable(name)


def dump(spark: SparkSession, name: str, keys: Iterable[str] | None = None) -> DataFrame:
    """rowkey, column and value of every filled cell, as text."""
    table = spark.table(name)
    chosen = table.filter(F.col("rowkey").isin(sorted(set(keys)))) if keys is not None else table
    names = [c for c in table.columns if c != "rowkey"]
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names))
    return chosen.select("rowkey", F.explode(cells).alias("c")).select("rowkey", "c.column", "c.value").filter("value is not null")
