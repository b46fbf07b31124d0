"""Tab-separated feature records in the layouts of loaders, extracts, cells and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions import st
from landgrid.functions.codes import UNCLASSIFIED, UNNAMED, row_key, standard_category, standard_region
from landgrid.functions.sheets import central_meridian
from landgrid.functions.text import one_line, property_map

#: The last columns of a loader record; what comes before are properties (name:value).
TAIL = ("length", "area", "fid", "region", "caption", "category", "geo_type", "wkt")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def loader_records(lines: DataFrame) -> DataFrame:
    """Columns of loader records, counted from the end, and the properties' text."""
    parts = F.split("line", "\t")
    n = F.size("p")
    tail = [F.get("p", n - len(TAIL) + i).alias(c) for i, c in enumerate(TAIL)]
    head = F.array_join(F.slice("p", F.lit(1), F.greatest(n - len(TAIL), F.lit(0))), "\t")
    return lines.select("line", parts.alias("p")).select("line", n.alias("n_values"), head.alias("properties_text"), *tail)


def extract_records(lines: DataFrame) -> DataFrame:
    """Records of row key, attributes and WKT, as loader columns."""
    parts = F.split(one_line(F.col("line")), "\t")
    key = F.get(parts, 0)
    return lines.select("line", F.size(parts).alias("n_values"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "\t").alias("properties_text"),
        F.lit(None).cast("string").alias("length"), F.lit(None).cast("string").alias("area"), F.substring(key, 17, 8).alias("fid"), F.substring(key, 1, 12).alias("region"),
        F.lit(None).cast("string").alias("caption"), F.substring(key, 13, 4).alias("category"), F.lit("POLYGON").alias("geo_type"), F.get(parts, F.size(parts) - 1).alias("wkt"))


def features_of(records: DataFrame) -> DataFrame:
    """Feature rows, and ``error`` for records that make none: no geometry, or a category that isn't a number.

    A category of less than two characters counts as unclassified, an empty caption as unnamed.
    """
    raw = records.withColumn("category", F.when(F.length(F.trim(F.coalesce("category", F.lit("")))) < 2, UNCLASSIFIED).otherwise(F.trim("category")))
    raw = raw.withColumn("caption", F.when(F.trim(F.coalesce("caption", F.lit(""))) == "", UNNAMED).otherwise(F.col("caption")))
    raw = raw.withColumn("geom", st.st_try_from_wkt("wkt"))
    error = F.when(F.col("geom").isNull(), "geometry").when(~F.col("category").rlike(r"^\d+$"), "category")
    parsed = raw.withColumn("error", error).withColumn("_box", st.st_envelope("geom")).withColumn("_at", st.st_label_point("geom"))
    return parsed.select(
        row_key(standard_region("region", 12), standard_category("category"), "fid").alias("rowkey"), standard_region("region", 12).alias("region12"), standard_category("category").alias("category"),
        F.col("fid"), "caption", property_map(F.col("properties_text")).alias("properties"), F.upper("geo_type").alias("feature_type"), "geom",
        *(F.col(f"_box.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), F.col("_at").alias("position"), F.lit(1).cast("bigint").alias("cnt"),
        F.coalesce(F.expr("try_cast(area AS double)"), st.st_area("geom")).alias("area"), F.coalesce(F.expr("try_cast(length AS double)"), st.st_length("geom")).alias("length"), "error", "line",
    )


def with_metric_measures(features: DataFrame) -> DataFrame:
    """area and length in metres, in the 6-degree zone of each feature's representative point."""
    moved = features.withColumn("_m", st.st_to_zone("geom", central_meridian(F.col("position.x"))))
    return moved.withColumns({"area": st.st_area("_m"), "length": st.st_length("_m")}).drop("_m")


def split_rejects(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good features, and the lines that made none with their error."""
    return features.filter("error is null").drop("error", "line"), features.filter("error is not null").select("line", "error")


def wkt_lines(spark: SparkSession, path: str) -> DataFrame:
    """geom of each line of WKT that begins as a polygon."""
    lines = read_lines(spark, path).filter(st.valid_wkt("line"))
    return lines.select(st.st_try_from_wkt("line").alias("geom")).filter("geom is not null")


def feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """Lines by input file."""
    return spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))


def small_files(spark: SparkSession, path: str, bytes_per_task: int = 128 << 20) -> DataFrame:
    """Lines of many small files, packed together into tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_per_task))
    spark.conf.set("spark.sql.files.openCostInBytes", "65536")
    return read_lines(spark, path)
