"""Commands on feature tables: create, upload, keyword index, index, statistics."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from landgrid.operators.features import scan
from landgrid.operators.keyword import build_keyword_index
from landgrid.operators.spatial import build_index, with_index
from landgrid.operators.stats import category_stats, rollup_percent
from landgrid.sources.records import extract_records, features_of, loader_records, read_lines, split_rejects
from landgrid.sources.sinks import write_features, write_index


def upload(spark: SparkSession, source: str, target: str, layout: str = "loader") -> tuple[int, int]:
    """Adds the features of record files to a table; returns how many were written and how many records made none."""
    records = (loader_records if layout == "loader" else extract_records)(read_lines(spark, source))
    good, bad = split_rejects(features_of(records))
    write_features(with_index(good), target, "append")
    return good.count(), bad.count()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="landgrid")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("upload", "add record files to a feature table"), ("check", "count records that make no feature"), ("index", "build the spatial index"), ("keywords", "build the keyword index"), ("stats", "statistics by category")):
        command = commands.add_parser(name, help=text)
        command.add_argument("source")
        if name in ("upload", "index", "keywords"):
            command.add_argument("target")
        if name in ("upload", "check"):
            command.add_argument("--layout", choices=("loader", "extract"), default="loader")
        if name == "stats":
            command.add_argument("--region")
            command.add_argument("--category", action="append")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("landgrid").getOrCreate()
    if args.command == "upload":
        good, bad = upload(spark, args.source, args.target, args.layout)
        print(f"{good} features written, {bad} records left out")
        return 0
    if args.command == "check":
        records = (loader_records if args.layout == "loader" else extract_records)(read_lines(spark, args.source))
        split_rejects(features_of(records))[1].groupBy("error").agg(F.count("*").alias("n")).show()
        return 0
    features = spark.read.parquet(args.source)
    if args.command == "index":
        write_index(build_index(features), args.target)
    elif args.command == "keywords":
        build_keyword_index(features).write.mode("overwrite").parquet(args.target)
    else:
        rollup_percent(category_stats(scan(features, args.region, args.category))).orderBy("category").show(200)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
