"""Benchmark logs and the first lines of archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = "yyyy/MM/dd hh:mm:ss a"


def query_seconds(lines: DataFrame) -> DataFrame:
    """SRC-22: from (file, n, value), seconds between a file's first and last line with "query"; one such line is an error."""
    hits = lines.where(F.lower("value").contains("query")).select("file", "n", F.to_timestamp(F.substring("value", 1, 22), STAMP).alias("at"))
    ends = hits.groupBy("file").agg(F.count("*").alias("lines"), F.min_by("at", "n").alias("first"), F.max_by("at", "n").alias("last"))
    checked = F.when(F.col("lines") < 2, F.raise_error(F.concat(F.lit("fewer than two query lines in "), F.col("file"))).cast("bigint"))
    return ends.select("file", checked.otherwise(F.unix_timestamp("last") - F.unix_timestamp("first")).alias("seconds"))


def count_in_first_line(lines: DataFrame, word: str = "Root") -> DataFrame:
    """SRC-23: from (file, n, value), how often a word is in each file's first line."""
    first = lines.groupBy("file").agg(F.min_by("value", "n").alias("value"))
    return first.select("file", F.regexp_count("value", F.lit(word)).cast("bigint").alias("size"))


def read_benchmarks(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """SRC-24, RSH-07: many benchmark files in one scan, with the sample in each file's name."""
    df = spark.read.csv(paths, sep="\t", header=True, schema=schema)
    return df.select(F.regexp_extract("_metadata.file_path", r"([^/.]+)[^/]*$", 1).alias("sample"), "*")
