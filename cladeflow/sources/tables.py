"""Tab-separated tables, metadata, histograms and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COUNTS = "sequence string, n_occurrences bigint, sum_hits bigint"
CLUSTERS = "member string, rep string"


def read_tsv(spark: SparkSession, paths: str | list[str], schema: str, header: bool = True, columns: list[str] | None = None) -> DataFrame:
    """SRC-07, SRC-08, SRC-17: one or many files of one schema, only the columns asked for."""
    df = spark.read.csv(paths, sep="\t", header=header, schema=schema)
    return df.select(*columns) if columns else df


def read_clusters(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Headerless member, representative pairs."""
    return read_tsv(spark, paths, CLUSTERS, header=False)


def concatenate(spark: SparkSession, paths: list[str], schema: str, to: str) -> None:
    """SRC-17: files of one schema with a header each as one table with one header a part file; a missing path is an error."""
    read_tsv(spark, paths, schema).write.csv(to, sep="\t", header=True)


def write_intermediate(df: DataFrame, path: str, order: str | None = None) -> None:
    """SRC-12: Parquet with zstd; rows that belong together by `order` lie together, so that slices skip most row groups."""
    rows = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
    rows.write.option("compression", "zstd").parquet(path)


def read_slice(spark: SparkSession, path: str, columns: list[str], by: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """SRC-12: some columns of the rows of a range, ends included; without ends, all rows. Range and columns reach the scan."""
    df = spark.read.parquet(path)
    for keep in (F.col(by) >= low if low is not None else None, F.col(by) <= high if high is not None else None):
        df = df.where(keep) if keep is not None else df
    return df.select(*columns)


def export_metadata(metadata: DataFrame, attributes: DataFrame) -> DataFrame:
    """SRC-10, JOIN-19: acc, year, organism of every sample."""
    m, a = metadata.alias("m"), attributes.alias("a")
    return m.join(a, F.col("a.run_id") == F.col("m.id"), "left").select(
        F.col("m.acc").alias("acc"), F.col("a.collection_year").alias("year"), F.col("m.taxon_name").alias("organism")
    )


def load_metadata(rows: DataFrame, order: str | None = None) -> DataFrame:
    """SRC-11: empty values are null; of a repeated acc the last row counts (by `order`, or reading order)."""
    if set(rows.columns) - {order} != {"acc", "year", "organism"}:
        raise ValueError(f"metadata has the columns {rows.columns}")
    clean = [F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("year", "organism")]
    place = F.col(order) if order else F.monotonically_increasing_id()
    rows = rows.select("acc", *clean, place.alias("__place"))
    last = F.row_number().over(W.partitionBy("acc").orderBy(F.col("__place").desc()))
    return rows.withColumn("__last", last).where("__last = 1").drop("__place", "__last")


HISTOGRAM = ("stratum", "stratum_value", "sample_count", "species_count")


def read_histogram(df: DataFrame) -> DataFrame:
    """SRC-26: the count column may have its older name `cluster_count`."""
    name = "species_count" if "species_count" in df.columns else "cluster_count"
    return df.select("stratum", "stratum_value", F.col("sample_count").cast("bigint"), F.col(name).cast("bigint").alias("species_count"))


def write_histogram(df: DataFrame) -> DataFrame:
    """FIL-20, SRT-03: rows with counts, in order."""
    return df.where((F.col("sample_count") > 0) & (F.col("species_count") > 0)).orderBy("stratum", "stratum_value", "sample_count")


def find_markers(df: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """SRC-19, SET-04: sorted marker names; a requested one that is missing is an error."""
    found = df.select("gene").distinct().where(F.col("gene").rlike(r"^S\d+\."))
    if requested is not None:
        wanted = found.sparkSession.createDataFrame([(x,) for x in requested], "gene string").distinct()
        missing = [r.gene for r in wanted.join(found, "gene", "left_anti").take(20)]
        if missing:
            raise ValueError(f"markers not found: {missing}")
        found = found.join(F.broadcast(wanted), "gene", "left_semi")
    return found.orderBy("gene")


def sample_list(paths: DataFrame, n: int = 100) -> DataFrame:
    """SRC-21: sample names of the first n paths."""
    return paths.orderBy("path").limit(n).select(F.regexp_extract("path", r"([^/]+).json", 1).alias("sample"))


def shard(path: str = "path"):
    """SRC-20: the first five characters of a sample's name."""
    from ..functions.scalars import sample_name

    return F.substring(sample_name(path), 1, 5)
