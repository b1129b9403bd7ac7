"""What is known of each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalise_gaps
from ..sources.shared import dealt, join_frequent

CLUSTER_TYPES = ("genome_linked", "multi_sample", "multi_hit", "single_singleton")


def rep_sample_counts(hits: DataFrame, clusters: DataFrame, strict_raw_members: bool = False) -> DataFrame:
    """AGG-03, JOIN-07, SET-06: distinct samples of each representative.

    Members and windows are compared with gaps as N; strict_raw_members leaves members as they are, so that gapped ones find nothing.
    """
    member = F.col("member") if strict_raw_members else normalise_gaps("member")
    map_ = clusters.select("gene", member.alias("sequence"), "rep").distinct()
    return pairs_of(hits, map_).groupBy("gene", "rep").agg(F.count("sample").alias("n_samples"))


def pairs_of(hits: DataFrame, members: DataFrame) -> DataFrame:
    """JOIN-04, JOIN-07: distinct (gene, rep, sample), dealt by sample. members: (gene, sequence, rep), gaps as N."""
    windows, n = hits.select("gene", "sample", normalise_gaps("sequence").alias("sequence")), hits.count()
    found = join_frequent(windows, members, ["gene", "sequence"], n)
    # a sample is dealt out with all its windows, so what it has often meets in a task of few rows and nowhere before
    return dealt(found.select("gene", "rep", "sample"), "sample", rows=n).distinct()


def cluster_stats(clusters: DataFrame, unique: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """AGG-04, JOIN-06, JOIN-08: one row a representative; members without statistics count as one unknown occurrence of hits 0 and sum 0."""
    u = unique.select("gene", F.col("sequence").alias("member"), "unknown", "hits", "n_occurrences", "sum_hits")
    n = F.coalesce("n_occurrences", F.lit(1))
    out = clusters.join(u, ["gene", "member"], "left").groupBy("gene", "rep").agg(
        F.sum(n).cast("bigint").alias("cluster_size"),
        F.sum(F.when(F.coalesce("unknown", F.lit(1)) == 0, n).otherwise(0)).cast("bigint").alias("n_query"),
        F.max(F.coalesce("hits", F.lit(0))).cast("bigint").alias("max_hits"),
        F.sum(F.coalesce("sum_hits", F.lit(0))).cast("bigint").alias("total_hits"),
    )
    if samples is None:
        return out.withColumn("n_samples", F.col("cluster_size"))
    return out.join(samples, ["gene", "rep"], "left").withColumn("n_samples", F.coalesce("n_samples", "cluster_size"))


def single_read_summary(counts: DataFrame, clusters: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG-05, JOIN-03: clusters, clusters of one read in all, and of one occurrence. Without keys, one row even of no clusters."""
    c = counts.withColumnRenamed("sequence", "member")
    per_rep = clusters.join(c, [*keys, "member"]).groupBy(*keys, "rep").agg(F.sum("sum_hits").alias("hits"), F.sum("n_occurrences").alias("occurrences"))
    return per_rep.groupBy(*keys).agg(
        F.count("*").alias("n_clusters"), F.count_if(F.col("hits") == 1).alias("n_single_read_clusters"), F.count_if(F.col("occurrences") == 1).alias("n_single_occurrence_clusters")
    )


def prevalence(stats: DataFrame) -> DataFrame:
    """AGG-06: clusters of each marker by their number of samples."""
    return stats.groupBy("gene", F.col("n_samples").cast("bigint").alias("sample_count")).agg(F.count("*").alias("species_count"))


def run_summary(hits: DataFrame, stats: DataFrame) -> DataFrame:
    """AGG-33: windows and clusters of each marker, by name; clusters are representatives."""
    a, b = hits.groupBy("gene").agg(F.count("*").alias("num_otus")), stats.groupBy("gene").agg(F.count("*").alias("num_clusters"))
    return a.join(b, "gene", "left").select(F.col("gene").alias("marker"), "num_otus", F.coalesce("num_clusters", F.lit(0)).cast("bigint").alias("num_clusters")).orderBy("marker")


def with_cluster_type(df: DataFrame, status: str = "globdb_status") -> DataFrame:
    """FIL-19: a null status or count falls through to the next test."""
    return df.withColumn(
        "cluster_type", F.when(F.col(status) == "confirmed", CLUSTER_TYPES[0]).when(F.col("n_samples") > 1, CLUSTER_TYPES[1]).when(F.col("total_hits") > 1, CLUSTER_TYPES[2]).otherwise(CLUSTER_TYPES[3])
    )


def type_summary(typed: DataFrame) -> DataFrame:
    """AGG-19"""
    each = [f(c).alias(f"{n}_{c}") for c in ("n_samples", "total_hits") for n, f in (("min", F.min), ("max", F.max), ("median", F.median))]
    return typed.groupBy("gene", "cluster_type").agg(F.count("*").alias("n"), *each)
