"""Cumulative cohort counts over a stream of windows: an extension for sample batches that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalise_gaps


def sample_counts(hits: DataFrame, clusters: DataFrame) -> DataFrame:
    """Running number of distinct samples of each representative; hits is a stream of (gene, sample, sequence), clusters a table. For output mode `update` or `complete`.

    State is kept for every pair of representative and sample: a sample may come again at any time, so there is no watermark to drop it by.
    """
    members = clusters.select("gene", normalise_gaps("member").alias("sequence"), "rep").distinct()
    pairs = hits.select("gene", "sample", normalise_gaps("sequence").alias("sequence")).join(members, ["gene", "sequence"])
    return pairs.dropDuplicates(["gene", "rep", "sample"]).groupBy("gene", "rep").agg(F.count("*").alias("n_samples"))
