"""Occurrence histograms by cohort, cumulative year and taxonomy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import normalise_gaps
from .clusterstats import pairs_of

HUMAN = "human gut metagenome"


def valid_year(c: Column | str = "year") -> Column:
    """FIL-15: an integer if the year is all digits, else null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))


def with_metadata(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """JOIN-05: windows with their sample's year and organism, null without metadata. metadata has one row an acc."""
    m = metadata.select(F.col("acc").alias("sample"), "year", "organism", F.lit(True).alias("found"))
    return hits.join(m, "sample", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def tagged(hits: DataFrame, clusters: DataFrame, metadata: DataFrame, human: str = HUMAN) -> DataFrame:
    """JOIN-04, AGG-07: distinct (gene, rep, sample, stratum, value). human_all needs no year, the others do."""
    members = clusters.select("gene", normalise_gaps("member").alias("sequence"), "rep").distinct()
    full = with_metadata(pairs_of(hits, members), metadata).withColumn("y", valid_year())
    is_human = F.coalesce(F.col("organism") == human, F.lit(False))
    tags = F.array_compact(F.array(
        F.when(F.col("y").isNotNull(), F.struct(F.lit("year").alias("stratum"), F.col("y").alias("value"))),
        F.when(is_human, F.struct(F.lit("human_all").alias("stratum"), F.lit(None).cast("int").alias("value"))),
        F.when(is_human & F.col("y").isNotNull(), F.struct(F.lit("human_per_year").alias("stratum"), F.col("y").alias("value"))),
    ))
    return full.select("gene", "rep", "sample", F.explode(tags).alias("t")).select("gene", "rep", "sample", "t.stratum", "t.value")


def histogram(tags: DataFrame, metadata: DataFrame) -> DataFrame:
    """AGG-08, AGG-09, WIN-02: clusters by their number of samples, in each stratum; years are cumulative.

    A running sum over a representative's own years holds until its next year, so each of its steps is
    joined to the metadata years it covers. The years are few: one row each.
    """
    per = tags.groupBy("gene", "rep", "stratum", "value").agg(F.count("*").alias("n"))
    over = W.partitionBy("gene", "rep", "stratum").orderBy("value")
    steps = per.select(
        "gene", "stratum", "value", F.sum("n").over(over.rowsBetween(W.unboundedPreceding, 0)).alias("sample_count"), F.lead("value").over(over).alias("until")
    )
    # steps that share all of this are counted before they are spread over years; a stratum has either years or none
    steps = steps.groupBy("gene", "stratum", "value", "until", "sample_count").agg(F.count("*").alias("reps"))
    years = metadata.select(valid_year().alias("cut")).where("cut IS NOT NULL").distinct()
    all_years = years.agg(F.array_sort(F.collect_set("cut")).alias("years"))
    covered = F.filter("years", lambda y: (y >= F.col("value")) & (F.col("until").isNull() | (y < F.col("until"))))
    values = F.when(F.col("value").isNull(), F.array(F.lit("all"))).otherwise(covered.cast("array<string>"))
    spread = steps.crossJoin(F.broadcast(all_years)).select("gene", "stratum", "sample_count", "reps", F.explode(values).alias("stratum_value"))
    return spread.groupBy("gene", "stratum", "stratum_value", "sample_count").agg(F.sum("reps").alias("species_count"))


def taxonomy_histogram(reps: DataFrame) -> DataFrame:
    """AGG-10, JOIN-24: from (gene, n_samples, domain, phylum), clusters by domain and by phylum; null names are kept as null, representatives without n_samples left out."""
    long = reps.where("n_samples IS NOT NULL").select("gene", F.expr("stack(2, 'domain', domain, 'phylum', phylum) AS (stratum, stratum_value)"), F.col("n_samples").cast("bigint").alias("sample_count"))
    return long.groupBy("gene", "stratum", "stratum_value", "sample_count").agg(F.count("*").alias("species_count"))


def merge(*histograms: DataFrame) -> DataFrame:
    """AGG-11: histograms of parts, added up. Right for parts that share no representative, see `check_disjoint`; `sample_sets` merges others."""
    whole = histograms[0]
    for h in histograms[1:]:
        whole = whole.unionByName(h)
    keys = [c for c in whole.columns if c != "species_count"]
    return whole.groupBy(*keys).agg(F.sum("species_count").cast("bigint").alias("species_count"))


def check_disjoint(*representatives: DataFrame) -> None:
    """AGG-11: raises if parts share a representative, so that their histograms can't be added up; each part: (gene, rep)."""
    rows = reduce(DataFrame.unionByName, [r.select("gene", "rep", F.lit(k).alias("part")) for k, r in enumerate(representatives)])
    shared = rows.groupBy("gene", "rep").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").take(5)
    if shared:
        raise ValueError(f"parts share representatives: {[(r.gene, r.rep, r.a, r.b) for r in shared]}")


def summarise(all_samples: DataFrame, strata: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One table of all histograms, with the stratum `all` for all samples."""
    top = all_samples.select("gene", F.lit("all").alias("stratum"), F.lit("all").alias("stratum_value"), "sample_count", "species_count")
    return top.unionByName(strata).unionByName(taxonomy).where("sample_count > 0 AND species_count > 0").withColumnRenamed("gene", "marker")
