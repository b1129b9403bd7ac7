"""Distance histograms of reference windows, within and between species."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import normalise_gaps, packed_bases, packed_hamming, species_of

MAX_DISTANCE = 15
MAX_MARKER = 13


def numbered_markers(df: DataFrame, most: int = MAX_MARKER) -> DataFrame:
    """FIL-16: markers S3.n of n up to a number."""
    n = F.get(F.split("marker", "[.]"), F.lit(1)).try_cast("int")
    return df.where(F.col("marker").startswith("S3.") & (n <= most))


def reference_windows(otus: DataFrame, taxonomy: DataFrame, markers: DataFrame) -> DataFrame:
    """SRC-09, JOIN-18: (marker, species, sequence) of all genome windows, gaps as N."""
    return otus.join(taxonomy.withColumnRenamed("id", "taxonomy_id"), "taxonomy_id").join(F.broadcast(numbered_markers(markers)).withColumnRenamed("id", "marker_id"), "marker_id").select(
        "marker", species_of("taxonomy").alias("species"), normalise_gaps("sequence").alias("sequence")
    )


def modal_length(windows: DataFrame, distinct: bool = True) -> DataFrame:
    """AGG-27: (marker, window), the commonest length of distinct windows of species or of all rows; the shortest of equals."""
    rows = windows.distinct() if distinct else windows
    n = rows.groupBy("marker", F.length("sequence").alias("window")).agg(F.count("*").alias("n"))
    first = F.row_number().over(W.partitionBy("marker").orderBy(F.col("n").desc(), "window"))
    return n.withColumn("place", first).where("place = 1").select("marker", "window")


def species_windows(windows: DataFrame) -> DataFrame:
    """Distinct windows of the modal length of each species."""
    unique = windows.distinct()
    return unique.join(F.broadcast(modal_length(windows)), "marker").where(F.length("sequence") == F.col("window")).drop("window")


def sampled(df: DataFrame, keys: list[str], by: str, n: int, seed: int = 0) -> DataFrame:
    """SRT-09: n rows of each group by a seeded hash that SQL engines share, the same ones every time."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(by))), by))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def _words(unique: DataFrame) -> int:
    """The words of 30 bases that hold the longest window."""
    return max(1, -(-(unique.agg(F.max(F.length("sequence"))).first()[0] or 0) // 30))


def intra(unique: DataFrame, most: int = 1000, seed: int = 0) -> DataFrame:
    """JOIN-20, AGG-28: (marker, metric, distance, count) of pairs of a species and of species' diameters; at most `most` windows a species are compared, by hash."""
    words = _words(unique)
    s = sampled(unique, ["marker", "species"], "sequence", most, seed).select("marker", "species", "sequence", packed_bases("sequence", words).alias("bits"))
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(b, (F.col("a.marker") == F.col("b.marker")) & (F.col("a.species") == F.col("b.species")) & (F.col("a.sequence") < F.col("b.sequence")))
    d = F.least(packed_hamming("a.bits", "b.bits", words), F.lit(MAX_DISTANCE))
    per = pairs.groupBy("a.marker", "a.species", d.alias("distance")).agg(F.count("*").alias("n"))
    pair = per.groupBy("marker", "distance").agg(F.sum("n").alias("count")).select("marker", F.lit("intra_pair").alias("metric"), "distance", "count")
    diameter = unique.select("marker", "species").distinct().join(per.groupBy("marker", "species").agg(F.max("distance").alias("m")), ["marker", "species"], "left")
    diameter = diameter.groupBy("marker", F.coalesce("m", F.lit(0)).alias("distance")).agg(F.count("*").alias("count")).select("marker", F.lit("intra_diameter").alias("metric"), "distance", "count")
    return pair.unionByName(diameter)


def species_representative(unique: DataFrame) -> DataFrame:
    """SRT-07: the least window of each species."""
    return unique.groupBy("marker", "species").agg(F.min("sequence").alias("sequence"))


def inter(unique: DataFrame, n_species: int = 100, seed: int = 0) -> DataFrame:
    """JOIN-21, AGG-29: sampled species against all others, one window each. Queries are broadcast up to n_species * MAX_MARKER, as counted, and shuffled beyond."""
    words = _words(unique)
    reps = species_representative(unique).select("marker", "species", packed_bases("sequence", words).alias("bits"))
    queries = sampled(reps, ["marker"], "species", n_species, seed)
    few = queries.count() <= n_species * MAX_MARKER
    q, r = (F.broadcast(queries) if few else queries).alias("q"), reps.alias("r")
    pairs = r.join(q, (F.col("q.marker") == F.col("r.marker")) & (F.col("q.species") != F.col("r.species")))
    d = packed_hamming("q.bits", "r.bits", words)
    per = pairs.groupBy(F.col("q.marker").alias("marker"), F.col("q.species").alias("species"), d.alias("distance")).agg(F.count("*").alias("n"))
    capped = F.least(F.col("distance"), F.lit(MAX_DISTANCE))
    every = per.groupBy("marker", capped.alias("distance")).agg(F.sum("n").alias("count")).select("marker", F.lit("inter_sampled_all").alias("metric"), "distance", "count")
    near = per.groupBy("marker", "species").agg(F.min("distance").alias("distance")).groupBy("marker", capped.alias("distance")).agg(F.count("*").alias("count"))
    return every.unionByName(near.select("marker", F.lit("inter_sampled_nearest").alias("metric"), "distance", "count"))


def distances(windows: DataFrame, n_species: int = 100, seed: int = 0) -> DataFrame:
    """CLU-08: all six metrics."""
    unique = species_windows(windows)
    size = windows.groupBy("marker").agg(F.count("*").alias("count")).select("marker", F.lit("n_genome_windows").alias("metric"), F.lit(0).alias("distance"), "count")
    species = unique.groupBy("marker").agg(F.countDistinct("species").alias("count")).select("marker", F.lit("n_species").alias("metric"), F.lit(0).alias("distance"), "count")
    return size.unionByName(species).unionByName(intra(unique, seed=seed)).unionByName(inter(unique, n_species, seed))
