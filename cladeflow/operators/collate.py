"""Filtering, ordering and deduplicating windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import domain_of, normalise_gaps, safe_int
from ..sources.shared import dealt
from .numbering import numbered

KNOWN_METHOD = "singlem_query_based"  # fixed value: how the archive marks a taxonomy that came from a known sequence


def on_target(otus: DataFrame, markers: DataFrame) -> DataFrame:
    """FIL-01: units of a marker without domains, of no domain, or of one of the marker's. markers: (gene, domains), one row a marker."""
    m = F.broadcast(markers.select(F.col("gene").alias("__g"), "domains"))
    d = domain_of("taxonomy")
    joined = otus.join(m, otus["gene"] == F.col("__g"), "left")
    keep = (F.coalesce(F.size("domains"), F.lit(0)) <= 0) | d.isNull() | F.array_contains("domains", d)
    return joined.where(keep).drop("__g", "domains")


def universal_markers(markers: DataFrame, needed: tuple[str, ...] = ("Bacteria", "Archaea"), requested: list[str] | None = None) -> DataFrame:
    """FIL-03, SET-03: markers that target all the domains, among the requested ones."""
    out = markers.where(F.size(F.array_except(F.array(*map(F.lit, needed)), "domains")) == 0).select("gene")
    return out.where(F.col("gene").isin(requested)) if requested is not None else out


def known_rank(method: Column | str = "taxonomy_assignment_method") -> Column:
    """FIL-05: 0 for a known taxonomy, 1 for others and null."""
    c = F.col(method) if isinstance(method, str) else method
    return F.when(c.eqNullSafe(F.lit(KNOWN_METHOD)), 0).otherwise(1)


def indexed(otus: DataFrame, keys: tuple[str, ...] = ("sample", "gene"), ordinal: tuple[str, ...] = ("ordinal",), position: str | None = None) -> DataFrame:
    """SRT-01, WIN-04, FIL-04: the place in sample and marker, known first and then by hits; dropped windows keep their place.

    With `position` there is a column of that name too, a number that grows with the keys and the place.
    """
    rows, order = otus.select("*", known_rank().alias("unknown"), safe_int("num_hits").alias("hits")), ["unknown", F.col("hits").desc(), *ordinal]
    if position is None:
        ranked = dealt(rows, *keys, rows=otus.count())
    else:
        ranges = dealt(rows, *keys, rows=otus.count(), ranges=True)
        ranked = ranges.sortWithinPartitions(*keys, *order).withColumn(position, F.monotonically_increasing_id())
    ranked = ranked.withColumn("otu_idx", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    return ranked.where("sequence IS NOT NULL AND sequence NOT IN ('', '-')")


def dedup(hits: DataFrame, position: Column) -> DataFrame:
    """AGG-02, WIN-03: unique windows of each marker with counts, numbered by where they come first.

    hits: (gene, sequence, unknown, hits); position: a total order, best a number (as of `indexed`): the least text or struct is not
    aggregated by hash, so all rows would be sorted. Sums are kept: the occurrences add up to the rows.
    """
    unique = hits.groupBy("gene", "sequence").agg(
        F.min(position).alias("first_pos"), F.min("unknown").alias("unknown"), F.max("hits").alias("hits"), F.count("*").alias("n_occurrences"), F.sum("hits").cast("bigint").alias("sum_hits")
    )
    return numbered(unique, ["first_pos"], ("gene",), "seq_num", 0).drop("first_pos")


def counts_table(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG-01: occurrences and hits of each sequence."""
    return rows.groupBy(*keys, "sequence").agg(F.sum("n_occurrences").cast("bigint").alias("n_occurrences"), F.sum("sum_hits").cast("bigint").alias("sum_hits"))


def rows_of(hits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """SRC-18: windows as rows for `counts_table`, gaps as N."""
    return hits.select(*keys, normalise_gaps("sequence").alias("sequence"), F.lit(1).cast("bigint").alias("n_occurrences"), F.col("num_hits").cast("bigint").alias("sum_hits"))


def keep_samples(hits: DataFrame, metadata: DataFrame, organism: str = "human gut metagenome") -> DataFrame:
    """FIL-07, JOIN-17: windows of the samples of an organism."""
    listed = metadata.where(F.col("organism") == organism).select(F.col("acc").alias("sample"))
    return hits.join(listed, "sample", "left_semi")


def keep_centroids(hits: DataFrame, centroids: DataFrame) -> DataFrame:
    """JOIN-26: records whose window, gaps as N, is a centroid of its marker."""
    c = centroids.select(F.col("gene"), F.col("rep").alias("__rep")).distinct()
    return hits.join(c, (hits["gene"] == c["gene"]) & (normalise_gaps(hits["sequence"]) == F.col("__rep")), "left_semi")


def chunk(unique: DataFrame, start: int, size: int) -> DataFrame:
    """SRT-08: windows numbered from start on."""
    return unique.where(F.col("seq_num").between(start, start + size - 1))
