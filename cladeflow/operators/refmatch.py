"""Matching representatives to a reference set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import known_bases, normalise_gaps, packed_bases, taxonomy_token
from ..sources.shared import cut
from .clustering import differences_in, differing, near_pairs


def best_hits(hits: DataFrame, queries: DataFrame | None = None, max_divergence: int | None = None) -> DataFrame:
    """WIN-05, CLU-06: of (query, divergence, taxonomy, ordinal) the least divergent row, the first of equals.

    A hit of an unknown query, or beyond the maximum, raises when the rows are read.
    """
    for c in ("query", "divergence", "taxonomy", "ordinal"):
        if c not in hits.columns:
            raise ValueError(f"hits have no column {c}")
    if max_divergence is not None:
        bad = F.col("divergence").isNull() | (F.col("divergence") < 0) | (F.col("divergence") > max_divergence)
        hits = hits.withColumn("divergence", F.when(bad, F.raise_error(F.concat(F.lit("divergence out of range: "), F.coalesce(F.col("query"), F.lit("null")))).cast("int")).otherwise(F.col("divergence")))
    if queries is not None:
        known = queries.select(F.col("id").alias("query"), F.lit(True).alias("known"))
        hits = hits.join(known, "query", "left")
        hits = hits.withColumn("query", F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("unknown query: "), F.col("query")))).otherwise(F.col("query"))).drop("known")
    first = F.row_number().over(W.partitionBy("query").orderBy("divergence", "ordinal"))
    return hits.withColumn("place", first).where("place = 1").select("query", "divergence", "taxonomy")


def nearest(queries: DataFrame, reference: DataFrame, max_divergence: int = 2, window: int = 60) -> DataFrame:
    """JOIN-22, CLU-07: the nearest reference window of each query, the least id of equals. queries: (gene, id, sequence); reference: (gene, id, sequence, taxonomy)."""
    q = queries.select("gene", "id", normalise_gaps("sequence").alias("sequence"))
    r = reference.select("gene", "id", normalise_gaps("sequence").alias("sequence"))
    pairs = near_pairs(q, r, max_divergence, window)
    best = pairs.groupBy("gene", "a").agg(F.min(F.struct("divergence", "b")).alias("m"))
    names = reference.select(F.col("gene"), F.col("id").alias("ref_id"), "taxonomy")
    return best.select("gene", F.col("a").alias("query"), F.col("m.divergence").cast("int").alias("divergence"), F.col("m.b").alias("ref_id")).join(shuffled(names), ["gene", "ref_id"])


#: Distances that are searched one after the other, each for what the one before left open.
RADII = (2, 4, 8)
#: Searched before the first of them: windows one base apart share longer blocks, and so meet far fewer others.
NEAREST = 1
BASES = "ACGTN"


def shuffled(df: DataFrame) -> DataFrame:
    """The rows, to be joined by shuffle. They grow with the input, and shuffled windows are so much smaller than in memory that Spark would send them all through the driver."""
    return df.hint("merge")


def _variants(part: Column, size: int) -> Column:
    """A string and all that differ from it in one place."""
    each = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.transform(F.array(*map(F.lit, BASES)), lambda c: F.overlay(part, c, i, F.lit(1)))))
    return F.concat(F.array(part), F.filter(each, lambda x: x != part))


def far_pairs(left: DataFrame, right: DataFrame, radius: int, window: int = 60) -> DataFrame:
    """Pairs (gene, a, b, divergence) within a wide distance; left and right: (gene, id, sequence), the left side small.

    In one of radius // 2 + 1 blocks the two differ in one place at most. The right side is entered once a block, and the left
    side looks it up with all variants of its block, so long blocks do what many short ones would. A pair is kept in the first
    block in which it is that near. Letters other than A, C, G and T are one unknown base, N.
    """
    n, words = radius // 2 + 1, -(-window // 30)
    edges = [window * i // n for i in range(n + 1)]

    def side(df: DataFrame, name: str, keys: list[Column]) -> DataFrame:
        rows = df.where(F.length("sequence") == window).select("gene", F.col("id").alias(name), known_bases("sequence").alias("sequence"))
        rows = rows.select("gene", name, packed_bases("sequence", words).alias("bits"), F.explode(F.array(*keys)).alias("x"))
        rows = rows.select("gene", "x.block", F.explode("x.parts").alias("part"), name, *[F.col("bits")[i].alias(f"{name}{i}") for i in range(2 * words)])
        return rows.withColumn("part", F.xxhash64("part"))

    blocks = [(k, F.substring("sequence", a + 1, b - a), b - a) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    entered = side(right, "b", [F.struct(F.lit(k).alias("block"), F.array(part).alias("parts")) for k, part, _ in blocks])
    asked = side(left, "a", [F.struct(F.lit(k).alias("block"), _variants(part, size).alias("parts")) for k, part, size in blocks])
    met = shuffled(asked).join(shuffled(entered), ["gene", "block", "part"])
    met = met.select("gene", "block", "a", "b", *[d.alias(f"d{w}") for w, d in enumerate(differing(words))])
    divergence = sum((F.bit_count(f"d{w}") for w in range(words)), F.lit(0))
    first = F.lit(n)
    for k in reversed(range(n)):
        first = F.when(differences_in(edges[k], edges[k + 1], words) <= 1, k).otherwise(first)
    return met.where((divergence <= radius) & (first == F.col("block"))).select("gene", "a", "b", divergence.alias("divergence"))


def nearest_widening(queries: DataFrame, reference: DataFrame, radii: tuple[int, ...] = RADII, window: int = 60) -> DataFrame:
    """CLU-07, JOIN-22: every query with its nearest reference window within the last radius, the least id of equals, and its taxonomy.

    (gene, query, divergence, ref_id, taxonomy, status): status is `matched`, `none_within_D`, or `other_length` for windows that can't
    be compared. What is within a radius is found whole, so a wider one is tried only for the rest.
    """
    if not radii or list(radii) != sorted(set(radii)) or radii[0] < 0:
        raise ValueError("radii must grow from 0 or more")
    q = queries.select("gene", "id", normalise_gaps("sequence").alias("sequence"))
    # equal windows are searched, and found, once
    asked = cut(q.where(F.length("sequence") == window).groupBy("gene", "sequence").agg(F.min("id").alias("id")))
    known = cut(reference.select("gene", "id", normalise_gaps("sequence").alias("sequence")).where(F.length("sequence") == window).groupBy("gene", "sequence").agg(F.min("id").alias("id")))
    open_, found, n_known = asked, [], known.count()
    for radius in [*([NEAREST] if radii[0] > NEAREST else []), *radii]:
        if radius <= 2:
            pairs = near_pairs(open_, known, radius, window)
        elif open_.count() <= n_known:
            pairs = far_pairs(open_, known, radius, window)
        else:  # the smaller side is looked up with all its variants
            pairs = far_pairs(known, open_, radius, window).select("gene", F.col("b").alias("a"), F.col("a").alias("b"), "divergence")
        best = cut(pairs.groupBy("gene", F.col("a").alias("id")).agg(F.min(F.struct("divergence", "b")).alias("m")))
        found.append(best)
        open_ = cut(open_.join(shuffled(best), ["gene", "id"], "left_anti"))
        if open_.isEmpty():
            break
    best = reduce(DataFrame.unionByName, found).join(shuffled(asked), ["gene", "id"]).select("gene", "sequence", F.col("m.divergence").cast("int").alias("divergence"), F.col("m.b").alias("ref_id"))
    names = reference.select("gene", F.col("id").alias("ref_id"), "taxonomy")
    out = q.join(shuffled(best), ["gene", "sequence"], "left").join(shuffled(names), ["gene", "ref_id"], "left")
    status = F.when(F.col("divergence").isNotNull(), "matched").when(F.length("sequence") == window, f"none_within_{radii[-1]}").otherwise("other_length")
    return out.select("gene", F.col("id").alias("query"), "divergence", "ref_id", "taxonomy", status.alias("status"))


def assign_taxonomy(queries: DataFrame, reference: DataFrame, radii: tuple[int, ...] = RADII, window: int = 60) -> DataFrame:
    """CLU-07: every representative with the domain and phylum of its nearest reference window, null without one."""
    near = nearest_widening(queries, reference, radii, window)
    return near.select("gene", F.col("query").alias("id"), "divergence", "status", taxonomy_token("taxonomy", "d__").alias("domain"), taxonomy_token("taxonomy", "p__").alias("phylum"))


def matches(representatives: DataFrame, best: DataFrame) -> DataFrame:
    """JOIN-09, JOIN-25: every representative with its status; a hit without a species name confirms all the same."""
    b = best.select(F.col("query").alias("id"), "divergence", "taxonomy")
    status = F.when(F.col("divergence").isNotNull(), "confirmed").otherwise("no_match")
    species = taxonomy_token("taxonomy", "s__")
    return representatives.select("id", "sequence").join(b, "id", "left").select("id", "sequence", status.alias("globdb_status"), "divergence", species.alias("species"), "taxonomy")


def match_summary(matched: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG-18: counts, distinct species, hits of each divergence, and the fraction confirmed (null of nothing)."""
    ok = F.col("globdb_status") == "confirmed"
    per = matched.groupBy(*keys, "divergence").agg(F.count("*").alias("n"), F.count_if(ok).alias("c"), F.count_if(ok & F.col("species").isNotNull()).alias("s"))
    # distinct species on their own, so that neither aggregation expands the other
    species = matched.where(ok).groupBy(*keys).agg(F.countDistinct("species").alias("distinct_matched_species"))
    total = per.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("raw_clusters"), F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("confirmed_clusters"),
        F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("confirmed_clusters_with_species"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("divergence").isNotNull(), F.struct(F.col("divergence").cast("int"), F.col("n")))))).alias("divergence_counts"),
    )
    out = total.join(species, list(keys), "left") if keys else total.crossJoin(species)
    return out.select(
        *keys, "raw_clusters", "confirmed_clusters", (F.col("raw_clusters") - F.col("confirmed_clusters")).alias("unmatched_clusters"), "confirmed_clusters_with_species",
        F.coalesce("distinct_matched_species", F.lit(0)).cast("bigint").alias("distinct_matched_species"),
        F.try_divide("confirmed_clusters", "raw_clusters").alias("confirmed_fraction"), "divergence_counts",
    )
