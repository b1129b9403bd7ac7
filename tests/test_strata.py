"""Golden cases of stratified histograms, reference matching and histograms of representatives."""

import pytest

from cladeflow.operators import refmatch, strata
from cladeflow.operators.clusterstats import prevalence

HUMAN = "human gut metagenome"


def histo(spark, hits, clusters, meta):
    h = spark.createDataFrame([("m", *x) for x in hits], "gene string, sample string, sequence string")
    c = spark.createDataFrame([("m", *x) for x in clusters], "gene string, member string, rep string")
    m = spark.createDataFrame(meta, "acc string, year string, organism string")
    out = strata.histogram(strata.tagged(h, c, m), m)
    return sorted((r.stratum, r.stratum_value, r.sample_count, r.species_count) for r in out.collect())


def test_same_sample_counts_once(spark):
    got = histo(spark, [("A", "AAAA"), ("A", "CCCC"), ("B", "AAAA")], [("AAAA", "AAAA"), ("CCCC", "AAAA")], [("A", "2020", HUMAN), ("B", "2021", HUMAN)])
    assert got == [("human_all", "all", 2, 1), ("human_per_year", "2020", 1, 1), ("human_per_year", "2021", 2, 1), ("year", "2020", 1, 1), ("year", "2021", 2, 1)]


def test_years_are_cumulative(spark):
    got = histo(spark, [("A", "AAAA"), ("B", "AAAA"), ("C", "CCCC"), ("C", "AAAA")], [("AAAA", "AAAA"), ("CCCC", "CCCC")], [("A", "2018", "soil"), ("B", "2020", HUMAN), ("C", "2022", "soil"), ("D", "2019", "soil")])
    assert got == sorted([("human_all", "all", 1, 1), ("human_per_year", "2020", 1, 1), ("human_per_year", "2022", 1, 1), ("year", "2018", 1, 1), ("year", "2019", 1, 1), ("year", "2020", 2, 1), ("year", "2022", 3, 1), ("year", "2022", 1, 1)])


def test_matches(spark):
    reps = spark.createDataFrame([("seq1", "AAAA"), ("otu0|sample2|gene", "CCCC"), ("seq3", "GGGG"), ("seq4", "TTTT")], "id string, sequence string")
    hits = spark.createDataFrame([("seq1", 2, "d__Bacteria; s__Shared", 0), ("otu0|sample2|gene", 2, "d__Bacteria; s__Shared", 1), ("seq3", 2, "d__Bacteria; s__", 2)], "query string, divergence int, taxonomy string, ordinal int")
    found = refmatch.matches(reps, refmatch.best_hits(hits, reps, 2))
    s = refmatch.match_summary(found).first()
    assert (s.raw_clusters, s.confirmed_clusters, s.confirmed_clusters_with_species, s.distinct_matched_species, s.unmatched_clusters) == (4, 3, 2, 1, 1)
    assert s.divergence_counts == {2: 3}
    assert found.where("id = 'seq3'").first()[2:] == ("confirmed", 2, None, "d__Bacteria; s__")


def test_best_hit(spark):
    hits = spark.createDataFrame([("q", 2, "s__Far", 0), ("q", 1, "d__Bacteria", 1), ("q", 1, "s__Tie", 2)], "query string, divergence int, taxonomy string, ordinal int")
    assert tuple(refmatch.best_hits(hits).first()) == ("q", 1, "d__Bacteria")
    known = spark.createDataFrame([("x",)], "id string")
    with pytest.raises(Exception, match="unknown query"):
        refmatch.best_hits(hits, known).collect()
    with pytest.raises(Exception, match="out of range"):
        refmatch.best_hits(hits, None, 1).collect()
    with pytest.raises(ValueError):
        refmatch.best_hits(hits.drop("ordinal"))


def test_prevalence(spark):
    reps = spark.createDataFrame([("m", n) for n in (2, 1, 1, 1)], "gene string, n_samples long")
    assert sorted((r.sample_count, r.species_count) for r in prevalence(reps).collect()) == [(1, 3), (2, 1)]
