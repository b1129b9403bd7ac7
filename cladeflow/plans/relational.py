"""Queries over joins, aggregations, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clusterstats, collate, distances, estimates, refmatch, report, richness, sample_sets, strata
from ..operators import signature as sig
from ..operators.numbering import numbered
from . import fits
from .registry import query

# ---- joins ----


@query("JOIN-01_member_counts", "SELECT c.gene, c.member, n_occurrences, sum_hits FROM clusters c JOIN counts ON counts.gene = c.gene AND counts.sequence = c.member WHERE c.rep <> c.member")
def _(s):
    c = s.counts.withColumnRenamed("sequence", "member")
    return s.clusters.where("rep <> member").join(c, ["gene", "member"]).select("gene", "member", "n_occurrences", "sum_hits")


@query("JOIN-02_rep_counts", "SELECT c.gene, c.member, n_occurrences AS rep_n_occurrences FROM clusters c JOIN counts ON counts.gene = c.gene AND counts.sequence = c.rep")
def _(s):
    c = s.counts.select("gene", F.col("sequence").alias("rep"), F.col("n_occurrences").alias("rep_n_occurrences"))
    return s.clusters.join(c, ["gene", "rep"]).select("gene", "member", "rep_n_occurrences")


@query("JOIN-03_clusters_counts", "SELECT c.gene, c.rep, CAST(sum(n_occurrences) AS BIGINT) AS n FROM clusters c JOIN counts ON counts.gene = c.gene AND counts.sequence = c.member GROUP BY ALL")
def _(s):
    n = s.counts
    return s.clusters.join(n, (s.clusters["gene"] == n["gene"]) & (s.clusters["member"] == n["sequence"])).groupBy(s.clusters["gene"], "rep").agg(F.sum("n_occurrences").alias("n"))


@query("JOIN-04_clusters_windows", "SELECT c.gene, c.rep, o.sample, count(*) AS n FROM clusters c JOIN otu o ON o.gene = c.gene AND o.seq = c.member GROUP BY ALL")
def _(s):
    return s.clusters.join(s.seqs.withColumnRenamed("seq", "member").select("gene", "member", "sample"), ["gene", "member"]).groupBy("gene", "rep", "sample").agg(F.count("*").alias("n"))


@query("JOIN-05_metadata_lookup", "SELECT m.year, m.organism, m.acc IS NOT NULL AS found, count(*) AS n FROM otu_hits o LEFT JOIN (SELECT * FROM sample_metadata WHERE acc NOT LIKE '%7') m ON m.acc = o.sample GROUP BY ALL")
def _(s):
    return strata.with_metadata(s.otu, s.meta.where("acc NOT LIKE '%7'")).groupBy("year", "organism", "found").agg(F.count("*").alias("n"))


@query("JOIN-06_samples_fallback", "SELECT s.gene, s.rep, CAST(coalesce(CASE WHEN r.n_samples % 2 = 0 THEN r.n_samples END, s.cluster_size) AS BIGINT) AS n_samples FROM stats s JOIN rep_samples r ON r.gene = s.gene AND r.rep = s.rep")
def _(s):
    return clusterstats.cluster_stats(s.raw_clusters, s.dedup, s.samples.where("n_samples % 2 = 0")).select("gene", "rep", "n_samples")


@query("JOIN-07_member_to_rep", "SELECT gene, rep, n_samples FROM rep_samples")
def _(s):
    return s.make_samples().select("gene", "rep", "n_samples")


@query("JOIN-08_stats_default", "SELECT c.gene, c.rep, CAST(sum(coalesce(d.n_occurrences, 1)) AS BIGINT) AS cluster_size, CAST(sum(CASE WHEN coalesce(d.unknown, 1) = 0 THEN coalesce(d.n_occurrences, 1) ELSE 0 END) AS BIGINT) AS n_query, CAST(max(coalesce(d.hits, 0)) AS BIGINT) AS max_hits, CAST(sum(coalesce(d.sum_hits, 0)) AS BIGINT) AS total_hits FROM raw_clusters c LEFT JOIN (SELECT * FROM dedup WHERE seq_num % 3 > 0) d ON c.gene = d.gene AND c.member = d.sequence GROUP BY ALL")
def _(s):
    return clusterstats.cluster_stats(s.raw_clusters, s.dedup.where("seq_num % 3 > 0")).drop("n_samples")


def reps(s):
    return s.per_seq.select(F.concat_ws("|", "gene", "rep").alias("id"), "gene", F.col("rep").alias("sequence"), "n_samples")


BEST = "SELECT id, CASE WHEN n_samples % 3 > 0 THEN CAST(n_samples % 3 AS INT) END AS divergence, CASE WHEN n_samples % 3 = 1 THEN concat('d__B; s__', gene) WHEN n_samples % 3 = 2 THEN 'd__B; s__' END AS taxonomy FROM (SELECT concat_ws('|', gene, rep) AS id, gene, n_samples FROM per_seq)"


def hits(s):
    d = F.col("n_samples") % 3
    return reps(s).where(d > 0).select(F.col("id").alias("query"), d.cast("int").alias("divergence"), F.when(d == 1, F.concat(F.lit("d__B; s__"), "gene")).otherwise("d__B; s__").alias("taxonomy"), F.lit(0).alias("ordinal"))


@query("JOIN-09_rep_matches", f"SELECT id, CASE WHEN divergence IS NULL THEN 'no_match' ELSE 'confirmed' END AS globdb_status, CAST(divergence AS VARCHAR) AS divergence, CASE WHEN divergence = 1 THEN substr(taxonomy, 7) END AS species FROM ({BEST})")
def _(s):
    return refmatch.matches(reps(s), refmatch.best_hits(hits(s), reps(s), 2)).select("id", "globdb_status", F.col("divergence").cast("string"), "species")


@query("JOIN-10_expected_codons", "SELECT gene, CAST(sum(syn9) AS BIGINT) AS syn9, CAST(sum(stop9) AS BIGINT) AS stop9 FROM single GROUP BY gene")
def _(s):
    from ..functions.codons import expected_table, n_diff
    from .scans import codon_rows

    one = codon_rows(s).where(n_diff("rc", "mc") == 1)
    e = F.broadcast(expected_table(s.spark)).withColumnRenamed("rep_codon", "rc")
    return one.join(e, "rc").groupBy("gene").agg(F.sum(F.round(F.col("exp_syn") * 9).cast("bigint")).alias("syn9"), F.sum(F.round(F.col("exp_stop") * 9).cast("bigint")).alias("stop9"))


@query("JOIN-11_counts_fill", "SELECT gene, f_class, single_read, parent_class, n_pairs, n_single_nt, n_codons_multi_nt FROM sig")
def _(s):
    return s.sig.select("gene", "f_class", "single_read", "parent_class", "n_pairs", "n_single_nt", "n_codons_multi_nt")


@query("JOIN-12_reference_join", "SELECT p.marker, f_class, single_read, parent_class, n_single_nt, CAST(rn AS BIGINT) AS ref_n FROM sig_pooled p JOIN sig_ref USING (scope, marker)")
def _(s):
    ref = estimates.reference(s.sig_all)
    return estimates.pooled(s.sig_all).join(ref, ["scope", "marker"]).select("marker", "f_class", "single_read", "parent_class", "n_single_nt", F.col("ref_n_single_nt").cast("bigint").alias("ref_n"))


@query("JOIN-13_cohort_sizes", "SELECT marker, cohort, sample_count, species_count, n_samples FROM cohort_hist JOIN cohorts USING (cohort)")
def _(s):
    return s.cohort_hist.join(F.broadcast(s.cohorts), "cohort").select("marker", "cohort", "sample_count", "species_count", "n_samples")


@query("JOIN-14_fractions", "SELECT cohort, CAST(ceil(round(n_samples * (i / 10.0::DOUBLE), 9)) AS BIGINT) AS n FROM cohorts, range(1, 11) t(i)")
def _(s):
    part = F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i / F.lit(10)))
    return s.cohorts.select("*", part.alias("f")).select("cohort", F.ceil(F.round(F.col("n_samples") * F.col("f"), 9)).cast("bigint").alias("n"))


YEARS = "SELECT CASE WHEN stratum = 'year' THEN 'all' ELSE 'human-gut' END AS cohort, CAST(stratum_value AS INT) AS year, CAST(sum(species_count) AS BIGINT) AS species FROM histo WHERE stratum IN ('year', 'human_per_year') GROUP BY ALL"
PER_YEAR = "SELECT 'all' AS cohort, CAST(year AS INT) AS year, count(*) AS n FROM sample_metadata WHERE year IS NOT NULL AND year <> '1996' GROUP BY ALL UNION ALL SELECT 'human-gut', CAST(year AS INT), count(*) FROM sample_metadata WHERE year IS NOT NULL AND year <> '1996' AND organism = 'human gut metagenome' GROUP BY ALL"


def species_years(s):
    h = s.histo.where("stratum IN ('year', 'human_per_year')")
    return h.groupBy(report.cohort().alias("cohort"), F.col("stratum_value").try_cast("int").alias("year")).agg(F.sum("species_count").alias("species"))


def samples_years(s):
    m = s.meta.where("year IS NOT NULL AND year <> '1996'").withColumn("year", F.col("year").cast("int"))
    one = m.groupBy(F.lit("all").alias("cohort"), "year").agg(F.count("*").alias("n"))
    return one.unionByName(m.where("organism = 'human gut metagenome'").groupBy(F.lit("human-gut").alias("cohort"), "year").agg(F.count("*").alias("n")))


@query("JOIN-15_years_filled", f"SELECT y.cohort, y.year, coalesce(n, 0) AS n FROM ({PER_YEAR}) p RIGHT JOIN ({YEARS}) y ON y.cohort = p.cohort AND y.year = p.year")
def _(s):
    return samples_years(s).join(species_years(s).select("cohort", "year"), ["cohort", "year"], "right").na.fill({"n": 0})


@query("JOIN-16_cumulative", f"SELECT cohort, year, species, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY cohort ORDER BY year) AS BIGINT) AS samples FROM ({YEARS}) LEFT JOIN ({PER_YEAR}) USING (cohort, year)")
def _(s):
    filled = samples_years(s).join(species_years(s).select("cohort", "year"), ["cohort", "year"], "right").na.fill({"n": 0})
    running = F.sum("n").over(W.partitionBy("cohort").orderBy("year").rowsBetween(W.unboundedPreceding, 0))
    return filled.select("cohort", "year", running.alias("samples")).join(species_years(s), ["cohort", "year"])


@query("JOIN-17_human_windows", "SELECT gene, count(*) AS n, CAST(sum(num_hits) AS BIGINT) AS hits FROM otu_hits WHERE sample IN (SELECT acc FROM sample_metadata WHERE organism = 'human gut metagenome') GROUP BY gene")
def _(s):
    return collate.keep_samples(s.otu, s.meta).groupBy("gene").agg(F.count("*").alias("n"), F.sum("num_hits").alias("hits"))


@query("JOIN-18_reference_taxonomy", "SELECT marker, species, count(*) AS n FROM ref_windows GROUP BY ALL")
def _(s):
    tax = s.otu.select(F.xxhash64("taxonomy").alias("id"), "taxonomy").distinct()
    rows = s.otu.where("num_hits >= 48").select("gene", F.xxhash64("taxonomy").alias("id"))
    return rows.join(tax, "id").groupBy(F.col("gene").alias("marker"), S.species_of("taxonomy").alias("species")).agg(F.count("*").alias("n"))


@query("JOIN-19_attributes", "SELECT m.acc, a.year FROM sample_metadata m LEFT JOIN (SELECT acc, year FROM sample_metadata WHERE year > '1998') a ON a.acc = m.acc")
def _(s):
    a = s.meta.where("year > '1998'").select("acc", "year")
    return s.meta.select("acc").join(a, "acc", "left")


UNIQUE = "SELECT DISTINCT marker, species, sequence FROM ref_windows"


@query("JOIN-20_intra_pairs", f"SELECT a.marker, CAST(least(hamming(a.sequence, b.sequence), 15) AS INT) AS distance, count(*) AS count FROM ({UNIQUE}) a JOIN ({UNIQUE}) b ON a.marker = b.marker AND a.species = b.species AND a.sequence < b.sequence GROUP BY ALL")
def _(s):
    return distances.intra(distances.species_windows(s.ref_windows), seed=0).where("metric = 'intra_pair'").select("marker", F.col("distance").cast("int").alias("distance"), "count")


LEAST = f"SELECT marker, species, min(sequence) AS sequence FROM ({UNIQUE}) GROUP BY ALL"


@query("JOIN-21_inter_pairs", f"SELECT a.marker, CAST(least(hamming(a.sequence, b.sequence), 15) AS INT) AS distance, count(*) AS count FROM ({LEAST}) a JOIN ({LEAST}) b ON a.marker = b.marker AND a.species <> b.species GROUP BY ALL")
def _(s):
    return distances.inter(distances.species_windows(s.ref_windows), 1000).where("metric = 'inter_sampled_all'").select("marker", F.col("distance").cast("int").alias("distance"), "count")


NEAREST = "SELECT gene, query, divergence, ref_id FROM (SELECT q.gene, q.member AS query, CAST(hamming(q.member, r.rep) AS INT) AS divergence, r.rep AS ref_id, row_number() OVER (PARTITION BY q.gene, q.member ORDER BY hamming(q.member, r.rep), r.rep) AS p FROM (SELECT DISTINCT gene, member FROM clusters) q JOIN (SELECT DISTINCT gene, rep FROM clusters) r ON q.gene = r.gene AND hamming(q.member, r.rep) <= 2) WHERE p = 1"


def nearest(s):
    q = s.clusters.select("gene", F.col("member").alias("id"), F.col("member").alias("sequence")).distinct()
    r = s.clusters.select("gene", F.col("rep").alias("id"), F.col("rep").alias("sequence")).distinct().withColumn("taxonomy", F.concat(F.lit("d__B; s__"), "id"))
    return refmatch.nearest(q, r)


@query("JOIN-22_nearest_reference", NEAREST)
def _(s):
    return nearest(s).select("gene", "query", "divergence", "ref_id")


@query("JOIN-24_rep_taxonomy", "SELECT stratum, stratum_value, CAST(sum(species_count) AS BIGINT) AS n FROM tax_hist GROUP BY ALL")
def _(s):
    return s.make_tax_hist().groupBy("stratum", "stratum_value").agg(F.sum("species_count").alias("n"))


@query("JOIN-25_unmatched", f"SELECT id FROM ({BEST}) WHERE divergence IS NULL")
def _(s):
    return reps(s).join(hits(s).select(F.col("query").alias("id")), "id", "left_anti").select("id")


@query("JOIN-26_centroid_records", "SELECT gene, count(*) AS n FROM otu WHERE seq = planted_rep GROUP BY gene")
def _(s):
    return collate.keep_centroids(s.otu, s.clusters).groupBy("gene").agg(F.count("*").alias("n"))


# ---- aggregations ----


@query("AGG-01_counts_table", "SELECT gene, sequence, n_occurrences, sum_hits FROM counts")
def _(s):
    return s.make_counts()


@query("AGG-02_dedup", "SELECT gene, sequence, unknown, hits, n_occurrences, sum_hits, seq_num FROM dedup")
def _(s):
    return s.make_dedup()


@query("AGG-03_rep_samples", "SELECT gene, rep, n_samples FROM rep_samples")
def _(s):
    return s.make_samples()


@query("AGG-04_cluster_stats", "SELECT gene, rep, cluster_size, n_query, max_hits, total_hits, n_samples FROM stats")
def _(s):
    return s.make_stats()


@query("AGG-05_single_read", "SELECT gene, count(*) AS n_clusters, count(*) FILTER (WHERE h = 1) AS n_single_read_clusters, count(*) FILTER (WHERE o = 1) AS n_single_occurrence_clusters FROM (SELECT gene, sequence, sum(sum_hits) AS h, sum(n_occurrences) AS o FROM counts GROUP BY ALL) GROUP BY gene")
def _(s):
    own = s.counts.select("gene", F.col("sequence").alias("member"), F.col("sequence").alias("rep"))
    return clusterstats.single_read_summary(s.counts, own, ("gene",))


@query("AGG-06_prevalence", "SELECT gene, CAST(sample_count AS BIGINT) AS sample_count, species_count FROM prev")
def _(s):
    return clusterstats.prevalence(s.stats)


@query("AGG-07_distinct_tags", "SELECT gene, rep, sample, stratum, CAST(value AS VARCHAR) AS value FROM tags")
def _(s):
    return s.make_tags().withColumn("value", F.col("value").cast("string"))


@query("AGG-08_strata_counts", "SELECT gene, stratum, CAST(value AS VARCHAR) AS value, n, count(*) AS reps FROM (SELECT gene, rep, stratum, value, count(*) AS n FROM tags GROUP BY ALL) GROUP BY ALL")
def _(s):
    per = s.tags.groupBy("gene", "rep", "stratum", "value").agg(F.count("*").alias("n"))
    return per.groupBy("gene", "stratum", F.col("value").cast("string").alias("value"), "n").agg(F.count("*").alias("reps"))


@query("AGG-09_cumulative_years", "SELECT gene, stratum, stratum_value, sample_count, species_count FROM histo")
def _(s):
    return s.make_histo()


@query("AGG-10_taxonomy_histogram", "SELECT marker, stratum, stratum_value, sample_count, species_count FROM tax_hist")
def _(s):
    return s.make_tax_hist()


@query("AGG-11_merge_parts", "SELECT gene, stratum, stratum_value, sample_count, 2 * species_count AS species_count FROM histo")
def _(s):
    return strata.merge(s.histo, s.histo)


def shard_sets(s):
    """Sample sets of two shards of the windows that share samples, representatives and windows."""
    numbers = sample_sets.number_samples(s.otu)
    shards = [s.otu.where(F.col("num_hits") % 3 != left_out) for left_out in (0, 2)]
    return [sample_sets.sample_sets(x.select("gene", F.col("planted_rep").alias("rep"), "sample"), numbers) for x in shards], numbers


@query("AGG-03_merged_shards", "SELECT gene, rep, n_samples FROM rep_samples")
def _(s):
    return sample_sets.sizes(sample_sets.merge_sets(*shard_sets(s)[0]))


@query("AGG-11_overlapping_parts", "SELECT gene, CAST(sample_count AS BIGINT) AS sample_count, species_count FROM prev")
def _(s):
    return sample_sets.prevalence(sample_sets.merge_sets(*shard_sets(s)[0]))


@query("AGG-08_from_sets", "SELECT gene, stratum, stratum_value, sample_count, species_count FROM histo")
def _(s):
    parts, numbers = shard_sets(s)
    return sample_sets.histogram(sample_sets.merge_sets(*parts), sample_sets.strata_sets(s.meta, numbers))


FIRST_LETTER = "SELECT gene, rep AS member, min(rep) OVER (PARTITION BY gene, substr(rep, 1, 1)) AS rep FROM (SELECT DISTINCT gene, planted_rep AS rep FROM otu)"


@query("SET-06_united", f"SELECT o.gene, c.rep, count(DISTINCT sample) AS n_samples FROM otu o JOIN ({FIRST_LETTER}) c ON c.gene = o.gene AND c.member = o.planted_rep GROUP BY o.gene, c.rep")
def _(s):
    reps_ = s.otu.select("gene", F.col("planted_rep").alias("member")).distinct()
    clusters = reps_.join(reps_.groupBy("gene", F.substring("member", 1, 1).alias("letter")).agg(F.min("member").alias("rep")).withColumnRenamed("gene", "g"), (F.col("g") == F.col("gene")) & (F.substring("member", 1, 1) == F.col("letter")))
    return sample_sets.sizes(sample_sets.united(sample_sets.merge_sets(*shard_sets(s)[0]), clusters.select("gene", "member", "rep")))


SIG = "SELECT gene, f_class, single_read, parent_class"


@query("AGG-12_pair_counts", f"{SIG}, n_pairs, n_pairs_ambiguous FROM sig")
def _(s):
    return s.make_sig().select("gene", "f_class", "single_read", "parent_class", "n_pairs", "n_pairs_ambiguous")


@query("AGG-13_multi_codons", f"{SIG}, n_codons_multi_nt FROM sig")
def _(s):
    return s.make_sig().select("gene", "f_class", "single_read", "parent_class", "n_codons_multi_nt")


@query("AGG-14_single_codons", f"{SIG}, n_single_nt, pos1, pos2, pos3, syn, nonsyn, stop, round(exp_syn, 9) AS exp_syn, round(exp_nonsyn, 9) AS exp_nonsyn, round(exp_stop, 9) AS exp_stop, transitions FROM sig")
def _(s):
    cols = ["gene", "f_class", "single_read", "parent_class", "n_single_nt", "pos1", "pos2", "pos3", "syn", "nonsyn", "stop", "transitions"]
    return s.make_sig().select(*cols, *[F.round(c, 9).alias(c) for c in ("exp_syn", "exp_nonsyn", "exp_stop")])


@query("AGG-15_combine", f"{SIG}, 2 * n_pairs AS n_pairs, 2 * pos3 AS pos3 FROM sig")
def _(s):
    return sig.combine(s.sig.unionByName(s.sig), ("gene",)).select("gene", "f_class", "single_read", "parent_class", "n_pairs", "pos3")


@query("AGG-16_pooled", "SELECT marker, f_class, single_read, parent_class, n_pairs, n_single_nt, syn FROM sig_pooled")
def _(s):
    return estimates.pooled(s.sig_all).select("marker", "f_class", "single_read", "parent_class", "n_pairs", "n_single_nt", "syn")


@query("AGG-17_reference_pool", "SELECT scope, marker, rn AS ref_n_single_nt, rpos3 AS ref_pos3, rsyn AS ref_syn, rstop AS ref_stop FROM sig_ref")
def _(s):
    return estimates.reference(s.sig_all)


@query("AGG-18_match_summary", f"SELECT count(*) AS raw_clusters, count(divergence) AS confirmed_clusters, count(*) - count(divergence) AS unmatched_clusters, count(*) FILTER (WHERE divergence = 1) AS confirmed_clusters_with_species, count(DISTINCT CASE WHEN divergence = 1 THEN taxonomy END) AS distinct_matched_species, round(count(divergence) / count(*), 9) AS confirmed_fraction, count(*) FILTER (WHERE divergence = 1) AS d1, count(*) FILTER (WHERE divergence = 2) AS d2 FROM ({BEST})")
def _(s):
    m = refmatch.match_summary(refmatch.matches(reps(s), refmatch.best_hits(hits(s))))
    d = lambda k: F.coalesce(F.element_at("divergence_counts", F.lit(k)), F.lit(0)).cast("bigint").alias(f"d{k}")
    return m.withColumn("confirmed_fraction", F.round("confirmed_fraction", 9)).select("*", d(1), d(2)).drop("divergence_counts")


@query("AGG-19_type_summary", "SELECT gene, cluster_type, count(*) AS n, min(n_samples) AS min_n_samples, max(n_samples) AS max_n_samples, median(n_samples) AS median_n_samples, min(total_hits) AS min_total_hits, max(total_hits) AS max_total_hits, median(total_hits) AS median_total_hits FROM type_rows GROUP BY ALL")
def _(s):
    return clusterstats.type_summary(s.type_rows)


@query("AGG-20_global_range", "SELECT min(n) AS low, max(n) AS high, median(n) AS middle FROM (SELECT gene, count(*) AS n FROM per_seq GROUP BY gene)")
def _(s):
    return s.per_seq.groupBy("gene").agg(F.count("*").alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.median("n").alias("middle"))


@query("AGG-21_median_range", "SELECT cohort, sample_count, median(species_count) AS median_species_count, min(species_count) AS min_species_count, max(species_count) AS max_species_count FROM cohort_hist GROUP BY ALL")
def _(s):
    return report.spread(s.cohort_hist, ["cohort", "sample_count"], "species_count")


@query("AGG-22_share", "SELECT marker, cohort, sample_count, round(species_count / sum(species_count) OVER (PARTITION BY marker, cohort), 9) AS share FROM cohort_hist")
def _(s):
    return report.share(s.cohort_hist, "species_count", ["marker", "cohort"]).select("marker", "cohort", "sample_count", F.round("share", 9).alias("share"))


@query("AGG-23_ratios", "SELECT marker, cohort, CAST(f1 AS BIGINT) AS f1, CAST(f2 AS BIGINT) AS f2, CAST(f3 AS BIGINT) AS f3, round(f1 / nullif(f2, 0), 9) AS f1_f2, round(f2 / nullif(f3, 0), 9) AS f2_f3 FROM (SELECT marker, cohort, sum(CASE WHEN sample_count = 1 THEN species_count ELSE 0 END) AS f1, sum(CASE WHEN sample_count = 2 THEN species_count ELSE 0 END) AS f2, sum(CASE WHEN sample_count = 3 THEN species_count ELSE 0 END) AS f3 FROM cohort_hist GROUP BY ALL)")
def _(s):
    r = richness.poisson_richness(s.cohort_hist, ("marker", "cohort"))
    return r.select("marker", "cohort", "f1", "f2", "f3", F.round("f1_f2", 9).alias("f1_f2"), F.round("f2_f3", 9).alias("f2_f3"))


@query("AGG-24_across_columns", "SELECT cohort, median(sample_count) AS median_sample_count, max(sample_count) AS max_sample_count, median(species_count) AS median_species_count, max(species_count) AS max_species_count FROM (SELECT cohort, nullif(sample_count, 2) AS sample_count, species_count FROM cohort_hist) GROUP BY cohort")
def _(s):
    rows = s.cohort_hist.withColumn("sample_count", F.nullif("sample_count", F.lit(2)))
    return rows.groupBy("cohort").agg(*[f(c).alias(f"{n}_{c}") for c in ("sample_count", "species_count") for n, f in (("median", F.median), ("max", F.max))])


@query("AGG-25_cohort_sizes", "SELECT cohort, n_samples FROM cohorts")
def _(s):
    return s.cohorts


WIDE = "SELECT gene, coalesce(sum(n) FILTER (WHERE cluster_type = 'genome_linked'), 0)::BIGINT AS genome_linked, coalesce(sum(n) FILTER (WHERE cluster_type = 'multi_sample'), 0)::BIGINT AS multi_sample, coalesce(sum(n) FILTER (WHERE cluster_type = 'multi_hit'), 0)::BIGINT AS multi_hit, coalesce(sum(n) FILTER (WHERE cluster_type = 'single_singleton'), 0)::BIGINT AS single_singleton FROM (SELECT gene, cluster_type, count(*) AS n FROM type_rows GROUP BY ALL) GROUP BY gene"


def wide_types(s):
    n = s.type_rows.groupBy("gene", "cluster_type").agg(F.count("*").alias("n"))
    return report.wide(n, "gene", "cluster_type", "n", list(clusterstats.CLUSTER_TYPES), 0)


@query("AGG-26_row_shares", f"SELECT gene, round(single_singleton / (genome_linked + multi_sample + multi_hit + single_singleton), 9) AS share FROM ({WIDE})")
def _(s):
    total = sum((F.col(c) for c in clusterstats.CLUSTER_TYPES), F.lit(0))
    return wide_types(s).select("gene", F.round(F.try_divide("single_singleton", total), 9).alias("share"))


@query("AGG-27_modal_length", "SELECT gene AS marker, CAST(60 - 3 AS INT) AS window FROM otu_hits WHERE false UNION ALL SELECT marker, w FROM (SELECT marker, w, row_number() OVER (PARTITION BY marker ORDER BY count(*) DESC, w) AS p FROM (SELECT DISTINCT marker, species, sequence, CAST(length(sequence) AS INT) AS w FROM (SELECT marker, species, substr(sequence, 1, CASE WHEN sequence < 'C' THEN 57 ELSE 60 END) AS sequence FROM ref_windows)) GROUP BY marker, w) WHERE p = 1")
def _(s):
    cut = s.ref_windows.withColumn("sequence", F.expr("substr(sequence, 1, CASE WHEN sequence < 'C' THEN 57 ELSE 60 END)"))
    return distances.modal_length(cut)


@query("AGG-28_diameter", f"SELECT marker, CAST(distance AS INT) AS distance, count(*) AS count FROM (SELECT u.marker, u.species, least(coalesce(max(hamming(a.sequence, b.sequence)), 0), 15) AS distance FROM (SELECT DISTINCT marker, species FROM ref_windows) u LEFT JOIN ({UNIQUE}) a ON a.marker = u.marker AND a.species = u.species LEFT JOIN ({UNIQUE}) b ON a.marker = b.marker AND a.species = b.species AND a.sequence < b.sequence GROUP BY ALL) GROUP BY ALL")
def _(s):
    return distances.intra(distances.species_windows(s.ref_windows), seed=0).where("metric = 'intra_diameter'").select("marker", F.col("distance").cast("int").alias("distance"), "count")


@query("AGG-29_inter_nearest", f"SELECT marker, CAST(least(d, 15) AS INT) AS distance, count(*) AS count FROM (SELECT a.marker, a.species, min(hamming(a.sequence, b.sequence)) AS d FROM ({LEAST}) a JOIN ({LEAST}) b ON a.marker = b.marker AND a.species <> b.species GROUP BY ALL) GROUP BY ALL")
def _(s):
    return distances.inter(distances.species_windows(s.ref_windows), 1000).where("metric = 'inter_sampled_nearest'").select("marker", F.col("distance").cast("int").alias("distance"), "count")


@query("AGG-30_speedup", "SELECT gene, median(v) AS middle, round(avg(v), 9) AS mean FROM (SELECT gene, nullif(num_hits, 3) AS v FROM otu_hits) GROUP BY gene")
def _(s):
    rows = s.otu.select("gene", F.nullif("num_hits", F.lit(3)).alias("v"))
    return rows.groupBy("gene").agg(F.median("v").alias("middle"), F.round(F.avg("v"), 9).alias("mean"))


def poisson(table: str, keys: str) -> str:
    """SQL for the truncated Poisson's rate, by fixed point, of histograms."""
    return f"SELECT {keys}, obs, low, CASE WHEN low_sum > low THEN list_reduce(list_prepend(low_sum / low, list_transform(range(300), lambda i: low_sum / low)), lambda a, m: m * (1 - exp(-a))) END AS lam FROM (SELECT {keys}, sum(species_count)::BIGINT AS obs, sum(species_count) FILTER (WHERE sample_count <= 10)::BIGINT AS low, sum(species_count * sample_count) FILTER (WHERE sample_count <= 10)::BIGINT AS low_sum, sum(species_count) FILTER (WHERE sample_count = 1)::BIGINT AS f1 FROM {table} GROUP BY {keys})"


POISSON = poisson("cohort_hist", "marker, cohort")
ERRORS = "SELECT marker, 'Synonymous' AS estimator, least(greatest(error_fraction, 0), 1) AS pi FROM est WHERE f_class = 'f1' AND single_read AND parent_class = 'all' AND statistic = 'synonymous'"
FRACTIONS = "SELECT marker, 'Synonymous' AS estimator, error_fraction, CASE WHEN error_fraction IS NOT NULL THEN least(greatest(error_fraction, 0), 1) END AS pi FROM est WHERE f_class = 'f1' AND single_read AND parent_class = 'all' AND statistic = 'synonymous'"
CORRECTED_HIST = f"SELECT h.marker, h.cohort, estimator, sample_count, CAST(species_count - CASE WHEN sample_count = 1 THEN least(CAST(round_even(pi * r.n, 0) AS BIGINT), species_count) ELSE 0 END AS BIGINT) AS species_count FROM cohort_hist h JOIN ({ERRORS} UNION ALL SELECT marker, 'Uncorrected', 0.0 FROM ({ERRORS})) e ON e.marker = h.marker JOIN (SELECT gene, count(*) FILTER (WHERE sum_hits = 1) AS n FROM counts GROUP BY gene) r ON r.gene = h.marker"
CORRECTED = poisson(f"({CORRECTED_HIST})", "marker, cohort, estimator").replace("obs, low, CASE", "obs, low, f1, CASE")


@query("AGG-31_against_uncorrected", f"SELECT marker, cohort, estimator, coalesce(f1, 0) AS f1, round(e, 4) AS poisson_estimate, round(e / nullif(max(e) FILTER (WHERE estimator = 'Uncorrected') OVER (PARTITION BY marker, cohort), 0), 7) AS ratio FROM (SELECT *, low / (1 - exp(-lam)) + (obs - low) AS e FROM ({CORRECTED}))")
def _(s):
    r = richness.against_uncorrected(corrected(s))
    return r.select("marker", "cohort", "estimator", "f1", F.round("poisson_estimate", 4).alias("poisson_estimate"), F.round("ratio", 7).alias("ratio"))


def errors(s):
    e = s.est.where("f_class = 'f1' AND single_read AND parent_class = 'all' AND statistic = 'synonymous'")
    both = F.explode(F.array(F.lit("all"), F.lit("human-gut"))).alias("cohort")
    return e.select("marker", both, F.lit("Synonymous").alias("estimator"), "error_fraction")


def single_reads(s):
    own = s.counts.select("gene", F.col("sequence").alias("member"), F.col("sequence").alias("rep"))
    n = clusterstats.single_read_summary(s.counts, own, ("gene",)).select(F.col("gene").alias("marker"), "n_single_read_clusters")
    return n.select("marker", F.explode(F.array(F.lit("all"), F.lit("human-gut"))).alias("cohort"), "n_single_read_clusters")


def corrected(s):
    return richness.corrected_richness(s.cohort_hist, single_reads(s), errors(s))


# The corrected histograms' facts, with the Poisson fit and the default one of each
CORRECTED_ROWS = f"SELECT h.marker, h.cohort, estimator, error_fraction, pi, r.n AS single_read_f1, sample_count, species_count AS f, CASE WHEN sample_count <> 1 THEN 0 WHEN pi IS NOT NULL THEN least(CAST(round_even(pi * r.n, 0) AS BIGINT), species_count) END AS f1_removed FROM cohort_hist h JOIN ({FRACTIONS} UNION ALL SELECT DISTINCT marker, 'Uncorrected', 0.0, 0.0 FROM ({FRACTIONS})) e ON e.marker = h.marker JOIN (SELECT gene, count(*) FILTER (WHERE sum_hits = 1) AS n FROM counts GROUP BY gene) r ON r.gene = h.marker"
GROUPS = "marker, cohort, estimator"
CORRECTED_TABLE = f"(SELECT {GROUPS}, sample_count, f - f1_removed AS species_count FROM ({CORRECTED_ROWS}) WHERE pi IS NOT NULL)"
CORRECTED_FITS = f"""
SELECT * FROM (
  SELECT {GROUPS}, max(error_fraction) AS error_fraction, max(pi) AS pi, max(single_read_f1) AS single_read_f1, CAST(sum(f) FILTER (WHERE sample_count = 1 AND pi IS NOT NULL) AS BIGINT) AS f1,
         max(f1_removed) FILTER (WHERE sample_count = 1) AS f1_removed, CASE WHEN count(*) = count(f1_removed) THEN CAST(sum(f - f1_removed) AS BIGINT) END AS observed_corrected
  FROM ({CORRECTED_ROWS}) GROUP BY {GROUPS})
LEFT JOIN (SELECT {GROUPS}, estimate AS poisson_estimate, error AS poisson_error FROM ({fits.fits(CORRECTED_TABLE, GROUPS)}) WHERE model = 'poisson') USING ({GROUPS})
LEFT JOIN (SELECT {GROUPS}, lam AS poisson_lambda FROM ({poisson(CORRECTED_TABLE, GROUPS)})) USING ({GROUPS})
LEFT JOIN (SELECT {GROUPS}, estimate AS default_estimate, error AS default_error, model AS default_model FROM ({fits.selected(CORRECTED_TABLE, GROUPS)})) USING ({GROUPS})"""


def corrected_fits(s):
    return richness.corrected_fits(s.cohort_hist, single_reads(s), errors(s))


def rounded(df, digits):
    """The rows with some columns rounded; digits: column -> places."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


FIT_DIGITS = {"error_fraction": 9, "pi": 9, "poisson_estimate": 2, "poisson_error": 2, "poisson_lambda": 6, "default_estimate": 2, "default_error": 2}
FIT_COLUMNS = f"{GROUPS}, single_read_f1, f1, f1_removed, observed_corrected, default_model, " + ", ".join(f"round({c}, {n}) AS {c}" for c, n in FIT_DIGITS.items())


@query("DOM-09_corrected_fits", f"SELECT {FIT_COLUMNS} FROM ({CORRECTED_FITS})")
def _(s):
    return rounded(corrected_fits(s), FIT_DIGITS)


@query("JOIN-23_uncorrected_check", f"SELECT marker, cohort, round(poisson_estimate, 2) AS poisson_estimate, round(m.estimate, 2) AS default_estimate, m.model AS default_model, round(poisson_estimate - m.estimate, 2) AS difference FROM ({CORRECTED_FITS}) c JOIN ({fits.selected('cohort_hist', 'marker, cohort')}) m USING (marker, cohort) WHERE estimator = 'Uncorrected' AND abs(poisson_estimate - m.estimate) > 1")
def _(s):
    checked = richness.fit_differences(corrected_fits(s), richness.richness_table(s.cohort_hist, ("marker", "cohort")))
    return rounded(checked, {"poisson_estimate": 2, "default_estimate": 2, "difference": 2})


SUMMARY_DIGITS = {"median_pi": 9, "median_f1_removed_fraction": 9, "median_estimate": 2, "median_ratio": 7, "min_ratio": 7, "max_ratio": 7}


@query("AGG-31_summary", f"SELECT cohort, estimator, n_default_non_poisson, n_na, {', '.join(f'round({c}, {n}) AS {c}' for c, n in SUMMARY_DIGITS.items())} FROM (SELECT cohort, estimator, CASE WHEN count(*) = count(pi) THEN median(pi) END AS median_pi, CASE WHEN count(*) = count(f1_removed / nullif(f1, 0)) THEN median(f1_removed / nullif(f1, 0)) END AS median_f1_removed_fraction, median(poisson_estimate) AS median_estimate, count(*) FILTER (WHERE default_model <> 'poisson') AS n_default_non_poisson, median(ratio) AS median_ratio, min(ratio) AS min_ratio, max(ratio) AS max_ratio, count(*) FILTER (WHERE poisson_estimate IS NULL) AS n_na FROM (SELECT *, poisson_estimate / nullif(max(poisson_estimate) FILTER (WHERE estimator = 'Uncorrected') OVER (PARTITION BY marker, cohort), 0) AS ratio FROM ({CORRECTED_FITS})) GROUP BY cohort, estimator)")
def _(s):
    return rounded(richness.corrected_summary(corrected_fits(s)), SUMMARY_DIGITS)


@query("AGG-32_model_counts", f"SELECT cohort, estimator, default_model AS model, count(*) AS n FROM ({CORRECTED_FITS}) GROUP BY cohort, estimator, default_model")
def _(s):
    return richness.model_counts(corrected_fits(s))


@query("AGG-32_selected_models", f"SELECT cohort, 'default' AS estimator, model, count(*) AS n FROM ({fits.selected('cohort_hist', 'marker, cohort')}) GROUP BY cohort, model")
def _(s):
    chosen = richness.select_model(richness.fit_models(s.cohort_hist, ("marker", "cohort")), ("marker", "cohort"))
    return chosen.groupBy("cohort", F.lit("default").alias("estimator"), "model").agg(F.count("*").alias("n"))


@query("AGG-33_run_summary", "SELECT gene AS marker, (SELECT count(*) FROM otu_hits o WHERE o.gene = s.gene) AS num_otus, count(*) AS num_clusters FROM stats s GROUP BY gene")
def _(s):
    return clusterstats.run_summary(s.otu, s.stats)


@query("AGG-34_record_check", "SELECT count(*) AS n FROM otu_hits")
def _(s):
    from .scans import entries

    rows = s.indexed.agg(F.count("*").alias("n"))
    parsed = entries(s).agg(F.count("header").alias("h"), F.count("sequence").alias("q"))
    return rows.crossJoin(parsed).select(F.when((F.col("h") == F.col("q")) & (F.col("n") == F.col("h")), F.col("n")).otherwise(F.raise_error(F.lit("headers and sequences differ in number")).cast("bigint")).alias("n"))


@query("AGG-35_trend", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def _(s):
    return s.table("lineitem").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


# ---- windows, sorts, sets ----


@query("WIN-01_running_samples", f"SELECT cohort, year, CAST(sum(n) OVER (PARTITION BY cohort ORDER BY year) AS BIGINT) AS samples FROM ({PER_YEAR})")
def _(s):
    running = F.sum("n").over(W.partitionBy("cohort").orderBy("year").rowsBetween(W.unboundedPreceding, 0))
    return samples_years(s).select("cohort", "year", running.alias("samples"))


@query("WIN-02_running_rep_samples", "SELECT gene, rep, stratum, value, CAST(sum(n) OVER (PARTITION BY gene, rep, stratum ORDER BY value) AS BIGINT) AS samples FROM (SELECT gene, rep, stratum, value, count(*) AS n FROM tags WHERE value IS NOT NULL GROUP BY ALL)")
def _(s):
    per = s.tags.where("value IS NOT NULL").groupBy("gene", "rep", "stratum", "value").agg(F.count("*").alias("n"))
    w = W.partitionBy("gene", "rep", "stratum").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    return per.select("gene", "rep", "stratum", "value", F.sum("n").over(w).alias("samples"))


@query("WIN-03_first_ordinal", "SELECT gene, sequence, seq_num FROM dedup")
def _(s):
    return s.make_dedup().select("gene", "sequence", "seq_num")


@query("WIN-04_otu_index", "SELECT sample, gene, sequence, num_hits, otu_idx FROM indexed")
def _(s):
    return s.make_indexed().select("sample", "gene", "sequence", "num_hits", F.col("otu_idx").cast("bigint").alias("otu_idx"))


@query("WIN-05_best_hit", "SELECT sample AS query, CAST(num_hits AS INT) AS divergence, sequence AS taxonomy FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY num_hits, concat(sequence, gene)) AS p FROM otu_hits) WHERE p = 1")
def _(s):
    h = s.otu.select(F.col("sample").alias("query"), F.col("num_hits").alias("divergence"), F.col("sequence").alias("taxonomy"), F.concat("sequence", "gene").alias("ordinal"))
    return refmatch.best_hits(h)


@query("WIN-06_group_share", "SELECT gene, cluster_type, round(n / sum(n) OVER (PARTITION BY gene), 9) AS share FROM (SELECT gene, cluster_type, count(*) AS n FROM type_rows GROUP BY ALL)")
def _(s):
    n = s.type_rows.groupBy("gene", "cluster_type").agg(F.count("*").alias("n"))
    return report.share(n, "n", ["gene"]).select("gene", "cluster_type", F.round("share", 9).alias("share"))


@query("WIN-07_named_row", "SELECT marker, cohort, sample_count, max(CASE WHEN sample_count = 1 THEN species_count END) OVER (PARTITION BY marker, cohort) AS singles FROM cohort_hist")
def _(s):
    one = F.max(F.when(F.col("sample_count") == 1, F.col("species_count"))).over(W.partitionBy("marker", "cohort"))
    return s.cohort_hist.select("marker", "cohort", "sample_count", one.alias("singles"))


@query("WIN-08_pair_ids", "SELECT gene, rep, member, row_number() OVER (ORDER BY gene, rep, member) - 1 AS pair_id FROM pairs")
def _(s):
    return numbered(s.pairs.select("gene", "rep", "member"), ["gene", "rep", "member"], name="pair_id", start=0)


@query("SRT-01_otu_order", "SELECT sample, gene, string_agg(sequence, ',' ORDER BY otu_idx) AS sequences FROM indexed GROUP BY ALL")
def _(s):
    ordered = F.array_sort(F.collect_list(F.struct("otu_idx", "sequence")))
    return s.make_indexed().groupBy("sample", "gene").agg(F.array_join(F.transform(ordered, lambda x: x["sequence"]), ",").alias("sequences"))


@query("SRT-02_external_sort", "SELECT member, rep, row_number() OVER (ORDER BY member, rep) AS place FROM (SELECT DISTINCT member, rep FROM clusters)")
def _(s):
    d = s.clusters.select("member", "rep").distinct()
    return numbered(d, ["member", "rep"])


@query("SRT-03_class_order", "SELECT f_class, row_number() OVER (ORDER BY f_class) AS place FROM (SELECT DISTINCT f_class FROM classed)")
def _(s):
    d = s.pairs.select(S.f_class("n_occurrences").alias("f_class")).distinct()
    return d.select("f_class", F.row_number().over(W.orderBy("f_class")).cast("bigint").alias("place"))


PHYLA = "SELECT stratum_value, median(n) AS m FROM (SELECT marker, stratum_value, CAST(sum(species_count) AS BIGINT) AS n FROM tax_hist WHERE stratum = 'phylum' GROUP BY ALL) GROUP BY stratum_value"


def phyla(s):
    return s.tax_hist.where("stratum = 'phylum'").groupBy("marker", "stratum_value").agg(F.sum("species_count").alias("n"))


@query("SRT-04_top_with_ties", f"SELECT stratum_value, m FROM (SELECT *, rank() OVER (ORDER BY m DESC) AS p FROM ({PHYLA})) WHERE p <= 3")
def _(s):
    m = phyla(s).groupBy("stratum_value").agg(F.median("n").alias("m"))
    return m.withColumn("p", F.rank().over(W.orderBy(F.col("m").desc()))).where("p <= 3").select("stratum_value", "m")


@query("SRT-05_head", "SELECT acc FROM sample_metadata ORDER BY acc LIMIT 100")
def _(s):
    return s.meta.orderBy("acc").limit(100).select("acc")


@query("SRT-06_marker_orders", "SELECT marker, row_number() OVER (ORDER BY marker) AS by_name, row_number() OVER (ORDER BY CAST(split_part(marker, '.', 2) AS INT)) AS by_number FROM (SELECT DISTINCT concat('S3.', CAST(p_size AS STRING), '.m') AS marker FROM part)")
def _(s):
    m = s.table("part").select(F.expr("concat('S3.', CAST(p_size AS STRING), '.m')").alias("marker")).distinct()
    return m.select("marker", F.row_number().over(W.orderBy("marker")).cast("bigint").alias("by_name"), F.row_number().over(W.orderBy(report.marker_number())).cast("bigint").alias("by_number"))


@query("SRT-07_least_window", f"SELECT marker, species, sequence FROM ({LEAST})")
def _(s):
    return distances.species_representative(distances.species_windows(s.ref_windows))


@query("SRT-08_chunk", "SELECT gene, seq_num, sequence FROM dedup WHERE seq_num BETWEEN 100 AND 299")
def _(s):
    return collate.chunk(s.dedup, 100, 200).select("gene", "seq_num", "sequence")


@query("SRT-09_seeded_sample", f"SELECT marker, species, sequence FROM (SELECT *, row_number() OVER (PARTITION BY marker, species ORDER BY md5(concat('5|', sequence)), sequence) AS p FROM ({UNIQUE})) WHERE p <= 3")
def _(s):
    return distances.sampled(distances.species_windows(s.ref_windows), ["marker", "species"], "sequence", 3, seed=5)


@query("SET-01_union", "SELECT gene, member AS sequence FROM clusters UNION ALL SELECT gene, sequence FROM counts")
def _(s):
    return s.clusters.select("gene", F.col("member").alias("sequence")).unionByName(s.counts.select("gene", "sequence"))


@query("SET-02_union_without_repeats", "SELECT marker, 'same_scope' AS reference, f_class FROM sig_pooled UNION ALL SELECT marker, 'all', f_class FROM sig_pooled WHERE NOT (scope = 'all' AND f_class = 'f1')")
def _(s):
    p = estimates.pooled(s.sig_all)
    again = p.where("NOT (scope = 'all' AND f_class = 'f1')").select("marker", F.lit("all").alias("reference"), "f_class")
    return p.select("marker", F.lit("same_scope").alias("reference"), "f_class").unionByName(again)


@query("SET-03_intersect", "SELECT gene FROM otu_hits INTERSECT SELECT * FROM (VALUES ('S3.1.synthetic_marker'), ('S3.9.other')) AS v(gene)")
def _(s):
    wanted = s.spark.createDataFrame([("S3.1.synthetic_marker",), ("S3.9.other",)], "gene string")
    return s.otu.select("gene").intersect(wanted)


@query("SET-04_difference", "SELECT * FROM (VALUES ('S3.1.synthetic_marker'), ('S3.9.other')) AS v(gene) EXCEPT SELECT gene FROM otu_hits")
def _(s):
    wanted = s.spark.createDataFrame([("S3.1.synthetic_marker",), ("S3.9.other",)], "gene string")
    return wanted.join(s.otu.select("gene").distinct(), "gene", "left_anti")


@query("SET-05_distinct", "SELECT DISTINCT gene, rep FROM clusters")
def _(s):
    return s.clusters.select("gene", "rep").distinct()


@query("SET-06_sample_sets", "SELECT gene, rep, n_samples FROM rep_samples")
def _(s):
    return s.seqs.groupBy("gene", F.col("planted_rep").alias("rep")).agg(F.countDistinct("sample").alias("n_samples"))

