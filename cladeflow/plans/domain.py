"""Queries over reshapes, domain operators and clustering."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import codons as C
from ..functions import scalars as S
from ..operators import cluster_store, clusterstats, clustering, distances, estimates, refmatch, report, richness, strata
from ..operators.numbering import numbered
from ..sources import logs
from . import fits
from .registry import query
from .relational import BEST, CORRECTED, LEAST, PHYLA, POISSON, UNIQUE, WIDE, corrected, errors, hits, nearest, phyla, reps, single_reads, wide_types

# ---- reshapes ----


@query("RSH-01_wide_filled", WIDE)
def _(s):
    return wide_types(s)


@query("RSH-02_wide", "SELECT marker, CAST(sum(n) FILTER (WHERE cohort = 'all') AS BIGINT) AS \"all\", CAST(sum(n) FILTER (WHERE cohort = 'human-gut') AS BIGINT) AS \"human-gut\" FROM (SELECT marker, cohort, CAST(sum(species_count) AS BIGINT) AS n FROM cohort_hist GROUP BY ALL) GROUP BY marker")
def _(s):
    n = s.cohort_hist.groupBy("marker", "cohort").agg(F.sum("species_count").alias("n"))
    return report.wide(n, "marker", "cohort", "n", ["all", "human-gut"])


@query("RSH-03_long", f"SELECT gene, unnest(['genome_linked', 'multi_sample', 'multi_hit', 'single_singleton']) AS cluster_type, unnest([genome_linked, multi_sample, multi_hit, single_singleton]) AS n FROM ({WIDE})")
def _(s):
    return wide_types(s).unpivot(["gene"], list(clusterstats.CLUSTER_TYPES), "cluster_type", "n")


@query("RSH-04_long_several", f"SELECT marker, cohort, unnest(['observed', 'poisson']) AS model, unnest([CAST(obs AS DOUBLE), round(low / (1 - exp(-lam)) + (obs - low), 4)]) AS estimate, unnest([false, true]) AS modelled FROM ({POISSON})")
def _(s):
    r = richness.poisson_richness(s.cohort_hist, ("marker", "cohort"))
    return r.select("marker", "cohort", F.expr("stack(2, 'observed', CAST(observed AS DOUBLE), false, 'poisson', round(poisson_estimate, 4), true) AS (model, estimate, modelled)"))


@query("RSH-05_complete", "SELECT m.marker, d.domain, coalesce(n, 0) AS n FROM (SELECT DISTINCT marker FROM tax_hist) m CROSS JOIN (SELECT * FROM (VALUES ('d__Bacteria'), ('d__Archaea'), ('d__Eukaryota'), ('d__Virus')) v(domain)) d LEFT JOIN (SELECT marker, stratum_value AS domain, CAST(sum(species_count) AS BIGINT) AS n FROM tax_hist WHERE stratum = 'domain' GROUP BY ALL) t ON t.marker = m.marker AND t.domain = d.domain")
def _(s):
    n = s.tax_hist.where("stratum = 'domain'").groupBy("marker", F.col("stratum_value").alias("domain")).agg(F.sum("species_count").alias("n"))
    levels = s.spark.createDataFrame([(x,) for x in ("d__Bacteria", "d__Archaea", "d__Eukaryota", "d__Virus")], "domain string")
    return report.complete(n, n.select("marker"), levels, {"n": 0})


@query("RSH-06_complete_sequence", f"SELECT m.marker, CAST(d.distance AS INT) AS distance, coalesce(count, 0) AS count FROM (SELECT DISTINCT marker FROM ref_windows) m CROSS JOIN range(16) d(distance) LEFT JOIN (SELECT a.marker, least(hamming(a.sequence, b.sequence), 15) AS distance, count(*) AS count FROM ({UNIQUE}) a JOIN ({UNIQUE}) b ON a.marker = b.marker AND a.species = b.species AND a.sequence < b.sequence GROUP BY ALL) t ON t.marker = m.marker AND t.distance = d.distance")
def _(s):
    n = distances.intra(distances.species_windows(s.ref_windows), seed=0).where("metric = 'intra_pair'").select("marker", F.col("distance").cast("int").alias("distance"), "count")
    every = s.spark.range(16).select(F.col("id").cast("int").alias("distance"))
    return report.complete(n, s.ref_windows.select("marker"), every, {"count": 0})


@query("RSH-07_file_rows", "SELECT concat('SRR', CAST(c_nationkey AS STRING)) AS sample, c_custkey, c_acctbal FROM customer")
def _(s):
    # one scan of all files stands for a frame a file and its unnesting
    return logs.read_benchmarks(s.spark, s.sample_files(), "c_custkey bigint, c_acctbal double")


@query("RSH-07_nested_files", "SELECT c_custkey AS id, concat('SRR', CAST(c_custkey AS STRING)) AS sample, c_acctbal FROM customer")
def _(s):
    # a frame a customer nested in its row, as files read one by one are, and unnested again
    rows = s.table("customer").select(F.expr("concat('/b/SRR', CAST(c_custkey AS STRING), '.txt')").alias("path"), F.struct(F.col("c_custkey").alias("id"), "c_acctbal").alias("row"))
    nested = rows.groupBy("path").agg(F.collect_list("row").alias("data"))
    return nested.select(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("sample"), F.inline("data")).select("id", "sample", "c_acctbal")


@query("RSH-08_codon_rows", "SELECT gene, i, rc, mc, count(*) AS n FROM (SELECT gene, CAST(i AS INT) AS i, rc, mc FROM codons) GROUP BY ALL")
def _(s):
    from .scans import codon_rows

    return codon_rows(s).groupBy("gene", "i", "rc", "mc").agg(F.count("*").alias("n"))


@query("RSH-09_binned", "SELECT marker, cohort, CASE WHEN sample_count > 10 THEN '>10' ELSE CAST(sample_count AS VARCHAR) END AS frequency, CAST(sum(species_count) AS BIGINT) AS n FROM cohort_hist GROUP BY ALL")
def _(s):
    return s.cohort_hist.groupBy("marker", "cohort", report.binned("sample_count", 10).alias("frequency")).agg(F.sum("species_count").alias("n"))


@query("RSH-10_lumped", f"SELECT CASE WHEN p <= 3 THEN stratum_value ELSE 'Other' END AS phylum, count(*) AS n FROM (SELECT stratum_value, rank() OVER (ORDER BY m DESC) AS p FROM ({PHYLA})) GROUP BY ALL")
def _(s):
    medians = phyla(s).groupBy("stratum_value").agg(F.median("n").alias("n"))
    return report.lump(medians, "stratum_value", "n", 3).groupBy(F.col("stratum_value").alias("phylum")).agg(F.count("*").alias("n"))


# ---- domain ----


@query("DOM-01_expected_table", "SELECT rep_codon, n, round(syn9 / 9.0::DOUBLE, 9) AS exp_syn, round(nonsyn9 / 9.0::DOUBLE, 9) AS exp_nonsyn, round(stop9 / 9.0::DOUBLE, 9) AS exp_stop FROM expected JOIN (SELECT substr(sequence, CAST(3 * i + 1 AS INT), 3) AS rep_codon, count(*) AS n FROM counts, range(20) t(i) WHERE length(sequence) = 60 GROUP BY 1) USING (rep_codon)")
def _(s):
    # the expectations of the codons of all windows, with how often each occurs
    seen = s.counts.where(F.length("sequence") == 60).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.substring("sequence", 3 * i + 1, F.lit(3)))).alias("rep_codon"))
    expected = C.expected_table(s.spark).select("rep_codon", *[F.round(c, 9).alias(c) for c in ("exp_syn", "exp_nonsyn", "exp_stop")])
    return seen.groupBy("rep_codon").agg(F.count("*").alias("n")).join(F.broadcast(expected), "rep_codon")


@query("DOM-02_signature", "SELECT gene, f_class, single_read, parent_class, n_pairs, n_pairs_ambiguous, n_single_nt, pos1, pos2, pos3, syn, nonsyn, stop, round(exp_syn, 9) AS exp_syn, round(exp_nonsyn, 9) AS exp_nonsyn, round(exp_stop, 9) AS exp_stop, transitions, n_codons_multi_nt FROM sig")
def _(s):
    return s.make_sig().withColumns({c: F.round(c, 9) for c in ("exp_syn", "exp_nonsyn", "exp_stop")})


@query("DOM-03_pairs", "SELECT gene, rep, member, n_occurrences, sum_hits, rep_n_occurrences FROM pairs")
def _(s):
    return s.make_pairs()


EST = "round(p_obs, 9) AS p_obs, round(p_ref, 9) AS p_ref, round(p_err, 9) AS p_err, round(error_fraction, 7) + 0.0::DOUBLE AS error_fraction, round(error_fraction_se, 7) AS error_fraction_se"


def rounded(e):
    return e.withColumns({c: F.round(c, 9) for c in ("p_obs", "p_ref", "p_err")} | {c: F.round(c, 7) + F.lit(0.0) for c in ("error_fraction", "error_fraction_se")})


@query("DOM-04_error_estimates", f"SELECT scope, marker, f_class, single_read, parent_class, statistic, n_pairs, n_single_nt, {EST} FROM est")
def _(s):
    return rounded(s.est).drop("reference")


@query("DOM-05_reference_scope", f"SELECT 'copy' AS scope, marker, f_class, single_read, parent_class, statistic, n_pairs, n_single_nt, {EST} FROM est")
def _(s):
    both = s.sig_all.unionByName(s.sig_all.where("f_class <> 'f100+'").withColumn("scope", F.lit("copy")))
    return rounded(estimates.estimate(both, "all").where("scope = 'copy'")).drop("reference")


LCHOOSE = "lgamma(CAST({n} + 1 AS DOUBLE)) - lgamma(CAST({k} + 1 AS DOUBLE)) - lgamma(CAST({n} - {k} + 1 AS DOUBLE))"


@query("DOM-06_rarefaction", f"SELECT marker, cohort, round(f, 1) AS fraction, round(sum(species_count * (1 - CASE WHEN n > n_samples - sample_count THEN 0 ELSE exp({LCHOOSE.format(n='(n_samples - sample_count)', k='n')} - ({LCHOOSE.format(n='n_samples', k='n')})) END)), 2) AS species FROM (SELECT *, ceil(round(n_samples * f, 9)) AS n FROM (SELECT *, i / 10.0::DOUBLE AS f FROM cohort_hist JOIN cohorts USING (cohort), range(1, 11) t(i))) GROUP BY ALL")
def _(s):
    r = richness.rarefaction(s.cohort_hist, s.cohorts)
    return r.select("marker", "cohort", F.round("fraction", 1).alias("fraction"), F.round("species", 2).alias("species"))


@query("DOM-07_poisson_richness", f"SELECT marker, cohort, obs AS observed, round(lam, 6) AS poisson_lambda, round(low / (1 - exp(-lam)) + (obs - low), 4) AS poisson_estimate FROM ({POISSON})")
def _(s):
    r = richness.poisson_richness(s.cohort_hist, ("marker", "cohort"))
    return r.select("marker", "cohort", "observed", F.round("poisson_lambda", 6).alias("poisson_lambda"), F.round("poisson_estimate", 4).alias("poisson_estimate"))


def model_sql(table: str, keys: str) -> str:
    return f"SELECT {keys}, model, round(estimate, 2) AS estimate, round(error, 2) AS error FROM ({fits.fits(table, keys)})"


def rounded_fits(df):
    return df.withColumns({c: F.round(c, 2) for c in ("estimate", "error")})


@query("DOM-07_models", model_sql("cohort_hist", "marker, cohort"))
def _(s):
    return rounded_fits(richness.fit_models(s.cohort_hist, ("marker", "cohort")))


@query("DOM-07_selected_models", f"SELECT marker, cohort, model, round(estimate, 2) AS estimate, round(error, 2) AS error FROM ({fits.selected('cohort_hist', 'marker, cohort')})")
def _(s):
    return rounded_fits(richness.select_model(richness.fit_models(s.cohort_hist, ("marker", "cohort")), ("marker", "cohort")))


TABLE_DIGITS = {**{f"{m}_{v}": 2 for m in ("default", "no_f1") for v in ("estimate", "error")}, "f1_f2": 9, "f2_f3": 9}


@query("DOM-07_richness_table", f"SELECT marker, cohort, observed_estimate, default_model, no_f1_model, {', '.join(f'round({c}, {n}) AS {c}' for c, n in TABLE_DIGITS.items())} FROM (SELECT marker, cohort, model AS default_model, estimate AS default_estimate, error AS default_error FROM ({fits.selected('cohort_hist', 'marker, cohort')})) JOIN (SELECT marker, cohort, max(estimate) FILTER (WHERE model = 'observed') AS observed_estimate, max(estimate) FILTER (WHERE model = 'no_f1') AS no_f1_estimate, max(error) FILTER (WHERE model = 'no_f1') AS no_f1_error, max(model) FILTER (WHERE model = 'poisson' AND no_f1) AS no_f1_model FROM (SELECT *, bool_or(model = 'no_f1' AND estimate IS NOT NULL) OVER (PARTITION BY marker, cohort) AS no_f1 FROM ({fits.fits('cohort_hist', 'marker, cohort')})) GROUP BY marker, cohort) USING (marker, cohort) JOIN (SELECT marker, cohort, f1 / nullif(f2, 0) AS f1_f2, f2 / nullif(f3, 0) AS f2_f3 FROM (SELECT marker, cohort, coalesce(sum(species_count) FILTER (WHERE sample_count = 1), 0) AS f1, coalesce(sum(species_count) FILTER (WHERE sample_count = 2), 0) AS f2, coalesce(sum(species_count) FILTER (WHERE sample_count = 3), 0) AS f3 FROM cohort_hist GROUP BY marker, cohort)) USING (marker, cohort)")
def _(s):
    t = richness.richness_table(s.cohort_hist, ("marker", "cohort"))
    return t.withColumns({c: F.round(c, n) for c, n in TABLE_DIGITS.items()})


@query("DOM-08_richness_by_taxon", model_sql("tax_hist", "marker, stratum, stratum_value"))
def _(s):
    return rounded_fits(richness.fit_models(s.tax_hist, ("marker", "stratum", "stratum_value")))


@query("DOM-09_corrected_frequencies", "SELECT h.marker, h.cohort, sample_count, CAST(species_count - CASE WHEN sample_count = 1 THEN least(CAST(round_even(least(greatest(e.error_fraction, 0), 1) * r.n, 0) AS BIGINT), species_count) ELSE 0 END AS BIGINT) AS species_count FROM cohort_hist h JOIN est e ON e.marker = h.marker JOIN (SELECT gene, count(*) FILTER (WHERE sum_hits = 1) AS n FROM counts GROUP BY gene) r ON r.gene = h.marker WHERE e.f_class = 'f1' AND e.single_read AND e.parent_class = 'all' AND e.statistic = 'synonymous'")
def _(s):
    c = richness.corrected_histogram(s.cohort_hist, single_reads(s), errors(s))
    return c.where("estimator = 'Synonymous'").select("marker", "cohort", "sample_count", "species_count")


@query("DOM-09_corrected_richness", f"SELECT marker, cohort, estimator, obs AS observed, round(lam, 6) AS poisson_lambda, round(low / (1 - exp(-lam)) + (obs - low), 4) AS poisson_estimate FROM ({CORRECTED})")
def _(s):
    r = corrected(s)
    return r.select("marker", "cohort", "estimator", "observed", F.round("poisson_lambda", 6).alias("poisson_lambda"), F.round("poisson_estimate", 4).alias("poisson_estimate"))


@query("DOM-10_mismatch_rates", "SELECT marker, f_class, round(syn / n, 9) AS syn_rate, round(stop / n, 9) AS stop_rate, round(pos3 / n, 9) AS pos3_rate FROM (SELECT marker, f_class, sum(n_single_nt) AS n, sum(syn) AS syn, sum(stop) AS stop, sum(pos3) AS pos3 FROM sig_all GROUP BY ALL) WHERE n > 0")
def _(s):
    g = s.sig_all.groupBy("marker", "f_class").agg(*[F.sum(c).alias(c) for c in ("n_single_nt", "syn", "stop", "pos3")]).where("n_single_nt > 0")
    return g.select("marker", "f_class", *[F.round(F.col(c) / F.col("n_single_nt"), 9).alias(f"{c}_rate") for c in ("syn", "stop", "pos3")])


@query("DOM-11_prevalence_spectrum", "SELECT marker, cohort, round(sample_count / n_samples, 9) AS prevalence, round(species_count / sum(species_count) OVER (PARTITION BY marker, cohort), 9) AS share FROM cohort_hist JOIN cohorts USING (cohort)")
def _(s):
    j = report.share(s.cohort_hist.join(F.broadcast(s.cohorts), "cohort"), "species_count", ["marker", "cohort"])
    return j.select("marker", "cohort", F.round(F.col("sample_count") / F.col("n_samples"), 9).alias("prevalence"), F.round("share", 9).alias("share"))


@query("DOM-12_frequency_spectrum", "SELECT marker, cohort, frequency, n, round(n / sum(n) OVER (PARTITION BY marker, cohort), 9) AS share FROM (SELECT marker, cohort, CASE WHEN sample_count > 10 THEN '>10' ELSE CAST(sample_count AS VARCHAR) END AS frequency, CAST(sum(species_count) AS BIGINT) AS n FROM cohort_hist WHERE sample_count > 1 GROUP BY ALL)")
def _(s):
    n = s.cohort_hist.where("sample_count > 1").groupBy("marker", "cohort", report.binned("sample_count", 10).alias("frequency")).agg(F.sum("species_count").alias("n"))
    return report.share(n, "n", ["marker", "cohort"]).withColumn("share", F.round("share", 9))


@query("DOM-13_domain_totals", "SELECT marker, domain, species, round(species / sum(species) OVER (PARTITION BY marker), 9) AS prop FROM (SELECT marker, CASE WHEN stratum_value IN ('d__Bacteria', 'd__Archaea') THEN substr(stratum_value, 4) ELSE 'Unassigned' END AS domain, CAST(sum(species_count) AS BIGINT) AS species FROM tax_hist WHERE stratum = 'domain' GROUP BY ALL)")
def _(s):
    d = F.coalesce(F.regexp_replace("stratum_value", "^d__", ""), F.lit("Unassigned"))
    d = F.when(d == "Eukaryota", "Unassigned").otherwise(d)
    n = s.tax_hist.where("stratum = 'domain'").groupBy("marker", d.alias("domain")).agg(F.sum("species_count").alias("species"))
    return report.share(n, "species", ["marker"], "prop").withColumn("prop", F.round("prop", 9))


@query("DOM-14_clusters_per_species", f"SELECT gene, divergence, n, round(n / sum(n) OVER (PARTITION BY gene), 9) AS share FROM (SELECT split_part(id, '|', 1) AS gene, divergence, count(*) AS n FROM ({BEST}) WHERE divergence IS NOT NULL GROUP BY ALL)")
def _(s):
    m = refmatch.matches(reps(s), refmatch.best_hits(hits(s))).where("divergence IS NOT NULL")
    n = m.groupBy(F.split("id", "\\|")[0].alias("gene"), "divergence").agg(F.count("*").alias("n"))
    return report.share(n, "n", ["gene"]).withColumn("share", F.round("share", 9))


@query("DOM-15_completeness", f"SELECT marker, cohort, round(obs / (low / (1 - exp(-lam)) + (obs - low)), 7) AS completeness FROM ({POISSON})")
def _(s):
    r = richness.poisson_richness(s.cohort_hist, ("marker", "cohort"))
    return r.select("marker", "cohort", F.round(F.try_divide(F.col("observed").cast("double"), F.col("poisson_estimate")), 7).alias("completeness"))


@query("DOM-16_percent_retained", f"SELECT gene, round(100.0::DOUBLE * genome_linked / (genome_linked + multi_sample + multi_hit + single_singleton), 7) AS percent FROM ({WIDE})")
def _(s):
    total = sum((F.col(c) for c in clusterstats.CLUSTER_TYPES), F.lit(0))
    return wide_types(s).select("gene", F.round(F.lit(100.0) * F.col("genome_linked") / total, 7).alias("percent"))


# ---- clustering ----

#: Windows a marker in a batch of CLU-03 at most, and how many batches there are at least.
CHUNK, BATCHES = 2_000_000, 4


def greedy_sql(windows: str) -> str:
    """The rule one window at a time: the centroids so far are kept a marker. windows: SELECT gene, seq_num, sequence."""
    return f"""SELECT gene, member, rep, divergence FROM (
  WITH RECURSIVE w AS MATERIALIZED (SELECT gene, seq_num AS n, sequence AS member, translate(sequence, '-', 'N') AS s FROM ({windows})),
  c(gene, n, found) USING KEY (gene) AS (
    SELECT DISTINCT gene, -1::BIGINT, CAST([] AS STRUCT(n BIGINT, s VARCHAR)[]) FROM w
    UNION
    SELECT c.gene, w.n, CASE WHEN list_bool_or([hamming(x.s, w.s) <= 2 for x in c.found]) THEN c.found ELSE list_append(c.found, {{'n': w.n, 's': w.s}}) END FROM c JOIN w ON w.gene = c.gene AND w.n = c.n + 1),
  r AS MATERIALIZED (SELECT gene, unnest(found, recursive := true) FROM c)
  SELECT w.gene, w.member, r.s AS rep, CAST(hamming(w.s, r.s) AS INT) AS divergence, row_number() OVER (PARTITION BY w.gene, w.n ORDER BY hamming(w.s, r.s), r.n) AS p
  FROM w JOIN r ON r.gene = w.gene AND r.n <= w.n AND hamming(w.s, r.s) <= 2) WHERE p = 1"""


GREEDY = greedy_sql("SELECT gene, seq_num, sequence FROM dedup")


@query("CLU-01_greedy_clusters", GREEDY)
def _(s):
    return clustering.cluster(s.dedup.select("gene", "seq_num", "sequence"))


@query("CLU-02_banded_pairs", "SELECT a.gene, a.sequence AS a, b.sequence AS b, CAST(hamming(a.sequence, b.sequence) AS INT) AS divergence FROM counts a JOIN counts b ON a.gene = b.gene AND a.sequence < b.sequence AND hamming(a.sequence, b.sequence) <= 2")
def _(s):
    rows = s.counts.select("gene", F.col("sequence").alias("id"), "sequence")
    return clustering.near_pairs(rows, rows).where("a < b").select("gene", "a", "b", F.col("divergence").cast("int").alias("divergence"))


BLOCKS = ", ".join(f"substr(sequence, {15 * i + 1}, 15) || substr(sequence, {15 * j + 1}, 15)" for i in range(4) for j in range(i + 1, 4))


@query("CLU-02_bucket_sizes", f"SELECT gene, combo, count(*) AS n_buckets, max(n) AS largest, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS candidate_pairs FROM (SELECT gene, combo, part, count(*) AS n FROM (SELECT gene, CAST(unnest(range(6)) AS INT) AS combo, unnest([{BLOCKS}]) AS part FROM counts WHERE length(sequence) = 60) GROUP BY ALL) GROUP BY gene, combo")
def _(s):
    return clustering.bucket_sizes(s.counts.select("gene", "sequence"))


@query("CLU-03_chunked_clusters", GREEDY)
def _(s):
    # batches come one after the other, each onto the stored centroids of those before it
    n = (s.dedup.agg(F.max("seq_num")).first()[0] or 0) + 1
    size = max(1, min(CHUNK, -(-n // BATCHES)))
    return cluster_store.cluster_chunked(s.dedup.select("gene", "seq_num", "sequence"), size, f"{s.folder()}/clusters-{uuid.uuid4().hex}")


@query("CLU-04_chains", "SELECT CAST(p_partkey AS VARCHAR) AS member, CAST((p_partkey - 1) % 100 + 1 AS VARCHAR) AS rep FROM part")
def _(s):
    p = F.col("p_partkey")
    rounds = s.table("part").select(p.cast("string").alias("member"), F.when(p > 100, p - 100).otherwise(p).cast("string").alias("rep"))
    return clustering.resolve_chains(rounds)


SPECIES_WINDOWS = f"SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY sequence) - 1 AS seq_num, sequence FROM (SELECT DISTINCT marker AS gene, sequence FROM ({LEAST}))"


@query("CLU-05_reference_clusters", f"SELECT gene, count(*) AS n_species_windows, count(DISTINCT rep) AS n_clusters FROM ({greedy_sql(SPECIES_WINDOWS)}) GROUP BY gene")
def _(s):
    r = distances.species_representative(distances.species_windows(s.ref_windows)).select(F.col("marker").alias("gene"), "sequence").distinct()
    ordered = numbered(r, ["sequence"], ("gene",), "seq_num", 0)
    return clustering.cluster(ordered).groupBy("gene").agg(F.count("*").alias("n_species_windows"), F.countDistinct("rep").alias("n_clusters"))


@query("CLU-06_strict_matches", f"SELECT count(divergence) AS confirmed, count(*) AS total FROM ({BEST})")
def _(s):
    m = refmatch.matches(reps(s), refmatch.best_hits(hits(s), reps(s), 2))
    return m.agg(F.count("divergence").alias("confirmed"), F.count("*").alias("total"))


@query("CLU-07_nearest_taxonomy", "SELECT gene, divergence, count(*) AS n FROM (SELECT q.gene, q.member, CAST(min(hamming(q.member, r.rep)) AS INT) AS divergence FROM (SELECT DISTINCT gene, member FROM clusters) q JOIN (SELECT DISTINCT gene, rep FROM clusters) r ON q.gene = r.gene AND hamming(q.member, r.rep) <= 2 GROUP BY ALL) GROUP BY ALL")
def _(s):
    return nearest(s).groupBy("gene", "divergence").agg(F.count("*").alias("n"))


# Reference windows of two thirds of the species: the others' windows have none near
FEW = "SELECT marker AS gene, min(species) AS species, sequence FROM ref_windows WHERE CAST(substr(species, 5) AS INT) % 3 > 0 GROUP BY marker, sequence"
WITHIN = f"SELECT q.gene, q.member AS id, min(CASE WHEN hamming(q.member, r.sequence) <= 8 THEN hamming(q.member, r.sequence) END) AS divergence, arg_min(r.species, (hamming(q.member, r.sequence), r.sequence)) AS species FROM (SELECT DISTINCT gene, member FROM clusters WHERE length(member) = 60) q LEFT JOIN ({FEW}) r ON q.gene = r.gene GROUP BY ALL"


def few_references(s):
    few = s.ref_windows.where(F.substring("species", 5, 9).cast("int") % 3 > 0).groupBy(F.col("marker").alias("gene"), "sequence").agg(F.min("species").alias("species"))
    return few.select("gene", F.col("sequence").alias("id"), "sequence", F.concat(F.lit("Root; d__D; p__P; "), "species").alias("taxonomy"))


def widened(s):
    q = s.clusters.select("gene", F.col("member").alias("id"), F.col("member").alias("sequence")).distinct()
    return refmatch.nearest_widening(q, few_references(s))


@query("CLU-07_within_8", f"SELECT gene, id AS query, CAST(divergence AS INT) AS divergence, CASE WHEN divergence IS NULL THEN 'none_within_8' ELSE 'matched' END AS status, CASE WHEN divergence IS NOT NULL THEN species END AS species FROM ({WITHIN})")
def _(s):
    return widened(s).select("gene", "query", "divergence", "status", S.species_of("taxonomy").alias("species"))


@query("CLU-07_assigned", f"SELECT gene, CASE WHEN divergence IS NOT NULL THEN 'd__D' END AS domain, CASE WHEN divergence IS NOT NULL THEN 'p__P' END AS phylum, CAST(divergence AS INT) AS divergence, count(*) AS n FROM ({WITHIN}) GROUP BY ALL")
def _(s):
    q = s.clusters.select("gene", F.col("member").alias("id"), F.col("member").alias("sequence")).distinct()
    return refmatch.assign_taxonomy(q, few_references(s)).groupBy("gene", "domain", "phylum", "divergence").agg(F.count("*").alias("n"))


@query("CLU-07_taxonomy_histogram", f"SELECT w.gene, stratum, CASE WHEN divergence IS NOT NULL THEN name END AS stratum_value, CAST(n_samples AS BIGINT) AS sample_count, count(*) AS species_count FROM ({WITHIN}) w JOIN per_seq p ON p.gene = w.gene AND p.rep = w.id, (VALUES ('domain', 'd__D'), ('phylum', 'p__P')) v(stratum, name) GROUP BY ALL")
def _(s):
    # every sequence as a representative: its nearest reference's domain and phylum, and the samples that it is in
    reps_ = s.per_seq.where(F.length("rep") == 60)
    named = refmatch.assign_taxonomy(reps_.select("gene", F.col("rep").alias("id"), F.col("rep").alias("sequence")), few_references(s))
    return strata.taxonomy_histogram(named.join(refmatch.shuffled(reps_.select("gene", F.col("rep").alias("id"), "n_samples")), ["gene", "id"]))


HAMMING = "least(hamming(a.sequence, b.sequence), 15)"
SIX = (
    "SELECT marker, 'n_genome_windows' AS metric, 0 AS distance, count(*) AS count FROM ref_windows GROUP BY marker",
    "SELECT marker, 'n_species', 0, count(DISTINCT species) FROM ref_windows GROUP BY marker",
    f"SELECT a.marker, 'intra_pair', {HAMMING} AS d, count(*) FROM ({UNIQUE}) a JOIN ({UNIQUE}) b ON a.marker = b.marker AND a.species = b.species AND a.sequence < b.sequence GROUP BY a.marker, d",
    f"SELECT marker, 'intra_diameter', d, count(*) FROM (SELECT u.marker, u.species, least(coalesce(max(hamming(a.sequence, b.sequence)), 0), 15) AS d FROM (SELECT DISTINCT marker, species FROM ref_windows) u LEFT JOIN ({UNIQUE}) a ON a.marker = u.marker AND a.species = u.species LEFT JOIN ({UNIQUE}) b ON a.marker = b.marker AND a.species = b.species AND a.sequence < b.sequence GROUP BY ALL) GROUP BY marker, d",
    f"SELECT a.marker, 'inter_sampled_all', {HAMMING} AS d, count(*) FROM ({LEAST}) a JOIN ({LEAST}) b ON a.marker = b.marker AND a.species <> b.species GROUP BY a.marker, d",
    f"SELECT marker, 'inter_sampled_nearest', least(d, 15) AS d, count(*) FROM (SELECT a.marker, a.species, min(hamming(a.sequence, b.sequence)) AS d FROM ({LEAST}) a JOIN ({LEAST}) b ON a.marker = b.marker AND a.species <> b.species GROUP BY ALL) GROUP BY marker, least(d, 15)",
)


@query("CLU-08_distances", "SELECT marker, metric, CAST(distance AS INT) AS distance, count FROM (" + " UNION ALL ".join(SIX) + ")")
def _(s):
    return distances.distances(s.ref_windows).withColumn("distance", F.col("distance").cast("int"))


# ---- many files ----


@query("SRC-24_benchmarks", "SELECT sample, round(sum(c_acctbal), 2) AS s FROM (SELECT concat('SRR', CAST(c_nationkey AS STRING)) AS sample, c_acctbal FROM customer) GROUP BY sample")
def _(s):
    rows = logs.read_benchmarks(s.spark, s.sample_files(), "c_custkey bigint, c_acctbal double")
    return rows.groupBy("sample").agg(F.round(F.sum("c_acctbal"), 2).alias("s"))


@query("SRC-25_collate", "SELECT gene, count(*) AS n, count(DISTINCT sample) AS samples FROM indexed GROUP BY gene")
def _(s):
    return s.make_indexed().groupBy("gene").agg(F.count("*").alias("n"), F.countDistinct("sample").alias("samples"))

