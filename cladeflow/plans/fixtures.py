"""Marker windows and sample metadata made from the star-schema tables, in SQL that both engines run."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalise_gaps
from ..sources.publish import complete, file_system
from ..sources.shared import shared_folder

#: Tables of a Fixture that are written before they are read, each after those that it is made from.
STORED = (
    "otu", "meta", "counts", "clusters", "raw_clusters", "pairs", "indexed", "dedup", "samples", "stats", "sig", "tags", "histo", "per_seq",
    "cohort_hist", "ref_windows", "tax_hist",
)

OTU_HITS = """
WITH k AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CAST(l_quantity AS INT) AS qty,
         l_partkey % 41 AS base_id, l_partkey % 2 AS gene_id,
         (l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 64 AS r,
         (l_orderkey * 7 + l_suppkey) % 60 AS p1, (l_orderkey * 11 + l_partkey) % 60 AS p2,
         (l_orderkey + l_linenumber) % 5 AS nt
  FROM lineitem),
b AS (
  SELECT *, substr(translate(concat(md5(CAST(base_id AS STRING)), md5(concat('b', CAST(base_id AS STRING)))),
                   '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 60) AS base FROM k),
m AS (
  SELECT *, CASE WHEN r < 40 THEN base
                 WHEN r < 52 THEN concat(substr(base, 1, CAST(3 * (base_id % 20) + 2 AS INT)), 'T', substr(base, CAST(3 * (base_id % 20) + 4 AS INT)))
                 ELSE concat(substr(base, 1, CAST(p1 AS INT)), substr('ACGT-', CAST(1 + nt AS INT), 1), substr(base, CAST(p1 + 2 AS INT))) END AS s1 FROM b)
SELECT concat('SRR', CAST(l_orderkey AS STRING)) AS sample,
       concat('S3.', CAST(gene_id + 1 AS STRING), '.synthetic_marker') AS gene,
       CASE WHEN r < 60 THEN s1 ELSE concat(substr(s1, 1, CAST(p2 AS INT)), substr('GTACA', CAST(1 + nt AS INT), 1), substr(s1, CAST(p2 + 2 AS INT))) END AS sequence,
       CASE WHEN r >= 52 AND qty % 2 = 0 THEN 1 ELSE qty END AS num_hits,
       concat('Root; d__', CASE WHEN base_id % 11 = 0 THEN 'Eukaryota' WHEN base_id % 5 = 0 THEN 'Archaea' ELSE 'Bacteria' END,
              '; p__P', CAST(base_id % 7 AS STRING), '; s__S', CAST(base_id AS STRING)) AS taxonomy,
       CASE WHEN l_returnflag = 'A' THEN 'singlem_query_based' ELSE 'diamond' END AS taxonomy_assignment_method,
       base AS planted_rep
FROM m
"""

SAMPLE_METADATA = """
SELECT concat('SRR', CAST(o_orderkey AS STRING)) AS acc,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS STRING) END AS year,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'human gut metagenome'
            WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'soil metagenome' END AS organism
FROM orders
"""

#: Views for the oracle, each in terms of those before it; `oracle` adds the ones a query names.
VIEWS: dict[str, str] = {
    "otu_hits": OTU_HITS,
    "sample_metadata": SAMPLE_METADATA,
    "otu": "SELECT *, translate(sequence, '-', 'N') AS seq FROM otu_hits",
    "counts": "SELECT gene, seq AS sequence, count(*) AS n_occurrences, CAST(sum(num_hits) AS BIGINT) AS sum_hits FROM otu GROUP BY ALL",
    "clusters": "SELECT DISTINCT gene, seq AS member, planted_rep AS rep FROM otu",
    "indexed": "SELECT *, CASE WHEN taxonomy_assignment_method = 'singlem_query_based' THEN 0 ELSE 1 END AS unknown, row_number() OVER (PARTITION BY sample, gene ORDER BY CASE WHEN taxonomy_assignment_method = 'singlem_query_based' THEN 0 ELSE 1 END, num_hits DESC, sequence, taxonomy) - 1 AS otu_idx FROM otu_hits",
    "placed": "SELECT *, row_number() OVER (PARTITION BY gene ORDER BY sample, otu_idx) AS pos FROM indexed",
    "uniq": "SELECT gene, sequence, min(pos) AS first_pos, min(unknown) AS unknown, max(num_hits) AS hits, count(*) AS n_occurrences, CAST(sum(num_hits) AS BIGINT) AS sum_hits FROM placed GROUP BY gene, sequence",
    "dedup": "SELECT gene, sequence, unknown, hits, n_occurrences, sum_hits, row_number() OVER (PARTITION BY gene ORDER BY first_pos) - 1 AS seq_num FROM uniq",
    "rep_samples": "SELECT gene, planted_rep AS rep, count(DISTINCT sample) AS n_samples FROM otu GROUP BY ALL",
    "raw_clusters": "SELECT DISTINCT gene, sequence AS member, planted_rep AS rep FROM otu",
    "stats": "SELECT c.gene, c.rep, CAST(sum(d.n_occurrences) AS BIGINT) AS cluster_size, CAST(sum(CASE WHEN d.unknown = 0 THEN d.n_occurrences ELSE 0 END) AS BIGINT) AS n_query, CAST(max(d.hits) AS BIGINT) AS max_hits, CAST(sum(d.sum_hits) AS BIGINT) AS total_hits, max(r.n_samples) AS n_samples FROM raw_clusters c JOIN dedup d ON c.gene = d.gene AND c.member = d.sequence JOIN rep_samples r ON r.gene = c.gene AND r.rep = c.rep GROUP BY c.gene, c.rep",
    "pairs": "SELECT c.gene, c.rep, c.member, m.n_occurrences, m.sum_hits, r.n_occurrences AS rep_n_occurrences FROM clusters c JOIN counts m ON m.gene = c.gene AND m.sequence = c.member JOIN counts r ON r.gene = c.gene AND r.sequence = c.rep WHERE c.rep <> c.member AND m.n_occurrences < r.n_occurrences",
    "classed": "SELECT *, CASE WHEN n_occurrences = 1 THEN 'f1' WHEN n_occurrences = 2 THEN 'f2' WHEN n_occurrences = 3 THEN 'f3' WHEN n_occurrences < 10 THEN 'f4-9' WHEN n_occurrences < 100 THEN 'f10-99' ELSE 'f100+' END AS f_class, sum_hits = n_occurrences AS single_read, CASE WHEN rep_n_occurrences < 10 THEN 'p<10' WHEN rep_n_occurrences < 100 THEN 'p10-99' WHEN rep_n_occurrences < 1000 THEN 'p100-999' ELSE 'p1000+' END AS parent_class, regexp_matches(rep, '[^ACGT]') OR regexp_matches(member, '[^ACGT]') AS ambiguous FROM pairs WHERE length(rep) = 60 AND length(member) = 60",
    "bases": "SELECT * FROM (VALUES (0, 'T'), (1, 'C'), (2, 'A'), (3, 'G')) AS v(i, b)",
    "code": "SELECT x.b || y.b || z.b AS codon, substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(16 * x.i + 4 * y.i + z.i + 1 AS INT), 1) AS aa FROM bases x, bases y, bases z",
    "expected": "SELECT a.codon AS rep_codon, count(*) FILTER (WHERE b.aa = a.aa) AS syn9, count(*) FILTER (WHERE b.aa <> a.aa AND b.aa <> '*') AS nonsyn9, count(*) FILTER (WHERE b.aa = '*') AS stop9 FROM code a JOIN code b ON hamming(a.codon, b.codon) = 1 WHERE a.aa <> '*' GROUP BY a.codon",
    "codons": "SELECT *, hamming(rc, mc) AS n_diff FROM (SELECT p.*, i, substr(rep, CAST(3 * i + 1 AS INT), 3) AS rc, substr(member, CAST(3 * i + 1 AS INT), 3) AS mc FROM classed p, range(20) t(i)) WHERE rc <> mc AND regexp_full_match(rc, '[ACGT]{3}') AND regexp_full_match(mc, '[ACGT]{3}')",
    "single": "SELECT c.*, r.aa AS rep_aa, m.aa AS mem_aa, syn9, nonsyn9, stop9, CASE WHEN substr(rc, 1, 1) <> substr(mc, 1, 1) THEN 1 WHEN substr(rc, 2, 1) <> substr(mc, 2, 1) THEN 2 ELSE 3 END AS pos FROM codons c JOIN code r ON r.codon = c.rc JOIN code m ON m.codon = c.mc JOIN expected e ON e.rep_codon = c.rc WHERE n_diff = 1 AND r.aa <> '*'",
    "sig": "SELECT gene, f_class, single_read, parent_class, n_pairs, n_pairs_ambiguous, coalesce(n_single_nt, 0) AS n_single_nt, coalesce(pos1, 0) AS pos1, coalesce(pos2, 0) AS pos2, coalesce(pos3, 0) AS pos3, coalesce(syn, 0) AS syn, coalesce(nonsyn, 0) AS nonsyn, coalesce(stop, 0) AS stop, coalesce(es, 0) / 9.0::DOUBLE AS exp_syn, coalesce(en, 0) / 9.0::DOUBLE AS exp_nonsyn, coalesce(et, 0) / 9.0::DOUBLE AS exp_stop, coalesce(transitions, 0) AS transitions, coalesce(n_codons_multi_nt, 0) AS n_codons_multi_nt FROM (SELECT gene, f_class, single_read, parent_class, count(*) AS n_pairs, count(*) FILTER (WHERE ambiguous) AS n_pairs_ambiguous FROM classed GROUP BY ALL) LEFT JOIN (SELECT gene, f_class, single_read, parent_class, count(*) AS n_single_nt, count(*) FILTER (WHERE pos = 1) AS pos1, count(*) FILTER (WHERE pos = 2) AS pos2, count(*) FILTER (WHERE pos = 3) AS pos3, count(*) FILTER (WHERE rep_aa = mem_aa) AS syn, count(*) FILTER (WHERE rep_aa <> mem_aa AND mem_aa <> '*') AS nonsyn, count(*) FILTER (WHERE mem_aa = '*') AS stop, CAST(sum(syn9) AS BIGINT) AS es, CAST(sum(nonsyn9) AS BIGINT) AS en, CAST(sum(stop9) AS BIGINT) AS et, count(*) FILTER (WHERE substr(rc, pos, 1) || substr(mc, pos, 1) IN ('AG', 'GA', 'CT', 'TC')) AS transitions FROM single GROUP BY ALL) USING (gene, f_class, single_read, parent_class) LEFT JOIN (SELECT gene, f_class, single_read, parent_class, count(*) AS n_codons_multi_nt FROM codons WHERE n_diff > 1 GROUP BY ALL) USING (gene, f_class, single_read, parent_class)",
    "sig_all": "SELECT 'all' AS scope, gene AS marker, * EXCLUDE (gene), 1.0::DOUBLE AS sample_fraction FROM sig",
    "sig_pooled": "SELECT scope, marker, f_class, single_read, parent_class, n_pairs, n_single_nt, pos3, syn, stop, exp_syn, exp_stop FROM sig_all UNION ALL SELECT scope, marker, f_class, single_read, 'all', CAST(sum(n_pairs) AS BIGINT), CAST(sum(n_single_nt) AS BIGINT), CAST(sum(pos3) AS BIGINT), CAST(sum(syn) AS BIGINT), CAST(sum(stop) AS BIGINT), sum(exp_syn), sum(exp_stop) FROM sig_all GROUP BY scope, marker, f_class, single_read",
    "sig_ref": "SELECT scope, marker, sum(n_single_nt)::DOUBLE AS rn, sum(pos3)::DOUBLE AS rpos3, sum(syn)::DOUBLE AS rsyn, sum(stop)::DOUBLE AS rstop FROM sig_all WHERE f_class = 'f100+' GROUP BY ALL",
    "est": "SELECT scope, marker, f_class, single_read, parent_class, statistic, n_pairs, n_single_nt, p_obs, p_ref, p_err, (p_ref - p_obs) / nullif(p_ref - p_err, 0) AS error_fraction, sqrt(p_obs * (1 - p_obs) / n_single_nt) / nullif(abs(p_ref - p_err), 0) AS error_fraction_se FROM (SELECT p.scope, p.marker, f_class, single_read, parent_class, n_pairs, n_single_nt, 'codon_position' AS statistic, pos3 / n_single_nt AS p_obs, rpos3 / nullif(rn, 0) AS p_ref, 1.0::DOUBLE / 3 AS p_err FROM sig_pooled p JOIN sig_ref USING (scope, marker) WHERE n_single_nt > 0 UNION ALL SELECT p.scope, p.marker, f_class, single_read, parent_class, n_pairs, n_single_nt, 'synonymous', syn / n_single_nt, rsyn / nullif(rn, 0), exp_syn / n_single_nt FROM sig_pooled p JOIN sig_ref USING (scope, marker) WHERE n_single_nt > 0 UNION ALL SELECT p.scope, p.marker, f_class, single_read, parent_class, n_pairs, n_single_nt, 'stop_codon', stop / n_single_nt, rstop / nullif(rn, 0), exp_stop / n_single_nt FROM sig_pooled p JOIN sig_ref USING (scope, marker) WHERE n_single_nt > 0) WHERE f_class <> 'f100+'",
    "rep_meta": "SELECT DISTINCT o.gene, o.planted_rep AS rep, o.sample, TRY_CAST(CASE WHEN regexp_full_match(m.year, '[0-9]+') THEN m.year END AS INT) AS y, coalesce(m.organism = 'human gut metagenome', false) AS human FROM otu o LEFT JOIN sample_metadata m ON m.acc = o.sample",
    "tags": "SELECT gene, rep, sample, 'year' AS stratum, y AS value FROM rep_meta WHERE y IS NOT NULL UNION ALL SELECT gene, rep, sample, 'human_all', NULL FROM rep_meta WHERE human UNION ALL SELECT gene, rep, sample, 'human_per_year', y FROM rep_meta WHERE human AND y IS NOT NULL",
    "year_cuts": "SELECT DISTINCT CAST(year AS INT) AS cut FROM sample_metadata WHERE regexp_full_match(year, '[0-9]+')",
    "histo": "SELECT gene, stratum, stratum_value, sample_count, count(*) AS species_count FROM (SELECT gene, rep, stratum, 'all' AS stratum_value, count(*) AS sample_count FROM tags WHERE value IS NULL GROUP BY ALL UNION ALL SELECT gene, rep, stratum, CAST(cut AS VARCHAR), count(*) FROM tags JOIN year_cuts ON value <= cut GROUP BY gene, rep, stratum, cut) GROUP BY ALL",
    "prev": "SELECT gene, n_samples AS sample_count, count(*) AS species_count FROM stats GROUP BY ALL",
    "cohort_hist": "SELECT gene AS marker, 'all' AS cohort, n AS sample_count, count(*) AS species_count FROM (SELECT gene, seq, count(DISTINCT sample) AS n FROM otu GROUP BY ALL) GROUP BY ALL UNION ALL SELECT gene, 'human-gut', n, count(*) FROM (SELECT gene, seq, count(DISTINCT sample) AS n FROM otu JOIN sample_metadata m ON m.acc = sample AND m.organism = 'human gut metagenome' GROUP BY ALL) GROUP BY ALL",
    "cohorts": "SELECT 'all' AS cohort, count(*) AS n_samples FROM sample_metadata UNION ALL SELECT 'human-gut', count(*) FROM sample_metadata WHERE organism = 'human gut metagenome'",
    "ref_windows": "SELECT gene AS marker, trim(split_part(taxonomy, ';', -1)) AS species, seq AS sequence FROM otu WHERE num_hits >= 48",
    "typed": "SELECT s.gene, s.rep, s.n_samples, s.total_hits, CASE WHEN length(s.rep) - length(replace(s.rep, 'A', '')) > 16 THEN 'confirmed' END AS globdb_status FROM per_seq s",
    "per_seq": "SELECT gene, seq AS rep, count(DISTINCT sample) AS n_samples, CAST(sum(num_hits) AS BIGINT) AS total_hits FROM otu GROUP BY ALL",
    "type_rows": "SELECT *, CASE WHEN globdb_status = 'confirmed' THEN 'genome_linked' WHEN n_samples > 1 THEN 'multi_sample' WHEN total_hits > 1 THEN 'multi_hit' ELSE 'single_singleton' END AS cluster_type FROM typed",
    "tax_hist": "SELECT gene AS marker, stratum, stratum_value, sample_count, count(*) AS species_count FROM (SELECT gene, seq, 'domain' AS stratum, regexp_extract(max(taxonomy), 'd__[A-Za-z]+') AS stratum_value, count(DISTINCT sample) AS sample_count FROM otu GROUP BY gene, seq UNION ALL SELECT gene, seq, 'phylum', regexp_extract(max(taxonomy), 'p__[A-Za-z0-9]+'), count(DISTINCT sample) FROM otu GROUP BY gene, seq) GROUP BY ALL",
}
_ORDER = {n: i for i, n in enumerate(["otu_hits", "sample_metadata", "otu", "counts", "clusters", "indexed", "placed", "uniq", "dedup", "rep_samples", "raw_clusters", "stats", "pairs", "classed", "bases", "code", "expected", "codons", "single", "sig", "sig_all", "sig_pooled", "sig_ref", "est", "rep_meta", "tags", "year_cuts", "histo", "prev", "cohort_hist", "cohorts", "ref_windows", "per_seq", "typed", "type_rows", "tax_hist"])}


def oracle(sql: str) -> str:
    """A query with the views that it needs before it."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    views = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in sorted(needed, key=_ORDER.__getitem__))
    return f"WITH {views} {sql}" if views else sql


class Fixture:
    """The tables of one run as DataFrames, made when first asked for.

    Those in STORED are written once a session and folder of tables, as the stages of a run are, and read from there;
    queries of the operators that make them call `make_` and what it needs.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def folder(self) -> str:
        """Where this session keeps what is made from these tables."""
        key = hashlib.md5(self.sf_dir.encode()).hexdigest()[:12]
        return f"{shared_folder(self.spark).rstrip('/')}/tables-{self.spark.sparkContext.applicationId}/{key}"

    def written(self, name: str, write: Callable[[str], None]) -> str:
        """The path of files that `write` makes once."""
        path = f"{self.folder()}/{name}"
        if not complete(self.spark, path):
            write(path)
        return path

    def stored(self, name: str) -> DataFrame:
        make = getattr(self, f"make_{name}")
        path = self.written(name, lambda to: make().write.mode("overwrite").parquet(to))
        self.__dict__[name] = self.spark.read.parquet(path)
        return self.__dict__[name]

    def tsv(self, name: str, df: DataFrame, header: bool = True) -> str:
        """The path of a folder of tab-separated files that hold the rows."""
        return self.written(name, lambda to: df.write.mode("overwrite").csv(to, sep="\t", header=header))

    def sample_files(self) -> str:
        """A pattern of tab-separated files, one a nation, named by a sample: customers' keys and balances."""

        def write(to: str) -> None:
            rows = self.table("customer").select(F.expr("concat('SRR', CAST(c_nationkey AS STRING))").alias("sample"), "c_custkey", "c_acctbal")
            made = f"{to}/by"
            rows.repartition("sample").write.mode("overwrite").partitionBy("sample").csv(made, sep="\t", header=True)
            fs, _ = file_system(self.spark, made)
            for folder in fs.listStatus(file_system(self.spark, made)[1]):
                name = folder.getPath().getName()
                if "=" in name:
                    for part in fs.listStatus(folder.getPath()):
                        if part.getPath().getName().startswith("part-"):
                            fs.rename(part.getPath(), file_system(self.spark, f"{to}/{name.split('=')[1]}.txt")[1])
            fs.create(file_system(self.spark, f"{to}/_SUCCESS")[1]).close()

        return f"{self.written('sample_files', write)}/*.txt"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in STORED:
            raise AttributeError(name)
        return self.stored(name)

    def store(self) -> dict[str, float]:
        """Everything in STORED, and the seconds that each took."""
        took = {}
        for name in STORED:
            began = time.perf_counter()
            self.stored(name)
            took[name] = round(time.perf_counter() - began, 3)
        return took

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def make_otu(self) -> DataFrame:
        return self.spark.sql(OTU_HITS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=self.table("lineitem"))

    def make_meta(self) -> DataFrame:
        return self.spark.sql(SAMPLE_METADATA.replace("FROM orders", "FROM {orders}"), orders=self.table("orders"))

    @cached_property
    def seqs(self) -> DataFrame:
        return self.otu.withColumn("seq", normalise_gaps("sequence"))

    @cached_property
    def seen(self) -> DataFrame:
        """Windows dealt by sample, so that what a sample has often meets in a task of few rows."""
        from ..sources.shared import dealt

        return dealt(self.seqs.select("gene", "seq", "sample", "num_hits", "taxonomy"), "sample", rows=self.otu.count())

    def make_counts(self) -> DataFrame:
        from ..operators.collate import counts_table, rows_of

        return counts_table(rows_of(self.otu, ("gene",)), ("gene",))

    def make_clusters(self) -> DataFrame:
        return self.seqs.select("gene", F.col("seq").alias("member"), F.col("planted_rep").alias("rep")).distinct()

    def make_raw_clusters(self) -> DataFrame:
        return self.otu.select("gene", F.col("sequence").alias("member"), F.col("planted_rep").alias("rep")).distinct()

    def make_pairs(self) -> DataFrame:
        from ..operators.signature import build_pairs

        return build_pairs(self.counts, self.clusters, ("gene",))

    def make_indexed(self) -> DataFrame:
        from ..operators.collate import indexed

        # what no query reads of a placed window is not moved
        return indexed(self.otu.drop("planted_rep"), ordinal=("sequence", "taxonomy"), position="position").drop("taxonomy", "taxonomy_assignment_method")

    def make_dedup(self) -> DataFrame:
        from ..operators.collate import dedup

        return dedup(self.indexed, F.col("position"))

    def make_samples(self) -> DataFrame:
        from ..operators.clusterstats import rep_sample_counts

        return rep_sample_counts(self.otu, self.raw_clusters)

    def make_stats(self) -> DataFrame:
        from ..operators.clusterstats import cluster_stats

        return cluster_stats(self.raw_clusters, self.dedup, self.samples)

    def make_sig(self) -> DataFrame:
        from ..operators.signature import signature

        return signature(self.pairs, ("gene",))

    @cached_property
    def sig_all(self) -> DataFrame:
        from ..operators.signature import labelled

        return labelled(self.sig.withColumnRenamed("gene", "marker"), "all")

    @cached_property
    def est(self) -> DataFrame:
        from ..operators.estimates import estimate

        return estimate(self.sig_all)

    def make_tags(self) -> DataFrame:
        from ..operators.strata import tagged

        return tagged(self.otu, self.clusters, self.meta)

    def make_histo(self) -> DataFrame:
        from ..operators.strata import histogram

        return histogram(self.tags, self.meta)

    def make_per_seq(self) -> DataFrame:
        each = self.seen.groupBy("gene", "seq", "sample").agg(F.sum("num_hits").alias("hits"))
        return each.groupBy("gene", F.col("seq").alias("rep")).agg(F.count("sample").alias("n_samples"), F.sum("hits").cast("bigint").alias("total_hits"))

    @cached_property
    def type_rows(self) -> DataFrame:
        from ..operators.clusterstats import with_cluster_type

        a = F.length("rep") - F.length(F.replace("rep", F.lit("A"), F.lit("")))
        return with_cluster_type(self.per_seq.withColumn("globdb_status", F.when(a > 16, "confirmed")))

    def make_cohort_hist(self) -> DataFrame:
        def of(pairs: DataFrame, name: str) -> DataFrame:
            n = pairs.groupBy("gene", "seq").agg(F.count("sample").alias("sample_count"))
            return n.groupBy(F.col("gene").alias("marker"), F.lit(name).alias("cohort"), "sample_count").agg(F.count("*").alias("species_count"))

        from ..operators.collate import keep_samples

        pairs = self.seen.select("gene", "seq", "sample").distinct()
        return of(pairs, "all").unionByName(of(keep_samples(pairs, self.meta), "human-gut"))

    @cached_property
    def cohorts(self) -> DataFrame:
        human = F.count_if(F.col("organism") == "human gut metagenome").alias("human-gut")
        return self.meta.agg(F.count("*").alias("all"), human).unpivot([], ["all", "human-gut"], "cohort", "n_samples")

    def make_ref_windows(self) -> DataFrame:
        from ..functions.scalars import species_of

        return self.seqs.where("num_hits >= 48").select(F.col("gene").alias("marker"), species_of("taxonomy").alias("species"), F.col("seq").alias("sequence"))

    def make_tax_hist(self) -> DataFrame:
        from ..functions.scalars import taxonomy_token
        from ..operators.strata import taxonomy_histogram

        each = self.seen.groupBy("gene", "seq", "sample").agg(F.max("taxonomy").alias("taxonomy"))
        reps = each.groupBy("gene", "seq").agg(F.count("sample").alias("n_samples"), F.max("taxonomy").alias("taxonomy"))
        return taxonomy_histogram(reps.select("gene", "n_samples", taxonomy_token("taxonomy", "d__").alias("domain"), taxonomy_token("taxonomy", "p__").alias("phylum"))).withColumnRenamed("gene", "marker")
