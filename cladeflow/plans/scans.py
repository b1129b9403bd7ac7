"""Queries over sources, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codons as C
from ..functions import scalars as S
from ..operators import clusterstats, collate, distances, report, richness, strata
from ..operators.strata import valid_year
from ..sources import archive, fasta, logs, publish, sqlite, tables
from .registry import query

HEADER = "concat('otu', otu_idx, '|', sample, '|', gene, '|unknown=', unknown, '|hits=', num_hits)"
DEDUP_HEADER = "concat('seq', seq_num, '|unknown=', unknown, '|hits=', hits, '|n_occurrences=', n_occurrences, '|sum_hits=', sum_hits)"


def entries(s):
    return s.indexed.select(F.expr(HEADER).alias("header"), "sequence")


def dedup_headers(s):
    return s.dedup.select(F.expr(DEDUP_HEADER).alias("header"), "sequence")


@query("SRC-01_archive_read", "SELECT sample, gene, sequence, CAST(num_hits AS VARCHAR) AS num_hits, taxonomy FROM otu_hits")
def _(s):
    # one archive a sample, as its JSON text
    fields = ("gene", "sample", "sequence", "num_hits", "taxonomy", "taxonomy_assignment_method")
    otu = F.array(*[F.col(f).cast("string") for f in fields])
    files = s.otu.groupBy("sample").agg(F.collect_list(otu).alias("otus")).select(
        F.col("sample").alias("source_file"), F.to_json(F.struct(F.lit(4).alias("version"), F.array(*map(F.lit, fields)).alias("fields"), "otus")).alias("value")
    )
    return archive.parse_archive(files).select("sample", "gene", "sequence", "num_hits", "taxonomy")


@query("SRC-02_fasta_scan", f"SELECT {HEADER} AS header, sequence FROM indexed")
def _(s):
    raw = entries(s).select(F.concat("header", F.lit("\n"), F.substring("sequence", 1, 30), F.lit("\r\n"), F.substring("sequence", 31, 90), F.lit("\n")).alias("value"))
    return fasta.parse_entries(raw)


@query("SRC-03_header_parse", "SELECT sequence, CAST(unknown AS BIGINT) AS unknown, CAST(hits AS BIGINT) AS hits, n_occurrences, sum_hits FROM dedup")
def _(s):
    return fasta.with_header(dedup_headers(s)).select("sequence", "unknown", "hits", "n_occurrences", "sum_hits")


@query("SRC-03_header_defaults", "SELECT sequence, CAST(1 AS BIGINT) AS n_occurrences, CAST(num_hits AS BIGINT) AS sum_hits FROM indexed")
def _(s):
    return fasta.with_header(entries(s)).select("sequence", "n_occurrences", "sum_hits")


@query("SRC-04_header_sample", "SELECT sample, count(*) AS n FROM indexed GROUP BY sample")
def _(s):
    return fasta.with_header(entries(s)).groupBy("sample").agg(F.count("*").alias("n"))


@query("SRC-05_representative_id", "SELECT concat('otu', otu_idx, '|', sample, '|', gene) AS id, count(*) AS n FROM indexed GROUP BY ALL")
def _(s):
    return entries(s).groupBy(fasta.representative_id().alias("id")).agg(F.count("*").alias("n"))


@query("SRC-06_headers_to_wide", "SELECT concat('seq', seq_num) AS id, CAST(unknown AS VARCHAR) AS unknown, CAST(hits AS VARCHAR) AS hits, CAST(n_occurrences AS VARCHAR) AS n_occurrences, CAST(sum_hits AS VARCHAR) AS sum_hits FROM dedup")
def _(s):
    return fasta.headers_to_wide(dedup_headers(s), ["unknown", "hits", "n_occurrences", "sum_hits"])


@query("SRC-07_scan_projection", "SELECT sequence, n_occurrences, sum_hits FROM counts")
def _(s):
    path = s.tsv("counts_tsv", s.counts)
    return tables.read_tsv(s.spark, path, f"gene string, {tables.COUNTS}", columns=["sequence", "n_occurrences", "sum_hits"])


@query("SRC-08_headerless_clusters", "SELECT member, rep FROM clusters")
def _(s):
    return tables.read_clusters(s.spark, s.tsv("clusters_tsv", s.clusters.select("member", "rep"), header=False))


@query("SRC-09_reference_join", "SELECT marker, species, count(*) AS n, count(DISTINCT sequence) AS n_distinct FROM ref_windows GROUP BY ALL")
def _(s):
    rows = s.otu.where("num_hits >= 48").select("sequence", F.xxhash64("taxonomy").alias("taxonomy_id"), F.xxhash64("gene").alias("marker_id"))
    tax = s.otu.select(F.xxhash64("taxonomy").alias("id"), "taxonomy").distinct()
    markers = s.otu.select(F.xxhash64("gene").alias("id"), F.col("gene").alias("marker")).distinct()
    w = distances.reference_windows(rows, tax, markers)
    return w.groupBy("marker", "species").agg(F.count("*").alias("n"), F.countDistinct("sequence").alias("n_distinct"))


@query("SRC-09_sqlite_scan", "SELECT marker, species, count(*) AS n, count(DISTINCT sequence) AS n_distinct FROM ref_windows GROUP BY ALL")
def _(s):
    # the three tables as databases in shards; each is read by a query in the tasks that hold its shards
    kept = s.otu.where("num_hits >= 48").select("sequence", F.xxhash64("taxonomy").alias("taxonomy_id"), F.xxhash64("gene").alias("marker_id"))
    made = {
        "otus": (kept, 16, "sequence string, taxonomy_id bigint, marker_id bigint"),
        "taxonomy": (s.otu.select(F.xxhash64("taxonomy").alias("id"), "taxonomy").distinct(), 2, "id bigint, taxonomy string"),
        "markers": (s.otu.select(F.xxhash64("gene").alias("id"), F.col("gene").alias("marker")).distinct(), 1, "id bigint, marker string"),
    }
    read = []
    for table, (rows, shards, schema) in made.items():
        path = s.written(f"sqlite_{table}", lambda to, rows=rows, table=table, shards=shards: sqlite.pack(rows, table, shards).write.mode("overwrite").parquet(to))
        columns = ", ".join(f.split()[0] for f in schema.split(", "))
        read.append(sqlite.scan(s.spark.read.parquet(path), f"SELECT {columns} FROM {table}", schema))
    w = distances.reference_windows(*read)
    return w.groupBy("marker", "species").agg(F.count("*").alias("n"), F.countDistinct("sequence").alias("n_distinct"))


META_SQL = "SELECT m.acc, a.collection_year AS year, m.taxon_name AS organism FROM (SELECT acc AS id, acc, organism AS taxon_name FROM sample_metadata) m LEFT JOIN (SELECT acc AS run_id, year AS collection_year FROM sample_metadata WHERE year IS NOT NULL) a ON a.run_id = m.id"


def exported(s):
    m = s.meta.select(F.col("acc").alias("id"), "acc", F.col("organism").alias("taxon_name"))
    return tables.export_metadata(m, s.meta.where("year IS NOT NULL").select(F.col("acc").alias("run_id"), F.col("year").alias("collection_year")))


@query("SRC-10_metadata_export", META_SQL)
def _(s):
    return exported(s)


@query("SRC-11_metadata_load", "SELECT acc, year, organism FROM (SELECT concat('SRR', CAST(o_orderkey % 5000 AS STRING)) AS acc, nullif(trim(CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE CAST(year(o_orderdate) AS STRING) END), '') AS year, nullif(o_orderpriority, '5-LOW') AS organism, row_number() OVER (PARTITION BY o_orderkey % 5000 ORDER BY o_orderkey DESC) AS p FROM orders) WHERE p = 1")
def _(s):
    rows = s.table("orders").select(
        F.expr("concat('SRR', CAST(o_orderkey % 5000 AS STRING))").alias("acc"), F.expr("CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE CAST(year(o_orderdate) AS STRING) END").alias("year"),
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("organism"), "o_orderkey",
    )
    return tables.load_metadata(rows, "o_orderkey")


def intermediate(s):
    return s.written("orders_zstd", lambda to: tables.write_intermediate(s.table("orders"), to, "o_orderkey"))


@query("SRC-12_parquet_slice", "SELECT o_orderkey // 1000 AS slice, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY ALL")
def _(s):
    # every slice of 1000 keys, in one scan
    rows = tables.read_slice(s.spark, intermediate(s), ["o_orderkey", "o_totalprice"], "o_orderkey")
    key, total = F.col("o_orderkey"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return rows.groupBy(F.expr("o_orderkey div 1000").alias("slice")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), total.alias("total"))


@query("SRC-12_parquet_whole", "SELECT o_orderkey, o_totalprice FROM orders")
def _(s):
    return tables.read_slice(s.spark, intermediate(s), ["o_orderkey", "o_totalprice"], "o_orderkey")


@query("SRC-14_json_summary", "SELECT gene, CAST(n_samples AS BIGINT) AS k, count(*) AS n FROM stats GROUP BY ALL")
def _(s):
    per = s.stats.groupBy("gene", "n_samples").agg(F.count("*").alias("n")).groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_samples").cast("string"), "n"))).alias("m"))
    back = per.select(F.to_json(F.struct("gene", "m")).alias("j")).select(F.from_json("j", "gene string, m map<string,bigint>").alias("r"))
    return back.select("r.gene", F.explode("r.m").alias("k", "n")).select("gene", F.col("k").cast("bigint").alias("k"), "n")


@query("SRC-15_archive_write", "SELECT gene, concat('seq', seq_num) AS id, sequence FROM dedup")
def _(s):
    every = s.dedup.select("gene", "seq_num", F.expr("concat('seq', seq_num)").alias("id"), "sequence")
    files = archive.write_archives(every, 500).select("value", F.lit("x").alias("source_file"))
    return archive.parse_archive(files).select("gene", F.get("read_names", F.lit(0)).alias("id"), "sequence")


@query("SRC-15_archive_batches", "SELECT concat(gene, '/', CAST(seq_num // 1000 AS VARCHAR)) AS source_file, gene, concat('seq', seq_num) AS id, sequence FROM dedup")
def _(s):
    every = s.dedup.select("gene", "seq_num", F.expr("concat('seq', seq_num)").alias("id"), "sequence")
    files = archive.write_archives(every, 1000).select(F.concat_ws("/", "gene", F.col("batch").cast("string")).alias("source_file"), "value")
    return archive.parse_archive(files).select("source_file", "gene", F.get("read_names", F.lit(0)).alias("id"), "sequence")


@query("SRC-16_renewed_archive", "SELECT sample AS id, regexp_extract(taxonomy, 'd__[A-Za-z]+') AS domain, regexp_extract(taxonomy, 'p__[A-Za-z0-9]+') AS phylum FROM otu_hits")
def _(s):
    return archive.representative_taxonomy(s.otu.withColumn("read_names", F.lit(None).cast("array<string>")))


@query("SRC-17_concatenate", "SELECT gene, 'a' AS part, n_samples FROM stats UNION ALL SELECT gene, 'b', n_samples FROM stats")
def _(s):
    parts = [s.tsv(f"stats_{p}_tsv", s.stats.select("gene", F.lit(p).alias("part"), "n_samples")) for p in "ab"]
    schema = "gene string, part string, n_samples bigint"
    whole = s.written("stats_tsv", lambda to: tables.concatenate(s.spark, parts, schema, to))
    return tables.read_tsv(s.spark, whole, schema)


@query("SRC-13_publish", "SELECT gene, sequence, n_occurrences FROM counts")
def _(s):
    # published twice: readers of the path find the second table from its publish on, and the first one still by its number
    path = f"{s.folder()}/published"
    numbers = [publish.publish(df.select("gene", "sequence", "n_occurrences"), path) for df in (s.counts.limit(0), s.counts)]
    if numbers[1] != numbers[0] + 1 or not publish.read_published(s.spark, path, numbers[0]).isEmpty():
        raise RuntimeError("a publish changed an earlier version")
    return publish.read_published(s.spark, path)


@query("ORC-02_resume", "SELECT gene, n_samples, 1 AS made FROM stats")
def _(s):
    # the stage is asked for twice and made at most once; other facts would make it anew
    made, path, facts = [], f"{s.folder()}/staged", {"max_divergence": 2, "tables": s.sf_dir}
    for _ in range(2):
        rows = publish.stage_table(lambda: made.append(1) or s.stats.select("gene", "n_samples"), s.spark, path, facts)
    if len(made) > 1 or not publish.is_current(s.spark, path, facts) or publish.is_current(s.spark, path, {**facts, "max_divergence": 3}):
        raise RuntimeError("the stage was made again or its manifest does not hold")
    return rows.select("gene", "n_samples", F.lit(1).alias("made"))


@query("ORC-03_manifest", "SELECT gene, count(*) AS n_clusters, CAST(sum(cluster_size) AS BIGINT) AS total, true AS fresh FROM stats GROUP BY gene")
def _(s):
    # what the table was made from is read back from its manifest, one row a marker
    path = f"{s.folder()}/with_manifest"
    per = s.stats.groupBy("gene").agg(F.count("*").alias("n_clusters"), F.sum("cluster_size").alias("total")).collect()  # a row a marker
    facts = {"schema": 1, "markers": {r.gene: [r.n_clusters, r.total] for r in per}}
    publish.stage_table(lambda: s.stats, s.spark, path, facts)
    kept = publish.current(s.spark, path).facts
    rows = [(g, *x, publish.is_current(s.spark, path, facts) and not publish.is_current(s.spark, path, {**facts, "schema": 2})) for g, x in kept["markers"].items()]
    return s.spark.createDataFrame(rows, "gene string, n_clusters bigint, total bigint, fresh boolean")


@query("ORC-07_merge_parts", "SELECT gene, sample_count, species_count FROM prev")
def _(s):
    # a histogram a marker is published on its own; the merge is refused while one of them is missing
    folder, genes = f"{s.folder()}/parts", [r.gene for r in s.stats.select("gene").distinct().orderBy("gene").collect()]  # markers are few
    paths = [f"{folder}/{g}" for g in genes]
    for g, p in zip(genes, paths):
        publish.publish(clusterstats.prevalence(s.stats.where(F.col("gene") == g)), p)
    try:
        publish.merge_parts(s.spark, [*paths, f"{folder}/missing"], f"{folder}/refused", strata.merge)
        raise RuntimeError("an incomplete merge was published")
    except publish.IncompleteMerge:
        pass
    publish.merge_parts(s.spark, paths, f"{folder}/merged", strata.merge)
    if not publish.merge_is_current(s.spark, paths, f"{folder}/merged") or publish.current(s.spark, f"{folder}/refused"):
        raise RuntimeError("the merge is not of its parts")
    return publish.read_published(s.spark, f"{folder}/merged").select("gene", "sample_count", "species_count")


@query("ORC-09_checks", "SELECT name, low, (kind = 'positive' AND low > 0) OR (kind = 'not_negative' AND low >= 0) AS accepted FROM (SELECT 'l_linenumber' AS name, 'positive' AS kind, CAST(min(l_linenumber) AS DOUBLE) + 0.0::DOUBLE AS low FROM lineitem UNION ALL SELECT 'l_discount', 'positive', CAST(min(l_discount) AS DOUBLE) + 0.0::DOUBLE FROM lineitem UNION ALL SELECT 'l_tax', 'not_negative', CAST(min(l_tax) AS DOUBLE) + 0.0::DOUBLE FROM lineitem UNION ALL SELECT 'c_acctbal', 'not_negative', CAST(min(c_acctbal) AS DOUBLE) + 0.0::DOUBLE FROM customer)")
def _(s):
    # the least value of a column as an argument: sizes must be positive, others not negative
    checks = {"l_linenumber": publish.check_positive, "l_discount": publish.check_positive, "l_tax": publish.check_not_negative, "c_acctbal": publish.check_not_negative}
    low = s.table("lineitem").agg(*[(F.min(c).cast("double") + 0.0).alias(c) for c in list(checks)[:3]]).first().asDict() | s.table("customer").agg((F.min("c_acctbal").cast("double") + 0.0).alias("c_acctbal")).first().asDict()

    def accepted(name: str) -> bool:
        try:
            checks[name](**{name: low[name]})
            return True
        except ValueError:
            return False

    return s.spark.createDataFrame([(c, low[c], accepted(c)) for c in checks], "name string, low double, accepted boolean")


@query("SRC-18_fasta_rows", "SELECT translate(sequence, '-', 'N') AS sequence, CAST(1 AS BIGINT) AS n_occurrences, CAST(num_hits AS BIGINT) AS sum_hits FROM indexed")
def _(s):
    return fasta.to_rows(entries(s))


@query("SRC-19_find_markers", "SELECT DISTINCT gene FROM otu_hits WHERE regexp_matches(gene, '^S[0-9]+[.]')")
def _(s):
    return tables.find_markers(s.otu, ["S3.2.synthetic_marker", "S3.1.synthetic_marker"])


PATHS = "concat('/data/', CAST(c_custkey AS STRING), '/SRR', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '.json.gz' WHEN c_custkey % 3 = 1 THEN '.json' ELSE '.gz' END)"


@query("SRC-20_sample_shard", f"SELECT concat('SRR', CAST(c_custkey AS STRING)) AS sample, substr(concat('SRR', CAST(c_custkey AS STRING)), 1, 5) AS shard FROM customer")
def _(s):
    p = s.table("customer").select(F.expr(PATHS).alias("path"))
    return p.select(S.sample_name("path").alias("sample"), tables.shard("path").alias("shard"))


@query("SRC-21_sample_list", f"SELECT regexp_extract(path, '([^/]+).json', 1) AS sample FROM (SELECT {PATHS} AS path FROM customer ORDER BY path LIMIT 100)")
def _(s):
    return tables.sample_list(s.table("customer").select(F.expr(PATHS).alias("path")))


LOG = "CAST(o_custkey AS STRING) AS file, o_orderkey AS n, concat(CASE WHEN o_orderkey % 2 = 0 THEN '2024/01/02 03:04:05 AM' ELSE '2024/01/02 03:05:15 PM' END, ' - ', CASE WHEN o_orderkey % 3 < 2 THEN 'Running QUERY' ELSE 'waiting' END) AS value"


@query("SRC-22_log_seconds", f"WITH l AS (SELECT {LOG} FROM orders), h AS (SELECT file, n, strptime(substr(value, 1, 22), '%Y/%m/%d %I:%M:%S %p') AS stamp FROM l WHERE lower(value) LIKE '%query%') SELECT file, CAST(date_diff('second', arg_min(stamp, n), arg_max(stamp, n)) AS BIGINT) AS seconds FROM h GROUP BY file HAVING count(*) >= 2")
def _(s):
    lines = s.table("orders").selectExpr("CAST(o_custkey AS STRING) AS file", "o_orderkey AS n", LOG.split(" AS n, ")[1])
    enough = lines.where("lower(value) LIKE '%query%'").groupBy("file").count().where("count > 1").select("file")
    return logs.query_seconds(lines.join(enough, "file", "left_semi"))


@query("SRC-23_root_count", "SELECT file, CAST((length(v) - length(replace(v, 'Root', ''))) / 4 AS BIGINT) AS size FROM (SELECT sample AS file, arg_min(repeat(concat(taxonomy, ' '), CAST(num_hits % 4 AS BIGINT)), concat(sequence, taxonomy, lpad(CAST(num_hits AS VARCHAR), 3, '0'))) AS v FROM otu_hits GROUP BY sample)")
def _(s):
    lines = s.otu.select(F.col("sample").alias("file"), F.expr("concat(sequence, taxonomy, lpad(CAST(num_hits AS STRING), 3, '0'))").alias("n"), F.expr("repeat(concat(taxonomy, ' '), num_hits % 4)").alias("value"))
    return logs.count_in_first_line(lines)


@query("SRC-26_histogram_io", "SELECT stratum, stratum_value, CAST(sample_count AS BIGINT) AS sample_count, species_count FROM histo")
def _(s):
    return tables.write_histogram(tables.read_histogram(s.histo.withColumnRenamed("species_count", "cluster_count")))


# ---- filters ----

MARKER_DOMAINS = "SELECT * FROM (VALUES ('S3.1.synthetic_marker', ['Bacteria', 'Archaea']), ('S3.2.synthetic_marker', ['Bacteria'])) AS t(gene, domains)"


def marker_domains(s):
    return s.spark.createDataFrame([("S3.1.synthetic_marker", ["Bacteria", "Archaea"]), ("S3.2.synthetic_marker", ["Bacteria"])], "gene string, domains array<string>")


DOMAIN = "CASE WHEN contains(taxonomy, 'd__Bacteria') THEN 'Bacteria' WHEN contains(taxonomy, 'd__Archaea') THEN 'Archaea' WHEN contains(taxonomy, 'd__Eukaryota') THEN 'Eukaryota' END"


@query("FIL-01_on_target", f"SELECT gene, count(*) AS n, CAST(sum(num_hits) AS BIGINT) AS hits FROM otu_hits JOIN ({MARKER_DOMAINS}) USING (gene) WHERE {DOMAIN} IS NULL OR list_contains(domains, {DOMAIN}) GROUP BY gene")
def _(s):
    return collate.on_target(s.otu, marker_domains(s)).groupBy("gene").agg(F.count("*").alias("n"), F.sum("num_hits").alias("hits"))


@query("FIL-02_domain", f"SELECT {DOMAIN} AS domain, count(*) AS n FROM otu_hits GROUP BY ALL")
def _(s):
    return s.otu.groupBy(S.domain_of("taxonomy").alias("domain")).agg(F.count("*").alias("n"))


@query("FIL-03_universal_markers", f"SELECT concat(gene, '/', regexp_extract(taxonomy, 'p__[A-Za-z0-9]+')) AS gene FROM otu_hits GROUP BY 1 HAVING list_has_all(list(DISTINCT {DOMAIN}), ['Bacteria', 'Archaea'])")
def _(s):
    # each marker of each phylum, with the domains of its windows
    seen = s.otu.select(F.concat_ws("/", "gene", S.taxonomy_token("taxonomy", "p__")).alias("gene"), S.domain_of("taxonomy").alias("domain")).distinct()
    return collate.universal_markers(seen.groupBy("gene").agg(F.collect_set("domain").alias("domains")))


@query("FIL-04_drop_empty", "SELECT sample, gene, otu_idx, sequence FROM (SELECT sample, gene, CASE WHEN num_hits % 7 = 0 THEN '-' ELSE sequence END AS sequence, row_number() OVER (PARTITION BY sample, gene ORDER BY CASE WHEN taxonomy_assignment_method = 'singlem_query_based' THEN 0 ELSE 1 END, num_hits DESC, CASE WHEN num_hits % 7 = 0 THEN '-' ELSE sequence END, taxonomy) - 1 AS otu_idx FROM otu_hits) WHERE sequence <> '-'")
def _(s):
    gaps = s.otu.withColumn("sequence", F.when(F.col("num_hits") % 7 == 0, "-").otherwise(F.col("sequence")))
    return collate.indexed(gaps, ordinal=("sequence", "taxonomy")).select("sample", "gene", F.col("otu_idx").cast("bigint"), "sequence")


@query("FIL-05_known_rank", "SELECT unknown, count(*) AS n FROM indexed GROUP BY unknown")
def _(s):
    return s.otu.groupBy(collate.known_rank().alias("unknown")).agg(F.count("*").alias("n"))


@query("FIL-06_safe_hits", "SELECT CAST(coalesce(TRY_CAST(CASE WHEN num_hits % 5 = 0 THEN 'many' ELSE CAST(num_hits AS VARCHAR) END AS INT), 0) AS INT) AS hits, count(*) AS n FROM otu_hits GROUP BY ALL")
def _(s):
    odd = F.when(F.col("num_hits") % 5 == 0, "many").otherwise(F.col("num_hits").cast("string"))
    return s.otu.groupBy(S.safe_int(odd).alias("hits")).agg(F.count("*").alias("n"))


@query("FIL-07_human_samples", "SELECT acc FROM sample_metadata WHERE organism = 'human gut metagenome'")
def _(s):
    return s.meta.where("organism = 'human gut metagenome'").select("acc")


@query("FIL-08_length", "SELECT count(*) AS n FROM pairs WHERE length(rep) = 60 AND length(member) = 60")
def _(s):
    return s.pairs.where((F.length("rep") == 60) & (F.length("member") == 60)).agg(F.count("*").alias("n"))


@query("FIL-09_ambiguous", "SELECT gene, ambiguous, count(*) AS n FROM classed GROUP BY ALL")
def _(s):
    return s.pairs.groupBy("gene", (F.col("rep").rlike("[^ACGT]") | F.col("member").rlike("[^ACGT]")).alias("ambiguous")).agg(F.count("*").alias("n"))


def codon_rows(s):
    codon = lambda c, i: F.substring(F.col(c), i * 3 + 1, F.lit(3))
    split = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct(i.alias("i"), codon("rep", i).alias("rc"), codon("member", i).alias("mc")))
    good = F.filter(split, lambda x: (x["rc"] != x["mc"]) & x["rc"].rlike("^[ACGT]{3}$") & x["mc"].rlike("^[ACGT]{3}$"))
    return s.pairs.select("gene", F.explode(good).alias("c")).select("gene", "c.*")


@query("FIL-10_codons", "SELECT gene, count(*) AS n FROM codons GROUP BY gene")
def _(s):
    return codon_rows(s).groupBy("gene").agg(F.count("*").alias("n"))


@query("FIL-11_less_abundant", "SELECT gene, rep, member, n_occurrences, rep_n_occurrences FROM pairs")
def _(s):
    return s.pairs.select("gene", "rep", "member", "n_occurrences", "rep_n_occurrences")


@query("FIL-12_f_class", "SELECT f_class, count(*) AS n FROM classed GROUP BY ALL")
def _(s):
    return s.pairs.groupBy(S.f_class("n_occurrences").alias("f_class")).agg(F.count("*").alias("n"))


@query("FIL-13_parent_class", "SELECT parent_class, count(*) AS n FROM classed GROUP BY ALL")
def _(s):
    return s.pairs.groupBy(S.parent_class("rep_n_occurrences").alias("parent_class")).agg(F.count("*").alias("n"))


@query("FIL-14_single_read", "SELECT gene, count(*) FILTER (WHERE sum_hits = n_occurrences) AS n FROM counts GROUP BY gene")
def _(s):
    return s.counts.groupBy("gene").agg(F.count_if(F.col("sum_hits") == F.col("n_occurrences")).alias("n"))


@query("FIL-15_valid_year", "SELECT CAST(year AS INT) AS y, count(*) AS n FROM sample_metadata WHERE regexp_full_match(year, '[0-9]+') GROUP BY ALL")
def _(s):
    return s.meta.select(valid_year().alias("y")).where("y IS NOT NULL").groupBy("y").agg(F.count("*").alias("n"))


@query("FIL-16_marker_number", "SELECT marker FROM (SELECT concat('S3.', CAST(p_size AS STRING), '.m', CAST(p_partkey AS STRING)) AS marker, p_size FROM part) WHERE p_size <= 13")
def _(s):
    return distances.numbered_markers(s.table("part").select(F.expr("concat('S3.', CAST(p_size AS STRING), '.m', CAST(p_partkey AS STRING))").alias("marker")))


@query("FIL-17_taxonomy_token", "SELECT regexp_extract(taxonomy, 'p__[A-Za-z0-9]+') AS phylum, count(*) AS n FROM otu_hits GROUP BY ALL")
def _(s):
    return s.otu.groupBy(S.taxonomy_token("taxonomy", "p__").alias("phylum")).agg(F.count("*").alias("n"))


@query("FIL-18_species", "SELECT trim(split_part(taxonomy, ';', -1)) AS species, count(*) AS n FROM otu_hits GROUP BY ALL")
def _(s):
    return s.otu.groupBy(S.species_of("taxonomy").alias("species")).agg(F.count("*").alias("n"))


@query("FIL-19_cluster_type", "SELECT gene, cluster_type, count(*) AS n FROM type_rows GROUP BY ALL")
def _(s):
    return s.type_rows.groupBy("gene", "cluster_type").agg(F.count("*").alias("n"))


@query("FIL-20_positive_rows", "SELECT stratum, count(*) AS n FROM histo WHERE sample_count > 0 AND species_count > 0 GROUP BY ALL")
def _(s):
    return s.histo.where("sample_count > 0 AND species_count > 0").groupBy("stratum").agg(F.count("*").alias("n"))


@query("FIL-21_cohort", "SELECT CASE WHEN stratum IN ('all', 'year') THEN 'all' ELSE 'human-gut' END AS cohort, CAST(sum(species_count) AS BIGINT) AS n FROM histo GROUP BY ALL")
def _(s):
    return s.histo.groupBy(report.cohort("stratum").alias("cohort")).agg(F.sum("species_count").alias("n"))


@query("FIL-22_model_filter", "SELECT p_partkey FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Kemp' WHEN 1 THEN 'Poisson' END AS model FROM part) WHERE model IS NULL OR model <> 'Kemp'")
def _(s):
    m = s.table("part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "Kemp").when(F.col("p_partkey") % 3 == 1, "Poisson").alias("model"))
    return richness.without_model(m, "Kemp").select("p_partkey")


LABELS = "concat('S3.', CAST(p_size AS STRING), '.', CASE p_partkey % 3 WHEN 0 THEN 'ribosomal_protein_L2' WHEN 1 THEN 'ribosomal_S5_ribosomal_protein' ELSE 'rpoB' END)"


@query("FIL-23_marker_label", f"SELECT marker, CASE WHEN marker LIKE '%ribosomal_protein_L2' THEN 'RP_L2' WHEN marker LIKE '%ribosomal_S5%' THEN 'R_S5_RP' ELSE 'rpoB' END AS label, CAST(split_part(marker, '.', 2) AS INT) AS number FROM (SELECT DISTINCT {LABELS} AS marker FROM part)")
def _(s):
    m = s.table("part").select(F.expr(LABELS).alias("marker")).distinct()
    return m.select("marker", report.marker_label().alias("label"), report.marker_number().alias("number"))


@query("FIL-24_hash_sample", "SELECT gene, count(*) AS n FROM pairs WHERE substr(md5(concat('1|', member)), 1, 8) < '40000000' GROUP BY gene")
def _(s):
    from ..operators.signature import build_pairs

    return build_pairs(s.counts, s.clusters, ("gene",), fraction=0.25, seed=1).groupBy("gene").agg(F.count("*").alias("n"))


@query("FIL-25_labels", "SELECT scope, marker, sample_fraction, count(*) AS n FROM sig_all GROUP BY ALL")
def _(s):
    return s.sig_all.groupBy("scope", "marker", "sample_fraction").agg(F.count("*").alias("n"))


# ---- scalar functions ----


@query("FN-01_normalise_gaps", "SELECT seq, count(*) AS n FROM otu WHERE sequence <> seq GROUP BY seq")
def _(s):
    return s.seqs.where("sequence <> seq").groupBy("seq").agg(F.count("*").alias("n"))


@query("FN-02_taxonomy_token", "SELECT nullif(regexp_extract(taxonomy, 'd__[A-Za-z]+'), '') AS d, nullif(regexp_extract(taxonomy, 'g__[A-Za-z]+'), '') AS g, count(*) AS n FROM otu_hits GROUP BY ALL")
def _(s):
    return s.otu.groupBy(S.taxonomy_token("taxonomy", "d__").alias("d"), S.taxonomy_token("taxonomy", "g__").alias("g")).agg(F.count("*").alias("n"))


@query("FN-03_species_of", "SELECT DISTINCT trim(split_part(taxonomy, ';', -1)) AS species FROM otu_hits")
def _(s):
    return s.otu.select(S.species_of("taxonomy").alias("species")).distinct()


@query("FN-04_header_map", "SELECT CAST(hits AS VARCHAR) AS hits, count(*) AS n FROM dedup GROUP BY ALL")
def _(s):
    return dedup_headers(s).groupBy(S.header_map("header")["hits"].alias("hits")).agg(F.count("*").alias("n"))


@query("FN-05_translate_codon", "SELECT gene, codon, aa, count(*) AS n FROM (SELECT gene, substr(sequence, CAST(3 * i + 1 AS INT), 3) AS codon FROM counts, range(20) t(i) WHERE length(sequence) = 60) LEFT JOIN code USING (codon) GROUP BY ALL")
def _(s):
    # every codon of every window; one with an unknown base has no amino acid
    codons = F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.substring("sequence", 3 * i + 1, F.lit(3)))).alias("codon")
    rows = s.counts.where(F.length("sequence") == 60).select("gene", codons)
    return rows.groupBy("gene", "codon").agg(F.count("*").alias("n")).select("gene", "codon", C.translate_codon("codon").alias("aa"), "n")


@query("FN-06_diff_position", "SELECT DISTINCT rc, mc, CASE WHEN substr(rc, 1, 1) <> substr(mc, 1, 1) THEN 1 WHEN substr(rc, 2, 1) <> substr(mc, 2, 1) THEN 2 ELSE 3 END AS pos FROM codons")
def _(s):
    return codon_rows(s).select("rc", "mc", C.diff_position("rc", "mc").alias("pos")).distinct()


@query("FN-07_effect", "SELECT DISTINCT rc, mc, CASE WHEN r.aa = m.aa THEN 'syn' WHEN m.aa = '*' THEN 'stop' ELSE 'nonsyn' END AS effect FROM codons JOIN code r ON r.codon = rc JOIN code m ON m.codon = mc")
def _(s):
    return codon_rows(s).select("rc", "mc", C.effect(C.translate_codon("rc"), C.translate_codon("mc")).alias("effect")).distinct()


@query("FN-08_is_transition", "SELECT DISTINCT rc, mc, substr(rc, pos, 1) || substr(mc, pos, 1) IN ('AG', 'GA', 'CT', 'TC') AS transition FROM (SELECT rc, mc, CASE WHEN substr(rc, 1, 1) <> substr(mc, 1, 1) THEN 1 WHEN substr(rc, 2, 1) <> substr(mc, 2, 1) THEN 2 ELSE 3 END AS pos FROM codons)")
def _(s):
    return codon_rows(s).select("rc", "mc", C.is_transition("rc", "mc").alias("transition")).distinct()


@query("FN-09_lchoose", "SELECT n, k, round(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1), 6) AS v FROM (SELECT CAST(p_partkey + 20 AS BIGINT) AS n, CAST(p_size AS BIGINT) % 20 + 1 AS k FROM part)")
def _(s):
    rows = s.table("part").select((F.col("p_partkey") + 20).cast("bigint").alias("n"), (F.col("p_size").cast("bigint") % 20 + 1).alias("k"))
    return rows.select("n", "k", F.round(S.lchoose("n", "k"), 6).alias("v"))


@query("FN-10_hamming", "SELECT gene, member, rep, CAST(hamming(member, rep) AS INT) AS d, CAST(hamming(member, rep) AS INT) AS packed FROM clusters")
def _(s):
    packed = S.packed_hamming(S.packed_bases("member"), S.packed_bases("rep"))
    return s.clusters.select("gene", "member", "rep", S.hamming("member", "rep").alias("d"), packed.cast("int").alias("packed"))


@query("FN-11_classes", "SELECT f_class, parent_class, count(*) AS n FROM classed GROUP BY ALL")
def _(s):
    return s.pairs.groupBy(S.f_class("n_occurrences").alias("f_class"), S.parent_class("rep_n_occurrences").alias("parent_class")).agg(F.count("*").alias("n"))


@query("FN-12_clamp01", "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN least(greatest((p_size - 10) / 20.0::DOUBLE, 0), 1) END AS v FROM part")
def _(s):
    x = F.when(F.col("p_partkey") % 7 != 0, (F.col("p_size") - 10) / F.lit(20.0))
    return s.table("part").select("p_partkey", S.clamp01(x).alias("v"))


@query("FN-13_n_diff", "SELECT DISTINCT rc, mc, CAST(hamming(rc, mc) AS INT) AS n FROM codons")
def _(s):
    return codon_rows(s).select("rc", "mc", C.n_diff("rc", "mc").alias("n")).distinct()


@query("FN-14_domain_of", f"SELECT DISTINCT taxonomy, {DOMAIN} AS domain FROM otu_hits")
def _(s):
    return s.otu.select("taxonomy", S.domain_of("taxonomy").alias("domain")).distinct()


@query("FN-15_sample_name", f"SELECT c_custkey, concat('SRR', CAST(c_custkey AS STRING)) AS sample FROM customer")
def _(s):
    return s.table("customer").select("c_custkey", S.sample_name(F.expr(PATHS)).alias("sample"))
