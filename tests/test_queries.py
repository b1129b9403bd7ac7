"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = (
    "AGG-02_dedup", "AGG-04_cluster_stats", "AGG-05_single_read", "AGG-09_cumulative_years", "AGG-18_match_summary", "DOM-02_signature", "DOM-06_rarefaction", "DOM-07_poisson_richness",
    "FIL-17_taxonomy_token", "FN-10_hamming", "JOIN-16_cumulative", "JOIN-22_nearest_reference", "CLU-02_banded_pairs", "RSH-05_complete", "SRC-06_headers_to_wide", "SRC-22_log_seconds", "WIN-04_otu_index",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows(df):
    return sorted(tuple("null" if pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ("SRC-12_parquet_whole", "SRC-15_archive_batches"))
def test_whole_source_query(spark, name):
    test_query(spark, name)


@pytest.mark.parametrize("name", ("SRC-07_scan_projection", "SRC-08_headerless_clusters", "SRC-13_publish", "SRC-17_concatenate", "SRC-24_benchmarks", "RSH-07_file_rows", "ORC-02_resume", "WIN-08_pair_ids", "SRT-02_external_sort", "SRT-09_seeded_sample", "FIL-24_hash_sample"))
def test_query_over_files_and_numbers(spark, name):
    test_query(spark, name)


@pytest.mark.parametrize("name", (
    "AGG-03_merged_shards", "AGG-08_from_sets", "AGG-11_overlapping_parts", "AGG-31_summary", "AGG-32_model_counts", "AGG-32_selected_models", "CLU-01_greedy_clusters", "CLU-02_bucket_sizes", "CLU-03_chunked_clusters",
    "CLU-05_reference_clusters", "CLU-07_assigned", "CLU-07_taxonomy_histogram", "CLU-07_within_8", "DOM-01_expected_table", "DOM-07_models", "DOM-07_richness_table", "DOM-07_selected_models", "DOM-08_richness_by_taxon",
    "DOM-09_corrected_fits", "FIL-03_universal_markers", "FN-05_translate_codon", "JOIN-23_uncorrected_check", "ORC-03_manifest", "ORC-07_merge_parts", "RSH-07_nested_files", "SET-06_united", "SRC-09_sqlite_scan",
))
def test_query_of_fits_clusters_and_sets(spark, name):
    test_query(spark, name)


@pytest.mark.parametrize("name,most", (("DOM-02_signature", 1), ("DOM-04_error_estimates", 2), ("AGG-09_cumulative_years", 2), ("AGG-04_cluster_stats", 3), ("AGG-02_dedup", 1)))
def test_scans(spark, name, most):
    """Operators read the tables they start from once each, not the source again for each use."""
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= most, plan
    assert "lineitem" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not any(math.isnan(len(k)) for k in entry.queries())
