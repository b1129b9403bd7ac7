"""Readers, writers and manifests."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from cladeflow.functions.scalars import lchoose
from cladeflow.operators import collate
from cladeflow.operators.richness import rarefaction
from cladeflow.sources import archive, fasta, publish, tables


def test_archive(spark, tmp_path):
    otus = [["g", "s", "ACGT", 3, 1.5, "Root; d__Bacteria", ["r1"], [4], False, None, None, "diamond"], ["g", "s", "-", "x", 1.0, "Root", ["r2"], [4], False, None, None, None]]
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump({"version": 4, "fields": list(archive.FIELDS), "otus": otus}, f)
    rows = archive.read_archive(spark, str(tmp_path / "a.json.gz")).orderBy("ordinal").collect()
    assert [(r.gene, r.num_hits, r.read_names, r.source_file.endswith("a.json.gz")) for r in rows] == [("g", "3", ["r1"], True), ("g", "x", ["r2"], True)]
    kept = collate.indexed(archive.read_archive(spark, str(tmp_path / "a.json.gz"))).collect()
    assert [(r.sequence, r.hits, r.otu_idx, r.unknown) for r in kept] == [("ACGT", 3, 0, 1)]


def test_archives_hold_every_row(spark):
    rows = [(g, i, f"seq{i}", "ACGT"[i % 4] * 3) for g in ("a", "b") for i in range(11)]
    written = archive.write_archives(spark.createDataFrame(rows, "gene string, seq_num long, id string, sequence string"), 4)
    files = written.select(F.concat_ws("/", "gene", "batch").alias("source_file"), "value")
    back = sorted((r.source_file, r.ordinal, r.gene, r.read_names[0], r.sequence) for r in archive.parse_archive(files).collect())
    assert back == sorted((f"{g}/{i // 4}", i % 4, g, n, x) for g, i, n, x in rows)
    with pytest.raises(ValueError):
        archive.write_archives(written, 0)


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">otu0|s1|g|unknown=0|hits=5\nAC\nGT\n>otu1|s1|g|unknown=1|hits=2\n\n>otu2|s2|g|unknown=1|hits=2|n_occurrences=4|sum_hits=9\nTT-\n")
    rows = fasta.with_header(fasta.read_fasta(spark, str(tmp_path / "x.fa"))).orderBy("header").collect()
    assert [(r.sequence, r.sample, r.unknown, r.hits, r.n_occurrences, r.sum_hits) for r in rows] == [("ACGT", "s1", 0, 5, 1, 5), ("TT-", "s2", 1, 2, 4, 9)]
    with pytest.raises(Exception, match="no hits"):
        fasta.with_header(spark.createDataFrame([("a|b|unknown=1", "A")], "header string, sequence string")).collect()


def test_metadata_last_row_counts(spark):
    df = spark.createDataFrame([("A", "2001", "x", 1), ("A", " ", "y", 2), ("B", "", None, 3)], "acc string, year string, organism string, n int")
    assert {r.acc: (r.year, r.organism) for r in tables.load_metadata(df, "n").collect()} == {"A": (None, "y"), "B": (None, None)}
    with pytest.raises(ValueError):
        tables.load_metadata(df.drop("year"), "n")


def test_missing_marker(spark):
    df = spark.createDataFrame([("S3.1.x",), ("other",)], "gene string")
    assert [r.gene for r in tables.find_markers(df).collect()] == ["S3.1.x"]
    with pytest.raises(ValueError):
        tables.find_markers(df, ["S3.9.y"])


def test_arguments():
    with pytest.raises(ValueError):
        publish.check_positive(size=0)
    with pytest.raises(ValueError):
        publish.check_not_negative(d=-1)


def test_on_target(spark):
    markers = spark.createDataFrame([("a", ["Bacteria"]), ("b", [])], "gene string, domains array<string>")
    rows = [("a", "Root; d__Bacteria"), ("a", "Root; d__Archaea"), ("a", None), ("b", "Root; d__Archaea"), ("c", "Root; d__Archaea")]
    got = collate.on_target(spark.createDataFrame(rows, "gene string, taxonomy string"), markers)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[4]], key=str)


def test_rarefaction_ends_at_observed(spark):
    h = spark.createDataFrame([("m", "all", k, 10 * k) for k in (1, 2, 5)], "marker string, cohort string, sample_count long, species_count long")
    c = spark.createDataFrame([("all", 30)], "cohort string, n_samples long")
    out = {round(r.fraction, 1): r.species for r in rarefaction(h, c).collect()}
    assert out[1.0] == pytest.approx(80) and all(out[i / 10] < out[(i + 1) / 10] for i in range(1, 10))
    n = spark.createDataFrame([(752944, 3)], "n long, k long").select(lchoose("n", "k")).first()[0]
    assert n == pytest.approx(math.log(math.comb(752944, 3)), abs=1e-5)


def test_files_of_one_schema(spark, tmp_path):
    for name, n in (("a", 3), ("b", 4)):
        spark.range(n).selectExpr("CAST(id AS STRING) AS member", f"'{name}' AS rep").write.csv(str(tmp_path / name), sep="\t", header=True)
    tables.concatenate(spark, [str(tmp_path / x) for x in "ab"], tables.CLUSTERS, str(tmp_path / "c"))
    assert tables.read_tsv(spark, str(tmp_path / "c"), tables.CLUSTERS, columns=["rep"]).groupBy("rep").count().count() == 2
    with pytest.raises(Exception, match="not exist|PATH_NOT_FOUND"):
        tables.concatenate(spark, [str(tmp_path / "missing")], tables.CLUSTERS, str(tmp_path / "d"))
    tables.write_intermediate(spark.range(100).withColumn("x", F.col("id") * 2), str(tmp_path / "p"), "id")
    part = tables.read_slice(spark, str(tmp_path / "p"), ["x"], "id", 10, 12)
    assert sorted(r.x for r in part.collect()) == [20, 22, 24]
    assert tables.read_slice(spark, str(tmp_path / "p"), ["x"], "id").count() == 100
