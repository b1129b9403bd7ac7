"""Databases as files and as values."""

import sqlite3
from contextlib import closing

import pytest
from pyspark.sql import functions as F

from cladeflow.operators import distances
from cladeflow.sources import sqlite


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "meta package.db")
    with closing(sqlite3.connect(path)) as db:
        db.execute("CREATE TABLE otus (sequence TEXT, taxonomy_id INTEGER, marker_id INTEGER, weight REAL, raw BLOB, odd)")
        rows = [("ACGT"[i % 4] * 3 + "-", i % 5 + 1, i % 2, i / 4 if i % 3 else None, bytes([i % 256]), "x") for i in range(5000)]
        db.executemany("INSERT INTO otus VALUES (?, ?, ?, ?, ?, ?)", rows)
        db.execute("DELETE FROM otus WHERE rowid BETWEEN 1000 AND 2999")
        db.execute("CREATE TABLE taxonomy (id INTEGER PRIMARY KEY, taxonomy TEXT)")
        db.executemany("INSERT INTO taxonomy VALUES (?, ?)", [(i, f"Root; d__B; s__S{i}") for i in range(1, 6)])
        db.execute("CREATE TABLE markers (id INTEGER, marker VARCHAR(9), PRIMARY KEY (id)) WITHOUT ROWID")
        db.executemany("INSERT INTO markers VALUES (?, ?)", [(0, "S3.1"), (1, "S3.2")])
        db.execute("CREATE TABLE empty (a INTEGER)")
        db.execute("CREATE VIEW few AS SELECT sequence, weight FROM otus WHERE marker_id = 1")
        db.commit()
    return path


def test_ranges_and_columns(spark, database):
    whole = sqlite.read_table(spark, database, "otus", partitions=7)
    assert whole.rdd.getNumPartitions() == 7
    assert [(f.name, f.dataType.simpleString()) for f in whole.schema] == [("sequence", "string"), ("taxonomy_id", "bigint"), ("marker_id", "bigint"), ("weight", "double"), ("raw", "binary"), ("odd", "string")]
    with closing(sqlite3.connect(database)) as db:
        want = db.execute("SELECT sequence, taxonomy_id, marker_id, weight, raw, odd FROM otus").fetchall()
    assert sorted(map(str, (tuple(r[:4]) + (bytes(r[4]), r[5]) for r in whole.collect()))) == sorted(map(str, want))
    assert sqlite.read_table(spark, f"file://{database}", "otus").count() == sqlite.read_table(spark, f"file:{database}", "otus").count() == 3000
    some = sqlite.read_table(spark, database, "otus", ["weight", "taxonomy_id"], ("marker_id", 1), 3)
    assert some.columns == ["weight", "taxonomy_id"] and some.count() == 1500
    assert sqlite.read_table(spark, database, "taxonomy", equal=("taxonomy", "Root; d__B; s__S2")).collect() == [(2, "Root; d__B; s__S2")]


def test_tables_without_rows_or_rowids(spark, database):
    assert sqlite.read_table(spark, database, "empty").count() == 0
    assert sorted(map(tuple, sqlite.read_table(spark, database, "markers").collect())) == [(0, "S3.1"), (1, "S3.2")]
    assert sqlite.read_table(spark, database, "few").count() == 1500
    for table, columns in (("none", None), ("otus", ["nothing"])):
        with pytest.raises(ValueError):
            sqlite.read_table(spark, database, table, columns)
    with closing(sqlite.connect(database)) as db, pytest.raises(sqlite3.OperationalError):
        db.execute("DELETE FROM otus")


def test_join(spark, database):
    """The three tables joined, as the windows of each species."""
    otus = sqlite.read_table(spark, database, "otus", ["sequence", "taxonomy_id", "marker_id"])
    w = distances.reference_windows(otus, sqlite.read_table(spark, database, "taxonomy"), sqlite.read_table(spark, database, "markers"))
    got = {(r.marker, r.species): r.n for r in w.groupBy("marker", "species").agg(F.count("*").alias("n")).collect()}
    with closing(sqlite3.connect(database)) as db:
        want = db.execute("SELECT marker, substr(taxonomy, 13), count(*) FROM otus JOIN taxonomy t ON t.id = taxonomy_id JOIN markers m ON m.id = marker_id GROUP BY 1, 2").fetchall()
    assert got == {(m, s): n for m, s, n in want} and sum(got.values()) == 3000


def test_shards_as_values(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("a'\"é"), F.col("id"))).alias("a b"))
    made = sqlite.pack(df, "rows", 5)
    assert made.count() == 5
    back = sqlite.scan(made, 'SELECT id, "a b" AS name FROM rows WHERE id >= 10', "id bigint, name string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.where("id >= 10").collect()))
    with pytest.raises(Exception, match="readonly|query_only|attempt to write"):
        sqlite.scan(made, "DELETE FROM rows", "id bigint").collect()
    assert sqlite.scan(made, "SELECT id FROM rows WHERE id < 0", "id bigint").count() == 0
