"""Rows dealt into tasks of a bounded number, whatever the size of the table."""

import random

from pyspark.sql import functions as F

from cladeflow.operators import clusterstats, collate, strata
from cladeflow.operators.numbering import numbered
from cladeflow.plans.fixtures import Fixture
from cladeflow.sources import shared


def hits(spark, n=4000):
    pick = random.Random(5)
    rows = [("g", f"s{pick.randrange(900)}", "AAAA" if pick.random() < 0.7 else "".join(pick.choice("ACGT-") for _ in range(4)), pick.randrange(9), "t", "diamond") for _ in range(n)]
    return spark.createDataFrame(rows, "gene string, sample string, sequence string, num_hits int, taxonomy string, taxonomy_assignment_method string")


def most_rows(df):
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_frequent_keys_are_joined_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 1000)
    left = hits(spark).select("gene", "sample", "sequence")
    right = left.select("gene", "sequence").distinct().where("sequence < 'G'").selectExpr("gene", "sequence", "substr(sequence, 1, 1) AS rep")
    right = right.unionByName(right.where("sequence = 'AAAA'").selectExpr("gene", "sequence", "'other' AS rep"))
    got, want = shared.join_frequent(left, right, ["gene", "sequence"]), left.join(right, ["gene", "sequence"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_rows_of_rare_keys_are_dealt_whatever_the_number_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 200)
    left = spark.range(4000).selectExpr("'g' AS gene", "if(id < 1000, 'often', cast(id % 1000 AS string)) AS sequence", "id AS sample")
    left = shared.cut(left.repartition(4))  # else the gene is known to be one and no key
    right = left.select("gene", "sequence", F.col("sequence").alias("rep")).distinct()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for rows, often in ((left, 1000), (left.where("sequence <> 'often'"), 0)):
            got = shared.join_frequent(rows, right, ["gene", "sequence"])
            assert got.where("sequence = 'often'").count() == often and got.count() == 3000 + often
            assert most_rows(got.where("sequence <> 'often'")) < 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "TASK_ROWS", 200)
    h = hits(spark)
    members = h.selectExpr("gene", "translate(sequence, '-', 'N') AS sequence", "substr(sequence, 1, 1) AS rep").distinct()
    f = Fixture(spark, str(tmp_path))
    f.__dict__["otu"] = h
    for df in (collate.indexed(h, ordinal=("sequence", "taxonomy")), clusterstats.pairs_of(h, members), f.seen):
        assert most_rows(df) < 400
    found = clusterstats.rep_sample_counts(h, members.withColumnRenamed("sequence", "member")).collect()
    samples = {}
    reps = {}
    for m in members.collect():
        reps.setdefault(m.sequence, set()).add(m.rep)
    for x in h.collect():
        for rep in reps[x.sequence.replace("-", "N")]:
            samples.setdefault(rep, set()).add(x.sample)
    assert {(r.rep, r.n_samples) for r in found} == {(k, len(v)) for k, v in samples.items()}
    meta = spark.createDataFrame([(f"s{i}", str(2000 + i % 3), None) for i in range(900)], "acc string, year string, organism string")
    assert strata.tagged(h, members.withColumnRenamed("sequence", "member"), meta).count() == sum(map(len, samples.values()))


def test_windows_are_numbered_by_place_without_a_sort_of_all_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "TASK_ROWS", 200)
    f = Fixture(spark, str(tmp_path))
    f.__dict__["otu"] = hits(spark).withColumn("planted_rep", F.col("sequence"))
    placed = f.make_indexed()
    assert most_rows(placed) < 400
    f.__dict__["indexed"] = shared.cut(placed)
    for df in (f.indexed, f.indexed.where("sequence = 'AAAA'")):
        by_place, by_position = (df.orderBy(*by).select("gene", "sample", "otu_idx").collect() for by in (("gene", "sample", "otu_idx"), ("gene", "position")))
        assert by_place == by_position
    plans = []
    monkeypatch.setattr(collate, "numbered", lambda df, *rest: plans.append(df) or numbered(df, *rest))
    got = f.make_dedup()
    assert "SortAggregate" not in plans[0]._jdf.queryExecution().executedPlan().toString()
    want = collate.dedup(f.indexed, F.struct("sample", "otu_idx"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
