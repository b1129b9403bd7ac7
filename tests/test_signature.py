"""Golden cases of the codon signature and the error estimates."""

import pytest

from cladeflow.operators.clusterstats import single_read_summary
from cladeflow.operators.collate import counts_table
from cladeflow.operators.estimates import estimate
from cladeflow.operators.signature import build_pairs, combine, signature

REP = "ATG" + "GCT" * 19
PAIR = "rep string, member string, n_occurrences long, sum_hits long, rep_n_occurrences long"


def changed(i, codon):
    return REP[: 3 * i] + codon + REP[3 * i + 3 :]


def rows(spark, *members, counts=(1, 1, 50)):
    return spark.createDataFrame([(REP, m, *counts) for m in members], PAIR)


def test_effects(spark):
    (r,) = signature(rows(spark, changed(1, "GCC"), changed(2, "ACT"), changed(3, "GAT"))).collect()
    assert (r.f_class, r.single_read, r.parent_class, r.n_pairs) == ("f1", True, "p10-99", 3)
    assert (r.pos1, r.pos2, r.pos3, r.syn, r.nonsyn, r.stop, r.transitions) == (1, 1, 1, 1, 2, 0, 2)


def test_stop_gain(spark):
    rep = "ATG" + "TGG" * 19
    df = spark.createDataFrame([(rep, rep[:12] + "TGA" + rep[15:], 2, 3, 5)], PAIR)
    (r,) = signature(df).collect()
    assert (r.f_class, r.single_read, r.stop) == ("f2", False, 1)
    assert r.exp_stop == pytest.approx(2 / 9)


def test_ambiguous_and_multiple(spark):
    (r,) = signature(rows(spark, changed(1, "GCN"))).collect()
    assert (r.n_pairs_ambiguous, r.n_single_nt) == (1, 0)
    (r,) = signature(rows(spark, changed(1, "GGG"))).collect()
    assert (r.n_codons_multi_nt, r.n_single_nt) == (1, 0)


def test_combine_and_empty(spark):
    one = signature(rows(spark, changed(1, "GCC")))
    (r,) = combine(one.unionByName(one)).collect()
    assert (r.n_pairs, r.pos3) == (2, 2)
    assert signature(rows(spark).limit(0)).count() == 0


def test_build_pairs(spark):
    gapped, other = changed(1, "GC-"), changed(2, "GCA")
    counts = spark.createDataFrame([(REP, 50, 100), (gapped.replace("-", "N"), 1, 1), (other, 60, 100)], "sequence string, n_occurrences long, sum_hits long")
    clusters = spark.createDataFrame([(REP, REP), (gapped, REP), (other, REP)], "member string, rep string")
    (r,) = build_pairs(counts, clusters).collect()
    assert (r.member, r.rep_n_occurrences) == (gapped.replace("-", "N"), 50)


SIG = "scope string, marker string, f_class string, single_read boolean, parent_class string, n_pairs long, n_single_nt long, pos3 long, syn long, stop long, exp_syn double, exp_stop double"


def sig_row(scope, f, parent, n, pos3, syn, stop):
    return (scope, "m", f, f == "f1", parent, n, n, pos3, syn, stop, 300.0 * n / 1000, 30.0 * n / 1000)


def test_half_mixture(spark):
    df = spark.createDataFrame([sig_row("all", "f100+", "p1000+", 1000, 900, 900, 0), sig_row("all", "f1", "p<10", 1000, 617, 600, 15)], SIG)
    out = estimate(df).where("parent_class = 'all'").collect()
    assert {r.f_class for r in out} == {"f1"} and len(out) == 3
    assert all(round(r.error_fraction, 2) == 0.5 for r in out)


def test_pooled_reference_and_zero(spark):
    df = spark.createDataFrame([sig_row("all", "f100+", "p100-999", 500, 450, 450, 0), sig_row("all", "f100+", "p1000+", 500, 450, 450, 0), sig_row("all", "f1", "p<10", 1000, 617, 600, 15), sig_row("all", "f2", "p<10", 0, 0, 0, 0)], SIG)
    out = estimate(df).collect()
    assert {r.parent_class for r in out} == {"all", "p<10"} and {r.f_class for r in out} == {"f1"}


def test_other_scope_reference(spark):
    df = spark.createDataFrame([sig_row("all", "f100+", "p", 1000, 900, 900, 0), sig_row("human_gut", "f100+", "p", 1000, 700, 700, 0), sig_row("human_gut", "f1", "p<10", 1000, 517, 517, 0)], SIG)
    own = estimate(df).where("statistic = 'codon_position' AND parent_class = 'all' AND scope = 'human_gut'").first()
    other = estimate(df, "all").where("statistic = 'codon_position' AND parent_class = 'all' AND scope = 'human_gut'").first()
    assert (round(own.error_fraction, 3), round(other.error_fraction, 3), other.reference) == (0.499, 0.676, "all")


def test_counts_table(spark):
    df = spark.createDataFrame([("AAA", 1, 3), ("AAA", 1, 2), ("CCC", 4, 4)], "sequence string, n_occurrences long, sum_hits long")
    assert sorted(map(tuple, counts_table(df).collect())) == [("AAA", 2, 5), ("CCC", 4, 4)]
    assert counts_table(df.limit(0)).count() == 0


def test_single_read(spark):
    counts = spark.createDataFrame([("A", 1, 1), ("B", 1, 3), ("C", 1, 1), ("D", 1, 1)], "sequence string, n_occurrences long, sum_hits long")
    clusters = spark.createDataFrame([("A", "A"), ("B", "B"), ("C", "C"), ("D", "C"), ("E", "E")], "member string, rep string")
    assert tuple(single_read_summary(counts, clusters).first()) == (3, 1, 2)
    assert tuple(single_read_summary(counts.limit(0), clusters).first()) == (0, 0, 0)
