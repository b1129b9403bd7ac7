"""Codon-level signature of mismatches between cluster members and their representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codons import CODE, diff_position, effect, expected_rows, is_transition, n_diff
from ..functions.scalars import f_class, normalise_gaps, parent_class

WINDOW = 60
STRATA = ("f_class", "single_read", "parent_class")
COUNTS = (
    "n_pairs", "n_pairs_ambiguous", "n_single_nt", "pos1", "pos2", "pos3", "syn", "nonsyn", "stop", "exp_syn", "exp_nonsyn", "exp_stop", "transitions", "n_codons_multi_nt",
)


def build_pairs(counts: DataFrame, clusters: DataFrame, keys: tuple[str, ...] = (), fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """DOM-03, JOIN-01, JOIN-02, FIL-11, FIL-24: members less abundant than their representative, gaps as N, and a hash sample of them."""
    c = clusters.select(*keys, normalise_gaps("member").alias("member"), F.col("rep")).where("rep <> member")
    if fraction < 1:
        # the first 32 bits of a hash that SQL engines share
        c = c.where(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "member")), 1, 8) < f"{int(fraction * 2**32):08x}")
    of_member = counts.select(*keys, F.col("sequence").alias("member"), "n_occurrences", "sum_hits")
    of_rep = counts.select(*keys, F.col("sequence").alias("rep"), F.col("n_occurrences").alias("rep_n_occurrences"))
    joined = c.join(of_member, [*keys, "member"]).join(of_rep, [*keys, "rep"])
    return joined.where("n_occurrences < rep_n_occurrences").select(*keys, "rep", "member", "n_occurrences", "sum_hits", "rep_n_occurrences")


def signature(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """DOM-02: one row a stratum: pairs, single substitutions by place and effect, what chance would give, transitions.

    One scan: differing codons of a pair are an array, turned into counts in the row; a single aggregation
    follows, and no pair is spread over rows.
    """
    both = (F.length("rep") == WINDOW) & (F.length("member") == WINDOW)
    rows = pairs.where(both).select(
        *keys, f_class("n_occurrences").alias("f_class"), (F.col("sum_hits") == F.col("n_occurrences")).alias("single_read"), parent_class("rep_n_occurrences").alias("parent_class"),
        (F.col("rep").rlike("[^ACGT]") | F.col("member").rlike("[^ACGT]")).alias("ambiguous"), "rep", "member",
    )
    codon = lambda c, i: F.substring(F.col(c), i * 3 + 1, F.lit(3))
    split = F.transform(F.sequence(F.lit(0), F.lit(WINDOW // 3 - 1)), lambda i: F.struct(codon("rep", i).alias("r"), codon("member", i).alias("m")))
    plain = "^[ACGT]{3}$"
    changed = F.filter(split, lambda x: (x["r"] != x["m"]) & x["r"].rlike(plain) & x["m"].rlike(plain))
    # pairs are counted before their codons are spread; most have one or two
    rows = rows.withColumn("c", F.explode_outer(F.concat(F.array(F.lit(None).cast("struct<r:string,m:string>")), changed)))
    # what a codon change does is looked up once, by joins to the 64 codons
    spark = pairs.sparkSession
    code = spark.createDataFrame(list(CODE.items()), "codon string, aa string")
    ninths = spark.createDataFrame(expected_rows(), "r string, syn9 int, nonsyn9 int, stop9 int")
    of_rep = F.broadcast(code.select(F.col("codon").alias("r"), F.col("aa").alias("r_aa")).join(ninths, "r", "left"))
    of_member = F.broadcast(code.select(F.col("codon").alias("m"), F.col("aa").alias("m_aa")))
    rows = rows.select(*keys, *STRATA, "ambiguous", F.col("c").isNull().alias("head"), F.col("c.r").alias("r"), F.col("c.m").alias("m"))
    rows = rows.join(of_rep, "r", "left").join(of_member, "m", "left")
    rows = rows.withColumn("diff", n_diff("r", "m")).withColumn("pos", diff_position("r", "m")).withColumn("what", effect("r_aa", "m_aa"))
    rows = rows.withColumn("one", F.coalesce(~F.col("head") & (F.col("diff") == 1) & (F.col("r_aa") != "*"), F.lit(False)))
    one, head, pos, what = (F.col(c) for c in ("one", "head", "pos", "what"))
    expected = [(F.sum(F.when(one, F.col(f"{e}9")).otherwise(0)) / 9.0).alias(f"exp_{e}") for e in ("syn", "nonsyn", "stop")]
    return rows.groupBy(*keys, *STRATA).agg(
        F.count_if(head).alias("n_pairs"), F.count_if(head & F.col("ambiguous")).alias("n_pairs_ambiguous"), F.count_if(one).alias("n_single_nt"),
        *[F.count_if(one & (pos == p)).alias(f"pos{p}") for p in (1, 2, 3)],
        *[F.count_if(one & (what == e)).alias(e) for e in ("syn", "nonsyn", "stop")],
        *expected,
        F.count_if(one & is_transition("r", "m")).alias("transitions"), F.count_if(~head & (F.col("diff") > 1)).alias("n_codons_multi_nt"),
    ).select(*keys, *STRATA, *COUNTS)


def combine(parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG-15: counts of parts, added up."""
    sums = [F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in COUNTS if c in parts.columns]
    return parts.groupBy(*keys, *STRATA).agg(*sums)


def labelled(df: DataFrame, scope: str, marker: str | None = None, fraction: float = 1.0) -> DataFrame:
    """FIL-25"""
    out = df.withColumn("scope", F.lit(scope)).withColumn("sample_fraction", F.lit(fraction))
    return out.withColumn("marker", F.lit(marker)) if marker is not None else out
