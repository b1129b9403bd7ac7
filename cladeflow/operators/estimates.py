"""The fraction of rare sequences that are errors, as a mixture of a reference and pure error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("scope", "marker")
CLASS_KEYS = (*KEYS, "f_class", "single_read", "parent_class")
REFERENCE = "f100+"


def pooled(signature: DataFrame) -> DataFrame:
    """AGG-16: rows of each parent class, and of all parents together, by grouping sets in one pass."""
    sums = [c for c in signature.columns if c not in (*CLASS_KEYS, "sample_fraction")]
    named = ", ".join(f"CAST(sum({c}) AS {signature.schema[c].dataType.simpleString()}) AS {c}" for c in sums)
    return signature.sparkSession.sql(
        f"SELECT scope, marker, f_class, single_read, coalesce(parent_class, 'all') AS parent_class, {named} FROM {{s}} "
        "GROUP BY GROUPING SETS ((scope, marker, f_class, single_read, parent_class), (scope, marker, f_class, single_read))",
        s=signature,
    )


def reference(signature: DataFrame, reference_scope: str | None = None) -> DataFrame:
    """AGG-17: sums of the most abundant class, of each scope or of one for all."""
    rows = signature.where(F.col("f_class") == REFERENCE)
    keys = KEYS
    if reference_scope is not None:
        rows, keys = rows.where(F.col("scope") == reference_scope), ("marker",)
    return rows.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(f"ref_{c}") for c in ("n_single_nt", "pos3", "syn", "stop")])


def estimate(signature: DataFrame, reference_scope: str | None = None) -> DataFrame:
    """DOM-04, DOM-05, JOIN-12: error fractions and their standard errors of every class but the reference; not clamped."""
    ref = reference(signature, reference_scope)
    keys = [c for c in KEYS if c in ref.columns]
    data = pooled(signature).where(F.col("f_class") != REFERENCE).where("n_single_nt > 0").join(ref, keys)
    n, ref_n = F.col("n_single_nt"), F.col("ref_n_single_nt")
    stats = F.array(
        F.struct(F.lit("codon_position").alias("statistic"), F.col("pos3").alias("k"), F.col("ref_pos3").alias("ref_k"), F.lit(1 / 3).alias("p_err")),
        F.struct(F.lit("synonymous").alias("statistic"), F.col("syn").alias("k"), F.col("ref_syn").alias("ref_k"), (F.col("exp_syn") / n).alias("p_err")),
        F.struct(F.lit("stop_codon").alias("statistic"), F.col("stop").alias("k"), F.col("ref_stop").alias("ref_k"), (F.col("exp_stop") / n).alias("p_err")),
    )
    rows = data.select(*CLASS_KEYS, "n_pairs", "n_single_nt", ref_n, F.explode(stats).alias("s")).select(
        *CLASS_KEYS, F.col("s.statistic").alias("statistic"), F.lit(reference_scope or "same_scope").alias("reference"), "n_pairs", "n_single_nt",
        (F.col("s.k") / n).alias("p_obs"), F.try_divide(F.col("s.ref_k"), ref_n).alias("p_ref"), F.col("s.p_err").alias("p_err"),
    )
    gap = F.col("p_ref") - F.col("p_err")
    se = F.sqrt(F.col("p_obs") * (1 - F.col("p_obs")) / n)
    return rows.select("*", F.try_divide(F.col("p_ref") - F.col("p_obs"), gap).alias("error_fraction"), F.try_divide(se, F.abs(gap)).alias("error_fraction_se"))
