"""Rarefaction and richness estimates from histograms of how many samples a species is in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp01, lchoose
from ..sources.shared import if_small

CUTOFF = 10
STEPS = 300


def rarefaction(histogram: DataFrame, cohorts: DataFrame, keys: tuple[str, ...] = ("marker",), fractions: int = 10) -> DataFrame:
    """DOM-06, JOIN-13, JOIN-14: expected species in a random part of a cohort's samples.

    histogram: keys, cohort, sample_count, species_count; cohorts: (cohort, n_samples), a row a cohort.
    """
    parts = F.explode(F.transform(F.sequence(F.lit(1), F.lit(fractions)), lambda i: i / F.lit(fractions)))
    rows = histogram.join(if_small(cohorts), "cohort").select("*", parts.alias("fraction"))
    big, k = F.col("n_samples"), F.col("sample_count")
    # the ceiling of a product that floating point puts just above a whole number
    n = F.ceil(F.round(big * F.col("fraction"), 9))
    missed = F.when(n > big - k, F.lit(0.0)).otherwise(F.exp(lchoose(big - k, n) - lchoose(big, n)))
    return rows.withColumn("expected", F.col("species_count") * (1 - missed)).groupBy(*keys, "cohort", "fraction").agg(F.sum("expected").alias("species"))


def poisson_rate(mean: Column) -> Column:
    """The rate of a zero-truncated Poisson with a mean above 1, by fixed point; null at a mean of 1 or less."""
    start = mean.cast("double")
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda a, i: start * (1 - F.exp(-a)))
    return F.when(start > 1, solved)


def poisson_richness(histogram: DataFrame, keys: tuple[str, ...], cutoff: int = CUTOFF) -> DataFrame:
    """DOM-07: observed species, singletons to triplets, and the truncated Poisson estimate."""
    k, f = F.col("sample_count"), F.col("species_count")
    low = k <= cutoff
    s = histogram.groupBy(*keys).agg(
        F.sum(f).cast("bigint").alias("observed"), F.sum(F.when(low, f).otherwise(0)).cast("bigint").alias("low"), F.sum(F.when(low, k * f).otherwise(0)).cast("bigint").alias("low_sum"),
        *[F.sum(F.when(k == i, f).otherwise(0)).cast("bigint").alias(f"f{i}") for i in (1, 2, 3)],
    )
    s = s.withColumn("poisson_lambda", poisson_rate(F.try_divide("low_sum", "low")))
    rate = F.col("poisson_lambda")
    below = F.col("low") / (1 - F.exp(-rate))
    error = F.sqrt(below / (F.exp(rate) - 1 - rate))
    return s.select(
        *keys, "observed", "f1", "f2", "f3", F.try_divide("f1", "f2").alias("f1_f2"), F.try_divide("f2", "f3").alias("f2_f3"), "poisson_lambda",
        (below + (F.col("observed") - F.col("low"))).alias("poisson_estimate"), error.alias("poisson_error"),
    )


def chao_bunge(k: np.ndarray, f: np.ndarray, cutoff: int = CUTOFF) -> float:
    """Chao and Bunge (2002): duplicates among the low counts give the coverage."""
    low = k <= cutoff
    top, s1, s2 = f[~low].sum(), (k * f)[low].sum(), (k * k * f)[low].sum()
    f1 = f[k == 1].sum()
    coverage = 1 - f1 * s2 / s1**2 if s1 else np.nan
    return float(top + f[low & (k > 1)].sum() / coverage) if coverage > 0 else np.nan


def _ratios(k: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the unbroken run of counts from 1: j, f(j), the ratio f(j + 1) / f(j) and the relative variance of that ratio."""
    order = np.argsort(k)
    k, f = k[order], f[order]
    gap = np.flatnonzero((k != np.arange(1, len(k) + 1)) | (f <= 0))
    f = f[: gap[0]] if len(gap) else f
    return np.arange(1.0, len(f)), f, f[1:] / f[:-1], 1 / f[1:] + 1 / f[:-1]


def weighted_ratio(k: np.ndarray, f: np.ndarray) -> tuple[float, float]:
    """Ratios of neighbouring frequencies as a line in log space, weighted by their precision (Rocchetti and others 2011); the estimate and its standard error."""
    j, run, ratio, spread = _ratios(k, f)
    if len(j) < 2:
        return np.nan, np.nan
    design, y, w = np.stack([np.ones_like(j), j], 1), np.log(ratio * (j + 1)), np.sqrt(1 / spread)
    b = np.linalg.lstsq(design * w[:, None], y * w, rcond=None)[0]
    cover = np.linalg.pinv((design * w[:, None]).T @ (design * w[:, None]))
    return _with_unseen(f, run[0] * np.exp(-b[0]), run[0], cover[0, 0])


def _with_unseen(f: np.ndarray, unseen: float, singles: float, relative: float) -> tuple[float, float]:
    """Observed and unseen species, and the error from singletons, the ratio at 0 and the draw of species."""
    n = f.sum()
    if not np.isfinite(unseen) or unseen < 0:
        return np.nan, np.nan
    return float(n + unseen), float(np.sqrt(unseen**2 * (1 / singles + relative) + n * unseen / (n + unseen)))


def kemp(k: np.ndarray, f: np.ndarray) -> tuple[float, float]:
    """Ratios of neighbouring frequencies as a line, or as a quotient of lines, of j (Willis and Bunge 2015).

    The value at 0 is the ratio of singletons to unseen species. Of the forms that are positive throughout, and whose
    refinement ends (a quotient that runs off to ever larger terms is no fit), the one of least weighted squares plus
    twice its parameters is taken.
    """
    j, run, y, spread = _ratios(k, f)
    w = 1 / (y * np.sqrt(spread))
    best = (np.inf, np.nan, np.nan)
    for quotient in (False, True):
        terms = 3 if quotient else 2
        if len(j) <= terms:
            continue
        columns = [np.ones_like(j), j] + ([-j * y] if quotient else [])
        b = np.linalg.lstsq(np.stack(columns, 1) * w[:, None], y * w, rcond=None)[0]
        ended = False
        for _ in range(50):
            under = 1 + b[2] * j if quotient else np.ones_like(j)
            fitted = (b[0] + b[1] * j) / under
            slope = np.stack([1 / under, j / under] + ([-j * fitted / under] if quotient else []), 1) * w[:, None]
            step, _, rank, _ = np.linalg.lstsq(slope, (y - fitted) * w, rcond=None)
            b = b + step
            if rank < terms or not np.isfinite(b).all():
                break
            if ended := bool(np.abs(step).max() < 1e-10 * (1 + np.abs(b).max())):
                break
        under = 1 + b[2] * j if quotient else np.ones_like(j)
        fitted = (b[0] + b[1] * j) / under
        if not ended or b[0] <= 0 or (under <= 0).any() or (fitted <= 0).any():
            continue
        squares = float((((y - fitted) * w) ** 2).sum())
        if squares + 2 * terms < best[0]:
            cover = np.linalg.pinv(slope.T @ slope) * max(1.0, squares / (len(j) - terms))
            best = (squares + 2 * terms, run[0] / b[0], cover[0, 0] / b[0] ** 2)
    return _with_unseen(f, best[1], run[0], best[2]) if np.isfinite(best[0]) else (np.nan, np.nan)


def truncated_poisson(k: np.ndarray, f: np.ndarray, cutoff: int = CUTOFF) -> tuple[float, float]:
    """The zero-truncated Poisson over the low counts, and its standard error."""
    low = k <= cutoff
    n, total = f[low].sum(), (k * f)[low].sum()
    if not n or total <= n:
        return np.nan, np.nan
    a = m = total / n
    for _ in range(STEPS):
        a = m * (1 - np.exp(-a))
    c = n / (1 - np.exp(-a))
    return float(c + f[~low].sum()), float(np.sqrt(c / (np.exp(a) - 1 - a)))


MODELS = ("observed", "kemp", "weighted_ratio", "chao_bunge", "poisson", "no_f1")
#: In this order a fit is selected: the first that has an estimate and, if it has one, a finite error.
SELECTED = ("kemp", "weighted_ratio", "chao_bunge", "poisson")


def fit_models(histogram: DataFrame, keys: tuple[str, ...], cutoff: int = CUTOFF) -> DataFrame:
    """DOM-07, DOM-08: (keys, model, estimate, error), null where a model can't be fitted. A group is a histogram, bounded by the number of distinct counts."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.groupby("sample_count").species_count.sum()
        k, f = g.index.to_numpy(float), g.to_numpy(float)
        rest = k > 1
        values = [
            (f.sum(), 0.0), kemp(k, f), weighted_ratio(k, f), (chao_bunge(k, f, cutoff), np.nan), truncated_poisson(k, f, cutoff),
            truncated_poisson(k[rest] - 1, f[rest], cutoff) if rest.any() else (np.nan, np.nan),
        ]
        out = pd.DataFrame({"model": MODELS, "estimate": [v[0] for v in values], "error": [v[1] for v in values]})
        for i, c in enumerate(keys):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    kinds = ", ".join(f"{c} {histogram.schema[c].dataType.simpleString()}" for c in keys)
    fitted = histogram.select(*keys, "sample_count", "species_count").groupBy(*keys).applyInPandas(one, f"{kinds}, model string, estimate double, error double")
    return fitted.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("estimate", "error")})


def select_model(fits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """DOM-07, AGG-32: (keys, model, estimate, error) of the first model that fits; null in a group of none."""
    rank = F.array_position(F.array(*map(F.lit, SELECTED)), F.col("model"))
    ok = (rank > 0) & F.col("estimate").isNotNull()
    first = fits.groupBy(*keys).agg(F.min(F.when(ok, F.struct(rank.alias("rank"), "model", "estimate", "error"))).alias("m"))
    return first.select(*keys, "m.model", "m.estimate", "m.error")


def without_model(fits: DataFrame, model: str = "kemp") -> DataFrame:
    """FIL-22: rows of other models, and of none."""
    return fits.where(~F.col("model").eqNullSafe(F.lit(model)))


def richness_table(histogram: DataFrame, keys: tuple[str, ...], cutoff: int = CUTOFF) -> DataFrame:
    """DOM-07: one row a group: the default fit, observed species, the fit without singletons, and the first ratios."""
    fits = fit_models(histogram, keys, cutoff)
    each = fits.groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col(v))).alias(f"{m}_{v}") for m, v in (("observed", "estimate"), ("no_f1", "estimate"), ("no_f1", "error"))])
    default = select_model(fits, keys).select(*keys, *[F.col(c).alias(f"default_{c}") for c in ("estimate", "error", "model")])
    ratios = poisson_richness(histogram, keys, cutoff).select(*keys, "f1_f2", "f2_f3")
    model = F.when(F.col("no_f1_estimate").isNotNull(), "poisson").alias("no_f1_model")
    both = _beside(_beside(each, default, keys), ratios, keys)
    return both.select(*keys, "default_estimate", "default_error", "default_model", "observed_estimate", "no_f1_estimate", "no_f1_error", model, "f1_f2", "f2_f3")


def _beside(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of equal keys, null ones too; a left row without a right one stays."""
    named = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(named, on, "left").drop(*[f"__{k}" for k in keys])


def corrected_histogram(histogram: DataFrame, single_read: DataFrame, errors: DataFrame, keys: tuple[str, ...] = ("marker", "cohort")) -> DataFrame:
    """DOM-09: histograms with error singletons removed. errors: keys, estimator, error_fraction; an uncorrected row is added.

    Where the fraction is unknown, so is what is removed, and the count of singletons.
    """
    each = errors.select(*keys, "estimator", "error_fraction", clamp01("error_fraction").alias("pi"))
    none = errors.select(*keys).distinct().select(*keys, F.lit("Uncorrected").alias("estimator"), F.lit(0.0).alias("error_fraction"), F.lit(0.0).alias("pi"))
    rows = histogram.join(if_small(each.unionByName(none)), list(keys)).join(if_small(single_read.select(*keys, "n_single_read_clusters")), list(keys))
    f, share = F.col("species_count"), F.bround(F.col("pi") * F.col("n_single_read_clusters"))
    removed = F.when(F.col("sample_count") != 1, 0).when(share.isNotNull(), F.least(share, f)).cast("bigint")
    return rows.select(
        *keys, "estimator", "error_fraction", "pi", F.col("n_single_read_clusters").alias("single_read_f1"), "sample_count", removed.alias("f1_removed"), (f - removed).cast("bigint").alias("species_count")
    )


def corrected_fits(histogram: DataFrame, single_read: DataFrame, errors: DataFrame, keys: tuple[str, ...] = ("marker", "cohort"), cutoff: int = CUTOFF) -> DataFrame:
    """DOM-09: one row a group and estimator: what was removed, and of the corrected histogram the Poisson fit and, beside it, the default one.

    All fits are null where the error fraction is.
    """
    groups = (*keys, "estimator")
    rows = corrected_histogram(histogram, single_read, errors, keys)
    facts = rows.groupBy(*groups).agg(
        *[F.max(c).alias(c) for c in ("error_fraction", "pi", "single_read_f1")], F.sum(F.when(F.col("sample_count") == 1, F.col("species_count") + F.col("f1_removed"))).alias("f1"),
        F.max(F.when(F.col("sample_count") == 1, F.col("f1_removed"))).alias("f1_removed"), F.when(F.count("*") == F.count("species_count"), F.sum("species_count")).alias("observed_corrected"),
    )
    known = rows.where("pi IS NOT NULL")
    poisson = poisson_richness(known, groups, cutoff).select(*groups, "poisson_estimate", "poisson_error", "poisson_lambda")
    default = select_model(fit_models(known, groups, cutoff), groups).select(*groups, *[F.col(c).alias(f"default_{c}") for c in ("estimate", "error", "model")])
    return _beside(_beside(facts, poisson, groups), default, groups)


def fit_differences(corrected: DataFrame, main: DataFrame, keys: tuple[str, ...] = ("marker", "cohort"), more_than: float = 1.0) -> DataFrame:
    """JOIN-23: uncorrected groups whose Poisson estimate is not that of the main default fit."""
    mine = corrected.where("estimator = 'Uncorrected'").select(*keys, "poisson_estimate")
    other = main.select(*keys, "default_estimate", "default_model")
    return mine.join(other, list(keys)).withColumn("difference", F.col("poisson_estimate") - F.col("default_estimate")).where(F.abs("difference") > more_than)


def corrected_summary(fits: DataFrame, keys: tuple[str, ...] = ("marker", "cohort"), over: str = "marker") -> DataFrame:
    """AGG-31: over the markers of each cohort and estimator, medians and range, fits of other models than the Poisson, and fits that failed.

    Medians are exact. Those of the fraction and of the removed share are null if any of them is; estimates that are null are left out.
    """
    groups = [k for k in keys if k != over]
    rows = against_uncorrected(fits, keys).withColumn("share", F.try_divide("f1_removed", "f1"))
    whole = lambda c: F.when(F.count("*") == F.count(c), F.median(c))
    return rows.groupBy(*groups, "estimator").agg(
        whole("pi").alias("median_pi"), whole("share").alias("median_f1_removed_fraction"), F.median("poisson_estimate").alias("median_estimate"),
        F.count_if(F.col("default_model") != "poisson").alias("n_default_non_poisson"), F.median("ratio").alias("median_ratio"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"),
        F.count_if(F.col("poisson_estimate").isNull()).alias("n_na"),
    )


def model_counts(fits: DataFrame) -> DataFrame:
    """AGG-32: fits of each cohort and estimator by the model that was selected, null for none."""
    return fits.groupBy("cohort", "estimator", F.col("default_model").alias("model")).agg(F.count("*").alias("n"))


def corrected_richness(histogram: DataFrame, single_read: DataFrame, errors: DataFrame, keys: tuple[str, ...] = ("marker", "cohort")) -> DataFrame:
    """DOM-09: Poisson richness of each estimator's corrected histogram."""
    return poisson_richness(corrected_histogram(histogram, single_read, errors, keys), (*keys, "estimator"))


def against_uncorrected(richness: DataFrame, keys: tuple[str, ...] = ("marker", "cohort")) -> DataFrame:
    """AGG-31, WIN-07: each estimate over the uncorrected one of its group."""
    from pyspark.sql import Window as W

    base = F.max(F.when(F.col("estimator") == "Uncorrected", F.col("poisson_estimate"))).over(W.partitionBy(*keys))
    return richness.withColumn("ratio", F.try_divide(F.col("poisson_estimate"), base))
