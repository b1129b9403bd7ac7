"""Fits on frequencies whose species are known."""

import math

import duckdb
import numpy as np
import pytest

from cladeflow.operators import richness
from cladeflow.plans import fits

K = np.arange(1.0, 13.0)


def test_kemp_on_a_line_of_ratios():
    """Ratios f(j + 1) / f(j) = 0.5 + 0.02 j: at 0 the ratio is 0.5, so twice the singletons are unseen."""
    f = [1000.0]
    for j in range(1, 12):
        f.append(f[-1] * (0.5 + 0.02 * j))
    f = np.array(f)
    estimate, error = richness.kemp(K, f)
    assert estimate == pytest.approx(f.sum() + 2000, rel=1e-6)
    assert 0 < error < estimate


def test_kemp_on_a_quotient():
    """Ratios (0.4 + 0.1 j) / (1 + 0.2 j): 2.5 times the singletons are unseen."""
    f = [5e9]  # so many that a line is told from a quotient
    for j in range(1, 12):
        f.append(f[-1] * (0.4 + 0.1 * j) / (1 + 0.2 * j))
    f = np.array(f)
    assert richness.kemp(K, f)[0] == pytest.approx(f.sum() + 1.25e10, rel=1e-4)


def test_poisson_and_its_error():
    rate, species = 1.5, 10_000.0
    f = np.array([species * math.exp(-rate) * rate**k / math.factorial(k) for k in range(1, 11)])
    estimate, error = richness.truncated_poisson(K[:10], f)
    assert estimate == pytest.approx(species, rel=1e-5)
    assert error == pytest.approx(math.sqrt(species / (math.exp(rate) - 1 - rate)), rel=1e-3)


def test_weighted_ratio_on_poisson_frequencies():
    """A Poisson's ratios times j + 1 are its rate, a level line: singletons over the rate are unseen."""
    f = np.array([1e4 * math.exp(-2.0) * 2.0**k / math.factorial(k) for k in range(1, 9)])
    assert richness.weighted_ratio(K[:8], f)[0] == pytest.approx(1e4 * (1 - math.exp(-2.0)) - 1e4 * math.exp(-2.0) * sum(2.0**k / math.factorial(k) for k in range(9, 40)) + 1e4 * math.exp(-2.0), rel=1e-6)


def test_no_fit():
    one = np.array([5.0])
    assert all(math.isnan(x) for m in (richness.kemp, richness.weighted_ratio, richness.truncated_poisson) for x in m(np.array([1.0]), one))


def test_selection(spark):
    h = [("a", int(k), int(v)) for k, v in zip(K, 1000 * 0.6 ** (K - 1))] + [("b", 1, 10), ("b", 2, 5)] + [("c", 1, 4)]
    df = spark.createDataFrame(h, "marker string, sample_count long, species_count long")
    fits = richness.fit_models(df, ("marker",))
    assert fits.count() == 3 * len(richness.MODELS)
    got = {r.marker: (r.model, r.estimate, r.error) for r in richness.select_model(fits, ("marker",)).collect()}
    assert got["a"][0] == "kemp" and got["a"][2] > 0
    assert got["b"][0] in ("chao_bunge", "poisson") and got["c"] == (None, None, None)
    assert {r.model for r in richness.without_model(fits).collect()} == set(richness.MODELS) - {"kemp"}


def histograms(seed, n):
    """Histograms with gaps, few counts and null cohorts, as rows of marker, cohort, sample_count, species_count."""
    pick = np.random.default_rng(seed)
    out = []
    for g in range(n):
        base, ratio = pick.integers(50, 5000), pick.uniform(0.2, 0.9)
        for k in range(1, pick.integers(2, 30)):
            f = int(base * ratio ** (k - 1) * pick.uniform(0.7, 1.3) * (1 + k * pick.uniform(0, 0.1)))
            if pick.random() > 0.05:
                out.append((f"m{g}", None if g % 7 == 0 else "c", k, f))
    return out


def test_models_against_sums(spark):
    """Every model by the closed solutions of its normal equations, in another engine."""
    rows = histograms(4, 80)
    df = spark.createDataFrame(rows, "marker string, cohort string, sample_count long, species_count long")
    con = duckdb.connect()
    con.register("hist", df.toPandas())
    made = richness.fit_models(df, ("marker", "cohort"))
    both = ((made, fits.fits("hist", "marker, cohort")), (richness.select_model(made, ("marker", "cohort")), fits.selected("hist", "marker, cohort")))
    for frame, sql in both:
        want = {(marker, model): (estimate, error) for marker, _, model, estimate, error in con.sql(sql).fetchall()}
        got = {(r.marker, r.model): (r.estimate, r.error) for r in frame.collect()}
        assert got.keys() == want.keys() and len(got) >= 80
        for key, pair in got.items():
            assert [x is None for x in pair] == [x is None for x in want[key]], key
            assert [x or 0 for x in pair] == pytest.approx([x or 0 for x in want[key]], rel=1e-6), key
    chosen = {r[2] for r in con.sql(fits.selected("hist", "marker, cohort")).fetchall()}
    assert len(chosen) >= 3, chosen


def test_the_quotient_is_a_minimum():
    """For each value of the quotient's lower term the others are a line; the best of ever finer grids of it is what is found."""
    noise = np.array([1, 1.001, 0.999, 1.002, 0.998, 1.001, 1, 0.999, 1.002, 0.999, 1.001, 1])
    f = np.array([5e9 * math.prod((0.4 + 0.1 * j) / (1 + 0.2 * j) for j in range(1, k)) for k in range(1, 13)]) * noise
    j, run, y, spread = richness._ratios(K, f)
    w = 1 / (y * np.sqrt(spread))

    def line(lower):
        x = np.stack([np.ones_like(j), j], 1) / (1 + lower * j)[:, None] * w[:, None]
        b, *_ = np.linalg.lstsq(x, y * w, rcond=None)
        return float(((y * w - x @ b) ** 2).sum()), b[0]

    low, high = 0.0, 5.0
    for _ in range(12):
        grid = np.linspace(low, high, 201)
        at = int(np.argmin([line(x)[0] for x in grid]))
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, 200)]
    assert 0 < low < high < 5
    estimate, error = richness.kemp(K, f)
    assert estimate == pytest.approx(f.sum() + run[0] / line((low + high) / 2)[1], rel=1e-6)
    assert 0 < error < estimate


def test_a_quotient_that_runs_off_is_no_fit():
    """Ratios that fall like 1 / j pull the quotient's terms to infinity; the line is taken."""
    rows = {}
    for marker, _, k, f in histograms(1, 60):
        rows.setdefault(marker, []).append((k, f))
    for marker in rows:
        k, f = (np.array(x, float) for x in zip(*rows[marker]))
        estimate, _ = richness.kemp(k, f)
        assert math.isnan(estimate) or estimate > f.sum() * (1 + 1e-6), marker


FIT_SCHEMA = "marker string, cohort string, sample_count long, species_count long"


def corrected_case(spark):
    """One marker whose ratios lie on a line (Kemp), one on a Poisson, and one whose error fraction is unknown."""
    line = [1000.0]
    for j in range(1, 12):
        line.append(line[-1] * (0.5 + 0.02 * j))
    poisson = [1e5 * math.exp(-1.5) * 1.5**k / math.factorial(k) for k in (1, 2)]
    h = [("kemp", "all", k, round(x)) for k, x in enumerate(line, 1)] + [("poisson", "all", k, round(x)) for k, x in enumerate(poisson, 1)] + [("unknown", "all", 1, 100), ("unknown", "all", 2, 50)]
    single = [("kemp", "all", 400), ("poisson", "all", 1000), ("unknown", "all", 10)]
    errors = [("kemp", "all", "Synonymous", 0.25), ("poisson", "all", "Synonymous", 7.0), ("unknown", "all", "Synonymous", None)]
    return (
        spark.createDataFrame(h, FIT_SCHEMA), spark.createDataFrame(single, "marker string, cohort string, n_single_read_clusters long"),
        spark.createDataFrame(errors, "marker string, cohort string, estimator string, error_fraction double"),
    )


def test_corrected_fits_and_their_check(spark):
    h, single, errors = corrected_case(spark)
    fits_ = {(r.marker, r.estimator): r for r in richness.corrected_fits(h, single, errors).collect()}
    assert len(fits_) == 6
    a = fits_["kemp", "Synonymous"]
    assert (a.f1, a.single_read_f1, a.f1_removed, a.pi) == (1000, 400, 100, 0.25)
    assert fits_["poisson", "Synonymous"].pi == 1.0 and fits_["poisson", "Synonymous"].f1_removed == 1000
    none = fits_["unknown", "Synonymous"]
    assert (none.pi, none.f1_removed, none.observed_corrected, none.poisson_estimate, none.default_estimate, none.default_model) == (None,) * 6
    kemp, poisson = fits_["kemp", "Uncorrected"], fits_["poisson", "Uncorrected"]
    assert kemp.default_model == "kemp" and kemp.f1_removed == 0
    assert kemp.default_estimate == pytest.approx(kemp.observed_corrected + 2000, rel=1e-2)
    # two counts are too few for ratios: Chao and Bunge come before the Poisson
    assert poisson.default_model == "chao_bunge" and poisson.poisson_error > 0
    main = richness.richness_table(h, ("marker", "cohort"))
    off = {r.marker: r for r in richness.fit_differences(richness.corrected_fits(h, single, errors), main).collect()}
    assert off["kemp"].difference == pytest.approx(kemp.poisson_estimate - kemp.default_estimate)
    assert set(off) == {m for (m, e), r in fits_.items() if e == "Uncorrected" and abs(r.poisson_estimate - r.default_estimate) > 1}
    assert richness.fit_differences(richness.corrected_fits(h, single, errors), main, more_than=1e9).count() == 0


def test_summary_and_model_counts(spark):
    rows = [
        ("a", "all", "Uncorrected", 0.0, 0, 10, 100.0, "poisson"), ("b", "all", "Uncorrected", 0.0, 0, 20, 300.0, "kemp"), ("c", "all", "Uncorrected", 0.0, 0, 0, None, None),
        ("a", "all", "Synonymous", 0.5, 5, 10, 80.0, "kemp"), ("b", "all", "Synonymous", 0.25, 2, 20, 150.0, "poisson"), ("c", "all", "Synonymous", 0.75, 3, 30, 50.0, "kemp"),
    ]
    df = spark.createDataFrame(rows, "marker string, cohort string, estimator string, pi double, f1_removed long, f1 long, poisson_estimate double, default_model string")
    got = {r.estimator: r for r in richness.corrected_summary(df).collect()}
    u, s = got["Uncorrected"], got["Synonymous"]
    assert (u.median_pi, u.median_f1_removed_fraction, u.median_estimate, u.n_default_non_poisson, u.n_na) == (0.0, None, 200.0, 1, 1)
    assert (s.median_pi, s.median_f1_removed_fraction, s.median_estimate, s.n_default_non_poisson, s.n_na) == (0.5, pytest.approx(0.1), 80.0, 2, 0)
    assert (s.median_ratio, s.min_ratio, s.max_ratio) == (pytest.approx(0.65), 0.5, 0.8)
    assert {(r.estimator, r.model): r.n for r in richness.model_counts(df).collect()} == {("Uncorrected", "poisson"): 1, ("Uncorrected", "kemp"): 1, ("Uncorrected", None): 1, ("Synonymous", "kemp"): 2, ("Synonymous", "poisson"): 1}
