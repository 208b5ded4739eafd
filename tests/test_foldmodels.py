"""Fits of all folds together against the fits of each fold alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import foldmodels, models

COLUMNS = ["fold", *models.FEATURES, "forward_return"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    out = []
    for fold, n in ((0, 120), (3, 90)):
        x = rng.normal(size=(n, 4)).round(1 + fold)
        x[0, 1] = 1e9 if fold else 0.0  # an outlier that stretches the range
        y = x[:, 0] * 0.4 - x[:, 2] * 0.2 + rng.normal(size=n) * 0.3
        out += [(fold, *map(float, r), float(v)) for r, v in zip(x, y, strict=True)]
    # A fold whose features never vary.
    out += [(7, 1.0, 1.0, None, None, float(v)) for v in (0.5, -0.25, 1.0)]
    return spark.createDataFrame(out, "fold int, " + ", ".join(f"{c} double" for c in COLUMNS[1:])).repartition(3).cache()


def alone(rows, fold):
    return rows.filter(F.col("fold") == fold)


def test_linear_fits_agree_with_single_fits(rows):
    ridge = {r.fold: r for r in foldmodels.fit_ridge(rows, ["fold"], alpha=1.5).collect()}
    descent = {r.fold: r for r in foldmodels.fit_logistic(rows, ["fold"], l2=0.01, iterations=3, rate=0.5).collect()}
    assert set(ridge) == set(descent) == {0, 3, 7}
    single = models.fit_ridge(alone(rows, 0), alpha=1.5)
    assert np.allclose(ridge[0].coefficients, single.coefficients) and ridge[0].intercept == pytest.approx(single.intercept)
    for fold in (0, 3):
        single = models.fit_logistic(alone(rows, fold), l2=0.01, iterations=3, rate=0.5)
        assert np.allclose(descent[fold].coefficients, single.coefficients) and descent[fold].intercept == pytest.approx(single.intercept)
    # Nothing to learn from: no slope, the mean as intercept.
    assert ridge[7].coefficients == [0.0] * 4 and ridge[7].scales == [1.0] * 4 and ridge[7].intercept == pytest.approx(1.25 / 3)


def test_ridge_solves_the_normal_equations_beside_an_outlier(rows):
    data = np.array([list(r) for r in alone(rows, 3).select(*COLUMNS[1:]).collect()])
    x, y = data[:, :4], data[:, 4]
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(4), z.T @ (y - y.mean()))
    fit = foldmodels.fit_ridge(rows, ["fold"], alpha=1.0).filter("fold = 3").first()
    assert np.allclose(fit.coefficients, want, rtol=1e-6)


def test_scores_agree_with_the_plain_expression(rows):
    single = models.fit_ridge(alone(rows, 0), alpha=1.0)
    joined = alone(rows, 0).join(foldmodels.fit_ridge(rows, ["fold"], alpha=1.0), "fold")
    gap = joined.agg(F.max(F.abs(foldmodels.linear_score() - single.score()))).first()[0]
    assert gap < 1e-9


def test_candidates_match_sorted_values(rows):
    got = {(r.fold, r.feature): r.cuts for r in foldmodels.split_candidates(rows, ["fold"], minimum_leaf=5, limit=6).collect()}
    for fold in (0, 3):
        data = np.array([list(r) for r in alone(rows, fold).select(*models.FEATURES).collect()])
        for j in range(4):
            v = np.sort(data[:, j])
            mids = [(v[i] + v[i + 1]) / 2 for i in range(4, len(v) - 5) if v[i] < v[i + 1]]
            want = [mids[i * (len(mids) - 1) // 5] for i in range(6)] if len(mids) > 6 else mids
            assert got[fold, j] == pytest.approx(want)
    assert not [k for k in got if k[0] == 7]


def test_stumps_agree_with_single_fits(rows):
    fits = {r.fold: r for r in foldmodels.fit_stumps(rows, ["fold"], rounds=2, rate=0.1, minimum_leaf=10, limit=5).collect()}
    base, single = models.fit_stumps(alone(rows, 0), rounds=2, rate=0.1, minimum_leaf=10, limit=5)
    assert fits[0].base == pytest.approx(base) and len(fits[0].stumps) == len(single) == 2
    for mine, theirs in zip(fits[0].stumps, single, strict=True):
        assert models.FEATURES[mine.feature] == theirs.feature
        assert (mine.threshold, mine.left, mine.right) == pytest.approx((theirs.threshold, theirs.left, theirs.right))
    assert fits[7].stumps == [] and fits[7].base == pytest.approx(1.25 / 3)


def test_calibration_moves_each_fold_alone(spark):
    rows = spark.createDataFrame([(f, float(i - 3) * (f + 1), float((i % 3) - 1)) for f in (0, 1) for i in range(8)], "fold int, logit double, forward_return double")
    fits = {r.fold: r for r in foldmodels.fit_platt(rows, ["fold"], l2=0.02, iterations=4, rate=0.3).collect()}
    for fold in (0, 1):
        slope, shift = models.fit_platt(alone(rows, fold), l2=0.02, iterations=4, rate=0.3)
        assert (fits[fold].slope, fits[fold].shift) == pytest.approx((slope, shift))


def test_no_rows_fit_nothing(rows):
    none = rows.filter("fold = 99")
    assert foldmodels.fit_ridge(none, ["fold"], alpha=1.0).count() == 0
    assert foldmodels.fit_logistic(none, ["fold"], l2=0.0, iterations=1, rate=0.1).count() == 0
    assert foldmodels.fit_stumps(none, ["fold"], rounds=1, rate=0.1, minimum_leaf=1, limit=2).count() == 0
