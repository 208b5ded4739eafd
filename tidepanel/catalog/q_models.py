"""Model fits on bar samples: ridge, logistic with calibration, boosted stumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.catalog import foldsql
from tidepanel.catalog import settings as S
from tidepanel.catalog.q_samples import SAMPLES_SQL, SPREAD_BPS, bar_samples
from tidepanel.catalog.registry import query, rounded
from tidepanel.catalog.reports import report
from tidepanel.catalog.sqlviews import with_views
from tidepanel.operators import foldmodels, models, stats, walkforward

COST = S.SIGNAL_COSTS[0].round_trip(SPREAD_BPS)


def parted(t) -> DataFrame:
    """Samples split in time: the first 60% train, then 20% validation, 20% test."""
    def build() -> DataFrame:
        rows = models.feature_frame(bar_samples(t))
        edges = rows.agg(F.min("decision_ns").alias("a"), F.max("decision_ns").alias("b"))
        start, end = edges.select("a").scalar(), edges.select("b").scalar()
        position = (F.col("decision_ns") - start) / (end - start)
        part = F.when(position < 0.6, "train").when(position < 0.8, "validation").otherwise("test")
        return rows.withColumn("partition", part)

    return report(t, "parted", build)


def only(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("partition") == name)


@query("l09_feature_vector", with_views("hour_bars", more=SAMPLES_SQL) + """
SELECT sample_id, round(observed_return, 9) AS observed_return, round(coalesce(volume_change, 0), 9) AS volume_change,
  round(coalesce(cross_basis, 0), 9) AS cross_basis FROM samples""")
def l09(t):
    out = models.feature_frame(bar_samples(t)).select("sample_id", "observed_return", "volume_change", "cross_basis")
    return rounded(out, 9)


def coefficients(t, model: models.Linear) -> DataFrame:
    rows = [(f, b, m, s, model.intercept) for f, b, m, s in zip(models.FEATURES, model.coefficients, model.means, model.scales, strict=True)]
    return t.spark.createDataFrame(rows, "feature string, coefficient double, mean double, scale double, intercept double")


CUT_SQL = {**SAMPLES_SQL, **foldsql.single_members(), **foldsql.scaling()}


def statement(more: dict[str, str], select: str) -> str:
    return foldsql.recursive(with_views("hour_bars", more={**CUT_SQL, **more}) + select)


def coefficients_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(b{i}, 8) AS coefficient, round(m{i}, 8) AS mean, round(s{i}, 8) AS scale, round(a, 8) AS intercept "
        f"FROM {source} JOIN scales USING (fold_index)" for i, f in enumerate(models.FEATURES))


@query("l05_ridge", statement(foldsql.ridge(1.0), coefficients_sql("ridge")))
def l05(t):
    return rounded(coefficients(t, models.fit_ridge(only(parted(t), "train"), alpha=1.0)), 8)


@query("l06_logistic", statement(foldsql.logistic(0.01, 15, 0.5), coefficients_sql("logistic")))
def l06(t):
    return rounded(coefficients(t, models.fit_logistic(only(parted(t), "train"), l2=0.01, iterations=15, rate=0.5)), 8)


@query("l07_platt_calibration", statement({**foldsql.logistic(0.01, 10, 0.5), **foldsql.platt(0.01, 10, 0.5), "kinds": """
    SELECT 'raw' AS kind, p_raw AS p, y FROM calibrated WHERE part = 'test' UNION ALL SELECT 'calibrated', p_calibrated, y FROM calibrated WHERE part = 'test'"""}, """
SELECT kind, count(*) AS samples, round(avg((p - up) * (p - up)), 9) AS brier, round(avg(-(up * ln(p) + (1 - up) * ln(1 - p))), 9) AS log_loss
FROM (SELECT kind, least(greatest(p, 1e-15), 1 - 1e-15) AS p, CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0 END AS up FROM kinds) GROUP BY ALL"""))
def l07(t):
    rows = parted(t)
    model = models.fit_logistic(only(rows, "train"), l2=0.01, iterations=10, rate=0.5)
    halves = walkforward.chronological_split(only(rows, "validation").withColumn("logit", model.score()), ["partition"], "decision_ns", ties=("sample_id",))
    slope, intercept = models.fit_platt(halves.filter("half = 'calibration'"), l2=0.01, iterations=10, rate=0.5)
    scored = only(rows, "test").withColumn("logit", model.score())
    both = scored.withColumn("_p", F.explode(F.array(
        F.struct(F.lit("raw").alias("kind"), models.sigmoid(F.col("logit")).alias("probability")),
        F.struct(F.lit("calibrated").alias("kind"), models.sigmoid(F.lit(slope) * F.col("logit") + F.lit(intercept)).alias("probability")),
    ))).select("forward_return", "_p.*")
    return rounded(stats.probability_metrics(both, ["kind"]), 9)


@query("l08_boosted_stumps", statement(foldsql.stumps(8, 0.1, 20, 16), f"""
SELECT round, {foldsql.FEATURE_NAME} AS feature, round(threshold, 9) AS threshold, round(lv, 9) AS "left", round(rv, 9) AS "right",
  round(gain, 3) AS gain, round(base, 9) AS base FROM stumps JOIN bases USING (fold_index)"""))
def l08(t):
    train = only(parted(t), "train").withColumn("fold_index", F.lit(0))
    fits = foldmodels.fit_stumps(train, ["fold_index"], rounds=8, rate=0.1, minimum_leaf=20, limit=16)
    name = F.element_at(F.array(*[F.lit(f) for f in models.FEATURES]), F.col("_s.feature") + 1).alias("feature")
    out = fits.select("base", F.posexplode("stumps").alias("round", "_s")).select(
        "round", name, "_s.threshold", "_s.left", "_s.right", "_s.gain", "base")
    return rounded(rounded(out, 3, ["gain"]), 9, ["threshold", "left", "right", "base"])


@query("p12e_single_cut")
def p12e(t):
    """Fit on train, choose the threshold on validation, score on test, for each model."""
    rows = parted(t)
    train = only(rows, "train")
    base, stumps = models.fit_stumps(train, rounds=4, rate=0.1, minimum_leaf=20, limit=8)
    scores = F.array(
        F.struct(F.lit("ridge").alias("model"), models.fit_ridge(train, alpha=1.0).score().alias("score")),
        F.struct(F.lit("stumps").alias("model"), models.stump_score(base, stumps).alias("score")),
    )
    scored = rows.withColumn("_m", F.explode(scores)).select("*", "_m.model", "_m.score").drop("_m")
    validation = only(scored, "validation")
    grid = stats.threshold_grid(validation, ["model"], F.col("score"))
    chosen = stats.best_threshold(validation, grid, ["model"], F.col("score"), cost=COST, minimum_trades=10)
    signals = only(scored, "test").join(chosen.select("model", "threshold"), "model").withColumn(
        "signal", stats.threshold_signal(F.col("score"), F.col("threshold"))
    )
    return stats.evaluate_signals(stats.net_returns(signals, S.SIGNAL_COSTS, SPREAD_BPS), ["model", "scenario", "threshold"])
