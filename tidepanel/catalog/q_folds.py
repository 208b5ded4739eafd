"""Ridge, calibrated logistic and boosted stumps over walk-forward folds of bar samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.catalog import foldsql
from tidepanel.catalog import panelsql as P
from tidepanel.catalog import settings as S
from tidepanel.catalog.q_decisions import BAR_FOLD_SQL, CANDIDATE_SQL, GATES, bar_fold_samples, evaluated_folds
from tidepanel.catalog.q_models import COST
from tidepanel.catalog.q_samples import SAMPLES_SQL, SPREAD_BPS, bar_samples
from tidepanel.catalog.registry import query, rounded
from tidepanel.catalog.reports import report
from tidepanel.catalog.sqlviews import with_views
from tidepanel.catalog.tables import Tables
from tidepanel.operators import decisions, foldmodels, models, stats, walkforward

KEY = ["fold_index"]
ALPHA = 1.0
LOGISTIC = dict(l2=0.01, iterations=12, rate=0.5)
PLATT = dict(l2=0.01, iterations=10, rate=0.5)
STUMPS = dict(rounds=4, rate=0.1, minimum_leaf=20, limit=8)
MINIMUM_TRADES = 10
# Scores are cut to this many digits once, so that thresholds taken from them compare alike everywhere.
SCORE_DIGITS = 12
BAR = S.BAR_GEOMETRY


def members(t: Tables) -> DataFrame:
    """Samples by fold and partition, absent features as zero; the validation rows carry their half."""
    def build() -> DataFrame:
        rows, _ = bar_fold_samples(t, bar_samples(t))
        rows = models.feature_frame(rows).select(
            "fold_index", "partition", "sample_id", "instrument_id", "decision_ns", "forward_return", *models.FEATURES)
        halved = walkforward.chronological_split(rows, ["fold_index", "partition"], "decision_ns", ties=("sample_id",))
        return halved.withColumn("half", F.when(F.col("partition") == "validation", F.col("half")).otherwise(F.col("partition")))

    return report(t, "fold-members", build)


def ridge_fits(t: Tables) -> DataFrame:
    return report(t, "fold-ridge", lambda: foldmodels.fit_ridge(members(t).filter("partition = 'train'"), KEY, alpha=ALPHA))


def logistic_fits(t: Tables) -> DataFrame:
    return report(t, "fold-logistic", lambda: foldmodels.fit_logistic(members(t).filter("partition = 'train'"), KEY, **LOGISTIC))


def logits(t: Tables) -> DataFrame:
    return members(t).join(logistic_fits(t), KEY).withColumn("logit", foldmodels.linear_score())


def platt_fits(t: Tables) -> DataFrame:
    return report(t, "fold-platt", lambda: foldmodels.fit_platt(logits(t).filter("half = 'calibration'"), KEY, **PLATT))


def stump_fits(t: Tables) -> DataFrame:
    return report(t, "fold-stumps", lambda: foldmodels.fit_stumps(members(t).filter("partition = 'train'"), KEY, **STUMPS))


def calibrated(t: Tables) -> DataFrame:
    logit = F.col("logit")
    return logits(t).join(platt_fits(t), KEY).withColumns({
        "raw": models.sigmoid(logit), "calibrated": models.sigmoid(F.col("slope") * logit + F.col("shift"))})


def scores(t: Tables) -> DataFrame:
    """A row per model, fold and validation or test sample; `chooses` marks the rows that a threshold is chosen on."""
    def build() -> DataFrame:
        rows = members(t).filter("partition <> 'train'")
        keep = ["fold_index", "sample_id", "instrument_id", "decision_ns", "forward_return", "half"]

        def named(df: DataFrame, name: str, score, chooses: tuple[str, ...]) -> DataFrame:
            return df.select(*keep, F.lit(name).alias("candidate"), F.round(score, SCORE_DIGITS).alias("score"),
                             F.col("half").isin(*chooses).alias("chooses"))

        # Calibration rows may choose for the models that are not calibrated.
        both = ("calibration", "selection")
        return named(rows.join(ridge_fits(t), KEY), "ridge_linear", foldmodels.linear_score(), both).unionByName(
            named(calibrated(t).filter("partition <> 'train'"), "logistic_calibrated", F.col("calibrated") - 0.5, ("selection",))
        ).unionByName(named(rows.join(stump_fits(t), KEY), "boosted_stumps", foldmodels.stump_score(), both))

    return report(t, "fold-scores", build)


def thresholds(t: Tables) -> DataFrame:
    rows = scores(t).filter("chooses")
    cell = ["fold_index", "candidate"]
    grid = stats.threshold_grid(rows, cell, F.col("score"))
    return stats.best_threshold(rows, grid, cell, F.col("score"), cost=COST, minimum_trades=MINIMUM_TRADES)


def evaluation(t: Tables) -> DataFrame:
    """Test rows traded at the chosen threshold; a model without one trades nothing in that fold."""
    def build() -> DataFrame:
        tested = scores(t).filter("half = 'test'").join(thresholds(t).select("fold_index", "candidate", "threshold"), ["fold_index", "candidate"], "left")
        return evaluated_folds(tested.withColumn("signal", stats.threshold_signal(F.col("score"), F.col("threshold"))))

    return report(t, "fold-evaluation", build)


FOLDS_SQL = {
    **SAMPLES_SQL, **P.folds(BAR, "(SELECT DISTINCT decision_ns FROM samples)"), **foldsql.fold_members(), **foldsql.scaling(),
}
LOGISTIC_SQL = {**FOLDS_SQL, **foldsql.logistic(**LOGISTIC), **foldsql.platt(**PLATT)}
STUMPS_SQL = {**FOLDS_SQL, **foldsql.stumps(**STUMPS)}
_KEEP = "fold_index, sample_id, instrument_id, decision_ns, y"
SCORES_SQL = {
    **LOGISTIC_SQL, **foldsql.ridge(ALPHA), **foldsql.stumps(**STUMPS),
    "scores": f"""
    SELECT {_KEEP}, part, 'ridge_linear' AS candidate, round({foldsql.linear()}, {SCORE_DIGITS}) AS score, part = 'validation' AS chooses
      FROM scaled JOIN ridge USING (fold_index) WHERE part <> 'train'
    UNION ALL SELECT {_KEEP}, part, 'logistic_calibrated', round(p_calibrated - 0.5::DOUBLE, {SCORE_DIGITS}), part = 'selection' FROM calibrated WHERE part <> 'train'
    UNION ALL SELECT {_KEEP}, part, 'boosted_stumps', round(pred, {SCORE_DIGITS}), part = 'validation' FROM boosted WHERE part <> 'train'""",
    "sized": """
    SELECT fold_index, candidate, abs(score) AS threshold, row_number() OVER (PARTITION BY fold_index, candidate ORDER BY abs(score)) - 1 AS rk,
      count(*) OVER (PARTITION BY fold_index, candidate) AS n FROM scores WHERE chooses""",
    "grid": """
    SELECT DISTINCT fold_index, candidate, threshold FROM sized WHERE list_contains(list_transform(range(8), lambda i: i * (n - 1) // 7), rk)
    UNION SELECT DISTINCT fold_index, candidate, 0 FROM scores WHERE chooses""",
    "trials": f"""
    SELECT fold_index, candidate, threshold, sum(CASE WHEN score > threshold THEN y - {COST!r}::DOUBLE WHEN score < -threshold THEN -y - {COST!r}::DOUBLE ELSE 0 END) AS total,
      count_if(abs(score) > threshold) AS trades FROM grid JOIN scores USING (fold_index, candidate) WHERE chooses GROUP BY ALL""",
    "chosen": f"""
    SELECT fold_index, candidate, threshold, total, trades FROM (SELECT *, row_number() OVER (PARTITION BY fold_index, candidate ORDER BY total DESC, threshold DESC) AS rk
      FROM trials WHERE trades >= {MINIMUM_TRADES}) WHERE rk = 1""",
}
EVALUATION_SQL = {
    **SCORES_SQL,
    "signals": """
    SELECT s.*, CASE WHEN score > threshold THEN 1 WHEN score < -threshold THEN -1 ELSE 0 END AS signal
    FROM scores s LEFT JOIN chosen USING (fold_index, candidate) WHERE part = 'test'""",
    "fold_net": f"""
    SELECT s.*, scenario, CASE WHEN signal = 0 THEN 0 ELSE signal * y - cost END AS net_return
    FROM signals s CROSS JOIN (VALUES {', '.join(f"('{c.scenario}', {c.round_trip(SPREAD_BPS)!r}::DOUBLE)" for c in S.SIGNAL_COSTS)}) v(scenario, cost)""",
    **{k: v for k, v in BAR_FOLD_SQL.items() if k in ("cells", "series", "tested", "evaluated") or k.startswith("boot_")},
    "whole": "SELECT e.*, (SELECT max(fold_count) FROM bounds) AS fold_count FROM evaluated e",
}


def statement(more: dict[str, str], select: str) -> str:
    return foldsql.recursive(with_views("hour_bars", more=more) + select)


@query("p12_model_folds", statement({**EVALUATION_SQL, "decided": CANDIDATE_SQL.format(group="fold_index, instrument_id, ", rows="whole")}, """
SELECT fold_index, instrument_id, candidate, trade_count, round(base_total, 9) AS base_total, round(adverse_total, 9) AS adverse_total,
  round(lower, 8) AS lower, round(p_value, 9) AS p_value, round(q_value, 9) AS q_value, decision_status, reason_codes
FROM evaluated JOIN decided USING (fold_index, instrument_id, candidate)"""))
def p12(t):
    """Every model fitted on a fold's training rows, its threshold chosen on validation, judged on test rows."""
    _, bounds = bar_fold_samples(t, bar_samples(t))
    rows = evaluation(t).withColumn("fold_count", bounds.agg(F.max("fold_count").alias("n")).scalar())
    status, codes = decisions.candidate_decision(GATES, F.col("fold_count"))
    out = rows.withColumns({"decision_status": status, "reason_codes": F.array_join(codes, ",")}).select(
        "fold_index", "instrument_id", "candidate", "trade_count", "base_total", "adverse_total", "lower", "p_value", "q_value",
        "decision_status", "reason_codes")
    return rounded(rounded(out, 8, ["lower"]), 9, ["base_total", "adverse_total", "p_value", "q_value"])


def _parameters_sql(source: str, name: str) -> str:
    parts = [f"SELECT fold_index, '{name}' AS model, '{f}' AS parameter, b{i} AS value FROM {source}" for i, f in enumerate(models.FEATURES)]
    return " UNION ALL ".join([*parts, f"SELECT fold_index, '{name}', 'intercept', a FROM {source}"])


PARAMETERS_SQL = {
    **LOGISTIC_SQL, **foldsql.ridge(ALPHA),
    "parameters": " UNION ALL ".join([
        _parameters_sql("ridge", "ridge_linear"), _parameters_sql("logistic", "logistic"),
        "SELECT fold_index, 'platt', 'slope', slope FROM platt", "SELECT fold_index, 'platt', 'shift', shift FROM platt"]),
}


def linear_parameters(fits: DataFrame, name: str) -> DataFrame:
    named = F.array(*[F.struct(F.lit(f).alias("parameter"), F.get("coefficients", F.lit(i)).alias("value")) for i, f in enumerate(models.FEATURES)],
                    F.struct(F.lit("intercept").alias("parameter"), F.col("intercept").alias("value")))
    return fits.select("fold_index", F.lit(name).alias("model"), F.explode(named).alias("_p")).select("fold_index", "model", "_p.*")


@query("p12b_fold_parameters", statement(PARAMETERS_SQL, "SELECT fold_index, model, parameter, round(value, 8) AS value FROM parameters"))
def p12b(t):
    shift = F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("value")) for n in ("slope", "shift")])
    platt = platt_fits(t).select("fold_index", F.lit("platt").alias("model"), F.explode(shift).alias("_p")).select("fold_index", "model", "_p.*")
    return rounded(linear_parameters(ridge_fits(t), "ridge_linear").unionByName(
        linear_parameters(logistic_fits(t), "logistic")).unionByName(platt), 8)


@query("p12c_fold_probabilities", statement({**LOGISTIC_SQL, "kinds": """
    SELECT fold_index, part, 'raw' AS kind, p_raw AS p, y FROM calibrated WHERE part <> 'train'
    UNION ALL SELECT fold_index, part, 'calibrated', p_calibrated, y FROM calibrated WHERE part <> 'train'"""}, """
SELECT fold_index, part AS half, kind, count(*) AS samples, round(avg((p - up) * (p - up)), 9) AS brier,
  round(avg(-(up * ln(p) + (1 - up) * ln(1 - p))), 9) AS log_loss
FROM (SELECT fold_index, part, kind, least(greatest(p, 1e-15), 1 - 1e-15) AS p, CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0 END AS up FROM kinds) GROUP BY ALL"""))
def p12c(t):
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("probability")) for k in ("raw", "calibrated")])
    rows = calibrated(t).filter("partition <> 'train'").select("fold_index", "half", "forward_return", F.explode(kinds).alias("_k"))
    return rounded(stats.probability_metrics(rows.select("fold_index", "half", "forward_return", "_k.*"), ["fold_index", "half", "kind"]), 9)


@query("p12d_fold_stumps", statement(STUMPS_SQL, f"""
SELECT fold_index, round, {foldsql.FEATURE_NAME} AS feature, round(threshold, 9) AS threshold, round(lv, 9) AS "left", round(rv, 9) AS "right",
  round(gain, 3) AS gain FROM stumps"""))
def p12d(t):
    rows = stump_fits(t).select("fold_index", F.posexplode("stumps").alias("round", "_s"))
    name = F.element_at(F.array(*[F.lit(f) for f in models.FEATURES]), F.col("_s.feature") + 1).alias("feature")
    out = rows.select("fold_index", "round", name, "_s.threshold", "_s.left", "_s.right", "_s.gain")
    return rounded(rounded(out, 3, ["gain"]), 9, ["threshold", "left", "right"])


@query("p12f_fold_thresholds", statement(SCORES_SQL, """
SELECT fold_index, candidate, round(threshold, 9) AS threshold, round(total, 9) AS total_net_return, trades AS trade_count FROM chosen"""))
def p12f(t):
    return rounded(thresholds(t), 9)
