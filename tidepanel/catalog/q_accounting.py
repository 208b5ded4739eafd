"""Episodes and the jobs built on them (D16, E20, C10, C11, P1 ...)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.catalog import panelsql as P
from tidepanel.catalog import settings as S
from tidepanel.catalog.registry import query, rounded
from tidepanel.catalog.reports import report
from tidepanel.catalog.sqlviews import with_views
from tidepanel.catalog.tables import Tables
from tidepanel.operators import universe, walkforward, windows
from tidepanel.plans import momentum

NAMES = [m.name for m in S.MEMBERS] + list(momentum.CONTROLS)
FUNDED = {
    "contracts": "SELECT DISTINCT instrument_id, contract_id FROM bars_type",
    "settlements": """
    SELECT contract_id, (calc_time_ns - 345600000000000 + 604799999999999) // 604800000000000 * 604800000000000
        + 345600000000000 AS decision_ns, sum(rate) AS settled,
      sum(CASE WHEN rate > 0 THEN rate ELSE 0 END) AS positive,
      sum(CASE WHEN rate < 0 THEN rate ELSE 0 END) AS negative
    FROM funding_type JOIN contracts USING (instrument_id) GROUP BY ALL""",
}


def plain_calendar(decisions: DataFrame) -> DataFrame:
    """All decisions as one run; a calendar has one row per week, so it is tiny."""
    return decisions.withColumn("ordinal", F.row_number().over(W.orderBy("decision_ns")).cast("long"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rules = replace(S.PANEL, universe=replace(S.UNIVERSE, liquidity_window_days=1), volatility_window_days=2)
    rows, _ = momentum.momentum_episodes(
        t.bars(), plain_calendar(t.decisions), rules, S.MEMBERS, S.SCENARIOS,
        t.funding(),
    )
    return rounded(
        rows.groupBy("member", "scenario").agg(
            F.count("*").alias("episodes"),
            F.count_if("held_nothing").alias("held_nothing"),
            F.sum("net_return").alias("net_return"),
            F.sum("turnover").alias("turnover"),
        ), 9,
    )


EPISODE_SQL = {**P.momentum(), **P.plain_calendar(), **FUNDED, **P.episodes(settlements="settlements"), **P.grid(NAMES)}
EPISODE_COLUMNS = (
    "decision_ns, member, scenario, " + ", ".join(f"round({a}, 9) AS {a}" for a in P.AMOUNTS)
    + ", forced_close_count, positions"
)


@query("d16_weekly_episodes", with_views("bars_type", "funding_type", "decisions", more=EPISODE_SQL) + f"""
SELECT {EPISODE_COLUMNS} FROM grid_episodes""")
def d16(t):
    rows, _ = momentum.momentum_episodes(
        t.bars(), plain_calendar(t.decisions), S.PANEL, S.MEMBERS, S.SCENARIOS,
        t.funding(),
    )
    return rounded(rows.drop("ordinal", "held_nothing"), 9)


FOLD_SQL = {
    **P.momentum(), **P.fold_calendar(), **FUNDED,
    "pooled_weights": "SELECT w.*, c.fold_index FROM weights w JOIN calendar c USING (decision_ns)",
    **{k: v.replace("FROM weights w", "FROM pooled_weights w") for k, v in
       P.episodes(folds=True, settlements="settlements").items()},
    **P.grid(NAMES, folds=True),
}


def daily_bars(t: Tables):
    """The daily bars as a report: the folds and the holdout are jobs of their own over the same panel."""
    return report(t, "daily-bars", t.bars)


def fold_rows(t: Tables):
    """Momentum episodes of every fold's test weeks, in one job."""
    samples = walkforward.rebalance_samples(t.decisions, holding_days=7)
    bounds = walkforward.calendar_bounds(samples, S.GEOMETRY)
    calendar = walkforward.test_calendar(walkforward.fold_membership(samples, bounds, S.GEOMETRY))
    return momentum.momentum_episodes(
        daily_bars(t), calendar, S.PANEL, S.MEMBERS, S.SCENARIOS,
        t.funding(),
    )


@query("p01_momentum_fold", with_views("bars_type", "funding_type", "decisions", more=FOLD_SQL) + f"""
SELECT fold_index, {EPISODE_COLUMNS} FROM grid_episodes""")
def p01(t):
    rows, _ = fold_rows(t)
    return rounded(rows.drop("ordinal", "held_nothing"), 9)


@query("c10_exit_price", with_views("bars_brand", more={"p": P.prices("bars_brand")}) + """
SELECT contract_id, decision_ns, round(coalesce(exit_close, last_inside, entry_close), 9) AS exit_price,
  exit_close IS NULL AS forced FROM p""")
def c10(t):
    from tidepanel.functions.timefns import is_weekly_bar

    out = windows.holding_prices(t.bars("p_brand"), 7).filter(is_weekly_bar(F.col("open_time_ns")))
    return rounded(
        out.select(
            "contract_id", F.col("close_time_ns").alias("decision_ns"),
            F.coalesce("exit_close", "last_inside", "entry_close").alias("exit_price"),
            F.col("exit_close").isNull().alias("forced"),
        ), 9,
    )


@query("e20_drifted_weights", with_views("bars_type", "funding_type", "decisions", more=EPISODE_SQL) + """
SELECT member, decision_ns, contract_id, round(weight, 9) AS weight, round(previous, 9) AS previous
FROM lines WHERE scenario = 'base'""")
def e20(t):
    _, lines = momentum.momentum_episodes(
        t.bars(), plain_calendar(t.decisions), S.PANEL, S.MEMBERS, S.SCENARIOS[:1]
    )
    return rounded(lines.select("member", "decision_ns", "contract_id", "weight", "previous"), 9)


@query("c11_turnover", with_views("bars_type", "funding_type", "decisions", more=EPISODE_SQL) + """
SELECT member, decision_ns, round(sum(turnover), 9) AS turnover FROM lines WHERE scenario = 'base' GROUP BY ALL""")
def c11(t):
    _, lines = momentum.momentum_episodes(
        t.bars(), plain_calendar(t.decisions), S.PANEL, S.MEMBERS, S.SCENARIOS[:1]
    )
    return rounded(lines.groupBy("member", "decision_ns").agg(F.sum("turnover").alias("turnover")), 9)


@query("l02_calendar_bounds", with_views("decisions", more=P.bounds()) + "SELECT * FROM bounds")
def l02(t):
    return walkforward.calendar_bounds(walkforward.rebalance_samples(t.decisions, holding_days=7), S.GEOMETRY)


@query("l03_rebalance_calendar", with_views("bars_brand") + """
SELECT DISTINCT close_time_ns AS decision_ns FROM bars_brand WHERE (open_time_ns // 86400000000000) % 7 = 3""")
def l03(t):
    return universe.rebalance_calendar(t.bars("p_brand"))


MEMBERSHIP_SQL = " UNION ALL ".join(
    f"""SELECT fold_index, '{p}' AS "partition", 'XV:' || decision_ns || ':w1' AS sample_id, decision_ns,
  decision_ns + 604800000000000 AS label_end_ns FROM folds JOIN decisions
  ON decision_ns >= {p}_start_ns AND decision_ns < {p}_end_ns AND decision_ns + 604800000000000 < {p}_end_ns"""
    for p in walkforward.PARTITIONS
)


@query("l01_fold_membership", with_views("decisions", more=P.folds()) + MEMBERSHIP_SQL)
def l01(t):
    samples = walkforward.rebalance_samples(t.decisions, holding_days=7)
    return walkforward.fold_membership(samples, walkforward.calendar_bounds(samples, S.GEOMETRY), S.GEOMETRY)


@query("l04_fold_manifest", with_views("decisions", more=P.folds()) + """
SELECT f.*, count(d.decision_ns) AS test_samples FROM folds f LEFT JOIN fold_days d USING (fold_index) GROUP BY ALL""")
def l04(t):
    samples = walkforward.rebalance_samples(t.decisions, holding_days=7)
    bounds = walkforward.calendar_bounds(samples, S.GEOMETRY)
    members = walkforward.fold_membership(samples, bounds, S.GEOMETRY).filter(F.col("partition") == "test")
    sizes = members.groupBy("fold_index").agg(F.count("*").alias("test_samples"))
    return walkforward.fold_table(bounds, S.GEOMETRY).join(sizes, "fold_index", "left").fillna(0, ["test_samples"])
