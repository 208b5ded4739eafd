"""The holdout job over the momentum family: the candidate of the fold reports, confirmed or not."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog import panelsql as P
from tidepanel.catalog import settings as S
from tidepanel.catalog.q_accounting import FUNDED, NAMES, daily_bars
from tidepanel.catalog.q_decisions import MEMBER_LIST, MEMBER_NAMES, d28
from tidepanel.catalog.registry import ORACLES, query, rounded
from tidepanel.catalog.reports import reports
from tidepanel.catalog.sqlviews import WEEK, with_views
from tidepanel.plans import holdout
from tidepanel.session import scratch_path

DAYS = S.PANEL.holding_days
HOLDOUT_SQL = {
    **P.bounds(),
    "days": f"""
    SELECT decision_ns, decision_ns + {WEEK} <= (SELECT last_ns FROM bounds) AS priced,
      row_number() OVER (ORDER BY decision_ns) AS ordinal FROM decisions WHERE decision_ns >= (SELECT holdout_start_ns FROM bounds)""",
    "bars_held": f"SELECT * FROM bars_type WHERE available_time_ns < (SELECT max(decision_ns) FROM days WHERE priced) + {WEEK + 2}",
    **P.momentum(bars="bars_held"),
    "calendar": """
    SELECT decision_ns, ordinal, decision_ns NOT IN (SELECT decision_ns FROM universe) AS skipped FROM days WHERE priced""",
    **{k: v.replace("bars_type", "bars_held") for k, v in FUNDED.items()},
    **P.episodes(bars="bars_held", settlements="settlements"),
    **P.grid(NAMES),
    "t": """
    SELECT member, sum(CASE WHEN scenario = 'base' THEN net_return END) AS base_total,
      sum(CASE WHEN scenario = 'adverse' THEN net_return END) AS adverse_total, count_if(scenario = 'base') AS episodes,
      max(CASE WHEN scenario = 'base' THEN net_return END) AS top, count_if(scenario = 'base' AND net_return > 0) AS won,
      CAST(sum(CASE WHEN scenario = 'base' THEN forced_close_count END) AS BIGINT) AS forced_closes FROM grid_episodes GROUP BY ALL""",
    "c": """SELECT member, max(net) AS mc FROM (SELECT member, contract_id, sum(net) AS net FROM lines
      WHERE scenario = 'base' GROUP BY ALL) GROUP BY ALL""",
    "x": """
    SELECT member, sum(abs(l.weight) * (fee + CASE WHEN coalesce(u.tier, 2) = 1 THEN slip1 ELSE slip2 END) / 10000) AS exit_cost
    FROM lines l LEFT JOIN universe u ON u.decision_ns = l.decision_ns AND u.contract_id = l.contract_id
    JOIN scenarios s ON s.scenario = l.scenario
    WHERE l.scenario = 'adverse' AND l.weight <> 0 AND l.decision_ns = (SELECT max(decision_ns) FROM lines) GROUP BY ALL""",
    "judged": f"""
    SELECT t.*, coalesce(exit_cost, 0) AS exit_cost, adverse_total - coalesce(exit_cost, 0) AS after,
      CASE WHEN base_total > 0 THEN coalesce(top, 0) / base_total ELSE 0 END AS es,
      CASE WHEN base_total > 0 THEN coalesce(mc, 0) / base_total ELSE 0 END AS cs,
      (SELECT count(*) FROM calendar WHERE skipped) AS skipped FROM t LEFT JOIN c USING (member) LEFT JOIN x USING (member)
    WHERE member IN ({MEMBER_LIST})""",
    "gated": """
    SELECT *, base_total > 0 AS base_total_positive, after >= 0 AS adverse_after_exit_non_negative,
      base_total > (SELECT base_total FROM t WHERE member = 'no_trade') AS base_dominates_no_trade,
      base_total > (SELECT base_total FROM t WHERE member = 'random_ranks') AS base_dominates_random,
      after >= (SELECT adverse_total FROM t WHERE member = 'random_ranks') AS adverse_dominates_random,
      es <= 0.4 AS episode_share_within_limit, cs <= 0.4 AS contract_share_within_limit, skipped <= 4 AS skipped_within_limit FROM judged""",
}
GATES = (
    "base_total_positive", "adverse_after_exit_non_negative", "base_dominates_no_trade", "base_dominates_random",
    "adverse_dominates_random", "episode_share_within_limit", "contract_share_within_limit", "skipped_within_limit",
)
VIEWS = ("bars_type", "funding_type", "decisions")


def job(t):
    """Calendar, episodes and lines of the holdout, written once for the queries on them."""
    calendar = holdout.holdout_calendar(t.decisions, S.GEOMETRY, DAYS)
    build = lambda: holdout.evaluate(daily_bars(t), t.funding(), calendar, S.PANEL, S.MEMBERS, S.SCENARIOS)
    return calendar, *reports(t, ["holdout-rows", "holdout-lines"], build)


def judged(t):
    calendar, rows, lines = job(t)
    return holdout.confirmation(rows, lines, calendar, S.SCENARIOS, MEMBER_NAMES)


@query("d29_holdout_confirmation", with_views(*VIEWS, more=HOLDOUT_SQL) + f"""
SELECT member, {', '.join(GATES)}, {' AND '.join(GATES)} AS confirmed FROM gated""")
def d29(t):
    """The gates of every member, had it been the candidate."""
    return judged(t).select("member", *GATES, (F.col("verdict") == "holdout_confirmed").alias("confirmed"))


@query("p09_holdout", with_views(*VIEWS, more={**HOLDOUT_SQL, "candidate": ORACLES["d28_best_candidate_after_exit"]}) + f"""
SELECT member, episodes, skipped, round(base_total, 9) AS base_total, round(adverse_total, 9) AS adverse_total, round(exit_cost, 9) AS exit_cost,
  round(after, 9) AS adverse_after_exit, round(es, 8) AS episode_share, round(cs, 8) AS contract_share, {', '.join(GATES)},
  CASE WHEN {' AND '.join(GATES)} THEN 'holdout_confirmed' ELSE 'holdout_failed' END AS verdict,
  round(base_total / episodes, 9) AS base_mean, round(won / episodes, 9) AS positive_week_fraction, forced_closes
FROM gated JOIN candidate USING (member)""")
def p09(t):
    """The one member that the fold reports lead to, read on the holdout and sealed."""
    candidate = d28(t).select("member")
    result = judged(t).join(candidate, "member", "left_semi")
    shares = ["episode_share", "contract_share"]
    out = rounded(rounded(result, 8, shares), 9, [c for c, kind in result.dtypes if kind == "double" and c not in shares])
    return holdout.publish_once(out, scratch_path(t.spark, "holdout"))


@query("c21b_holdout_opening_gates", with_views(*VIEWS, more={k: HOLDOUT_SQL[k] for k in ("bounds", "days")} | {
    "e": f"SELECT max(decision_ns) + {WEEK} AS exit_close_ns FROM days WHERE priced",
    "reached": "SELECT strftime(make_timestamp(min(m) // 1000), '%Y-%m') AS covered_month FROM (SELECT max(open_time_ns) AS m FROM bars_type UNION ALL SELECT max(calc_time_ns) FROM funding_type)"}) + """
SELECT exit_close_ns, EXISTS (SELECT 1 FROM bars_type WHERE close_time_ns = exit_close_ns) AS exit_priced, covered_month,
  covered_month >= strftime(make_timestamp((exit_close_ns - 1) // 1000), '%Y-%m') AS month_covered FROM e, reached""")
def c21b(t):
    """Both gates before a holdout is opened: a bar at the last exit close, and its month reached in every kind of data."""
    calendar = holdout.holdout_calendar(t.decisions, S.GEOMETRY, DAYS)
    month = lambda ns: F.date_format(F.timestamp_micros((ns / F.lit(1000)).cast("long")), "yyyy-MM")
    bars = t.bars()
    reached = bars.agg(F.max("open_time_ns").alias("m")).unionByName(t.funding().agg(F.max("calc_time_ns").alias("m"))).select(F.min("m")).scalar()
    gate = holdout.exit_bars(bars, calendar, DAYS).withColumn("covered_month", month(reached))
    return gate.withColumn("month_covered", F.col("covered_month") >= month(F.col("exit_close_ns") - 1))
