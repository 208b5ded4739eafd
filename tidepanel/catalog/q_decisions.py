"""Pooling, significance and decisions over written fold reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.catalog import panelsql as P
from tidepanel.catalog import settings as S
from tidepanel.catalog.q_accounting import FOLD_SQL, fold_rows
from tidepanel.catalog.q_samples import SIGNALS_SQL, SPREAD_BPS, bar_samples, bootstrap_sql
from tidepanel.catalog.registry import query, rounded
from tidepanel.catalog.reports import report, reports
from tidepanel.catalog.sqlviews import with_views
from tidepanel.catalog.tables import Tables
from tidepanel.operators import decisions, pooling, stats, walkforward
from tidepanel.plans.momentum import CONTROLS

MEMBER_NAMES = [m.name for m in S.MEMBERS]
MEMBER_LIST = ", ".join(f"'{n}'" for n in MEMBER_NAMES)
BOOT = dict(block=4, repetitions=200, seed=17)
REPORT_SQL = {
    **FOLD_SQL,
    "report": f"SELECT *, member IN ({MEMBER_LIST}) AND positions = 0 AS held_nothing FROM grid_episodes",
    "targets": """
    SELECT *, coalesce(min(CASE WHEN NOT held_nothing THEN ordinal END) OVER (PARTITION BY member, scenario, fold_index
        ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      max(CASE WHEN NOT held_nothing THEN ordinal END) OVER (PARTITION BY member, scenario, fold_index)) AS target
    FROM report""",
    "pooled": """
    SELECT member, scenario, fold_index, max(CASE WHEN NOT held_nothing THEN decision_ns END) AS decision_ns,
      sum(net_return) AS net_return, sum(turnover) AS turnover,
      max(CASE WHEN NOT held_nothing THEN gross_exposure END) AS gross_exposure
    FROM targets WHERE target IS NOT NULL GROUP BY member, scenario, fold_index, target""",
    "totals": """
    SELECT member, scenario, fold_index, sum(net_return) AS fold_total, count_if(NOT held_nothing) AS retained,
      count_if(held_nothing) AS held_nothing, sum(forced_close_count) AS forced_close_count
    FROM report GROUP BY ALL""",
}
VIEWS = ("bars_type", "funding_type", "decisions")


def fold_reports(t: Tables) -> list[DataFrame]:
    return reports(t, ["fold-report", "fold-lines"], lambda: fold_rows(t))


def fold_report(t: Tables) -> DataFrame:
    return fold_reports(t)[0]


def fold_lines(t: Tables) -> DataFrame:
    return fold_reports(t)[1]


def pooled(t: Tables) -> DataFrame:
    return pooling.pool_episodes(fold_report(t))


@query("d09_held_nothing_pooling", with_views(*VIEWS, more=REPORT_SQL) + """
SELECT member, scenario, fold_index, decision_ns, round(net_return, 9) AS net_return, round(turnover, 9) AS turnover,
  round(gross_exposure, 9) AS gross_exposure FROM pooled""")
def d09(t):
    return rounded(pooled(t).drop("net_exposure"), 9)


@query("d37_folds_without_retained", with_views(*VIEWS, more=REPORT_SQL) + """
SELECT member, scenario, fold_index, retained, held_nothing, retained = 0 AS empty_fold FROM totals""")
def d37(t):
    out = pooling.fold_totals(fold_report(t))
    return out.select(
        "member", "scenario", "fold_index", "retained", "held_nothing", (F.col("retained") == 0).alias("empty_fold")
    )


@query("d04_maximum_drawdown", with_views(*VIEWS, more={**REPORT_SQL, "path": """
    SELECT *, product(1 + net_return / 100) OVER (PARTITION BY member, scenario ORDER BY decision_ns
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM pooled""",
    "peaks": """
    SELECT *, greatest(1, max(equity) OVER (PARTITION BY member, scenario ORDER BY decision_ns
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM path"""}) + """
SELECT member, scenario, round(max((peak - equity) / peak), 8) AS maximum_drawdown FROM peaks GROUP BY ALL""")
def d04(t):
    # A hundredth of capital per book: these synthetic prices can lose more than all of it.
    sized = pooled(t).withColumn("net_return", F.col("net_return") / 100)
    return rounded(stats.maximum_drawdown(sized, ["member", "scenario"], "decision_ns"), 8)


@query("d05_mean_median_win_rate", with_views(*VIEWS, more=REPORT_SQL) + """
SELECT member, scenario, count(*) AS episodes, round(avg(net_return), 9) AS mean, round(median(net_return), 9) AS median,
  round(avg(CASE WHEN net_return > 0 THEN 1 ELSE 0 END), 9) AS win_rate FROM pooled GROUP BY ALL""")
def d05(t):
    return rounded(stats.summary(pooled(t), ["member", "scenario"]), 9)


@query("d07_sharpe", with_views(*VIEWS, more=REPORT_SQL) + """
SELECT member, scenario, count(*) AS episodes, round(CASE WHEN stddev_samp(net_return) <> 0 THEN avg(net_return) / stddev_samp(net_return) END, 8) AS sharpe,
  round(CASE WHEN stddev_samp(net_return) <> 0 THEN avg(net_return) / stddev_samp(net_return) * sqrt(52) END, 8) AS annualised_sharpe
FROM pooled GROUP BY ALL""")
def d07(t):
    return rounded(stats.sharpe(pooled(t), ["member", "scenario"]), 8)


@query("d08_deflated_sharpe")
def d08(t):
    chosen = pooled(t).filter(F.col("member").isin(*MEMBER_NAMES))
    return rounded(stats.deflated_sharpe(chosen, ["scenario"], "member"), 8)


@query("d10_concentration", with_views(*VIEWS, more={**REPORT_SQL,
    "f": "SELECT member, sum(fold_total) AS base_total, max(fold_total) AS mf FROM totals WHERE scenario = 'base' GROUP BY ALL",
    "c": """SELECT member, max(net) AS mc FROM (SELECT member, contract_id, sum(net) AS net FROM lines
      WHERE scenario = 'base' GROUP BY ALL) GROUP BY ALL""",
    "e": "SELECT member, max(net_return) AS me FROM pooled WHERE scenario = 'base' GROUP BY ALL"}) + """
SELECT member, round(base_total, 9) AS base_total, round(CASE WHEN base_total > 0 THEN coalesce(mf, 0) / base_total END, 8) AS largest_fold_share,
  round(CASE WHEN base_total > 0 THEN coalesce(mc, 0) / base_total END, 8) AS largest_contract_share,
  round(CASE WHEN base_total > 0 THEN coalesce(me, 0) / base_total END, 8) AS largest_episode_share
FROM f LEFT JOIN c USING (member) LEFT JOIN e USING (member)""")
def d10(t):
    out = pooling.concentration(pooled(t), pooling.fold_totals(fold_report(t)), fold_lines(t))
    return rounded(rounded(out, 9, ["base_total"]), 8, [c for c in out.columns if c.endswith("share")])


def member_metrics(t: Tables) -> DataFrame:
    """One row of pooled metrics per family member."""
    series = pooled(t)
    totals = pooling.fold_totals(fold_report(t))
    chosen = F.col("member").isin(*MEMBER_NAMES)
    base, adverse = (F.col("scenario") == s for s in ("base", "adverse"))
    tests = stats.bootstrap_test(
        series.filter(base & chosen), ["member"], "decision_ns", **BOOT
    ).drop("n", "observed_mean").withColumn("family", F.lit("momentum"))
    ranked = stats.benjamini_hochberg(tests, ["family"], "member").drop("family")
    sums = totals.groupBy("member").agg(
        F.sum(F.when(base, F.col("fold_total"))).alias("_base"),
        F.sum(F.when(adverse, F.col("fold_total"))).alias("adverse_total"),
        F.count_if(base & (F.col("fold_total") > 0)).alias("positive_folds"),
        F.countDistinct("fold_index").alias("fold_count"),
        F.sum(F.when(base, F.col("retained"))).alias("episodes"),
        F.sum(F.when(adverse, F.col("retained"))).alias("_adverse_episodes"),
    )
    controls = sums.filter(~chosen)
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n)).otherwise(0.0)
    return (
        sums.filter(chosen)
        .withColumns({"base_mean": mean("_base", "episodes"), "adverse_mean": mean("adverse_total", "_adverse_episodes")})
        .withColumn("strongest_base", controls.select(F.max("_base")).scalar())
        .withColumn("strongest_adverse", controls.select(F.max("adverse_total")).scalar())
        .drop("_base", "_adverse_episodes")
        .join(pooling.concentration(series, totals, fold_lines(t)), "member")
        .join(ranked, "member", "left")
    )


GATES = decisions.GateRules()
METRICS_SQL = {
    **REPORT_SQL,
    "series": f"""
    SELECT member, net_return, row_number() OVER (PARTITION BY member ORDER BY decision_ns) - 1 AS at,
      count(*) OVER (PARTITION BY member) AS n FROM pooled WHERE scenario = 'base' AND member IN ({MEMBER_LIST})""",
    **bootstrap_sql("series", "member", **BOOT),
    "q": """SELECT member, lower, p_value, least(1, min(p_value * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value
      FROM (SELECT *, row_number() OVER (ORDER BY p_value, member) AS rk, count(*) OVER () AS m FROM boot_test)""",
    "sums": """SELECT member, sum(CASE WHEN scenario = 'base' THEN fold_total END) AS base_total,
      sum(CASE WHEN scenario = 'adverse' THEN fold_total END) AS adverse_total,
      count_if(scenario = 'base' AND fold_total > 0) AS positive_folds, count(DISTINCT fold_index) AS fold_count,
      CAST(sum(CASE WHEN scenario = 'base' THEN retained END) AS BIGINT) AS episodes FROM totals GROUP BY ALL""",
    "c": """SELECT member, max(net) AS mc FROM (SELECT member, contract_id, sum(net) AS net FROM lines
      WHERE scenario = 'base' GROUP BY ALL) GROUP BY ALL""",
    "big": """SELECT member, max(CASE WHEN scenario = 'base' THEN fold_total END) AS mf FROM totals GROUP BY ALL""",
    "e": "SELECT member, max(net_return) AS me FROM pooled WHERE scenario = 'base' GROUP BY ALL",
    "metrics": f"""
    SELECT s.*, q.lower, q.p_value, q.q_value, greatest(mf, mc, me) / base_total AS share,
      (SELECT max(base_total) FROM sums WHERE member NOT IN ({MEMBER_LIST})) AS strongest_base,
      (SELECT max(adverse_total) FROM sums WHERE member NOT IN ({MEMBER_LIST})) AS strongest_adverse
    FROM sums s LEFT JOIN q USING (member) LEFT JOIN c USING (member) LEFT JOIN big USING (member)
    LEFT JOIN e USING (member) WHERE s.member IN ({MEMBER_LIST})""",
    "decided": f"""
    SELECT *, list_filter([CASE WHEN episodes < {GATES.episode_floor} THEN 'EPISODE_FLOOR_NOT_MET' END,
        CASE WHEN p_value IS NULL THEN 'BOOTSTRAP_NOT_AVAILABLE' END], lambda x: x IS NOT NULL) AS evidence,
      list_filter([CASE WHEN base_total <= 0 THEN 'AGGREGATE_BASE_NET_NON_POSITIVE' END,
        CASE WHEN lower <= 0 THEN 'BASE_LOWER_BOUND_NON_POSITIVE' END,
        CASE WHEN adverse_total < 0 THEN 'AGGREGATE_ADVERSE_NET_NON_POSITIVE' END,
        CASE WHEN positive_folds < (2 * fold_count + 2) // 3 THEN 'POSITIVE_FOLD_FRACTION_NOT_MET' END,
        CASE WHEN q_value > 0.10 THEN 'MULTIPLE_TESTING_GATE_NOT_MET' END,
        CASE WHEN base_total > 0 AND share > {GATES.concentration_limit} THEN 'CONCENTRATION_LIMIT_EXCEEDED' END,
        CASE WHEN base_total <= strongest_base THEN 'BASE_CONTROL_DOMINANCE_NOT_MET' END,
        CASE WHEN adverse_total <= strongest_adverse THEN 'ADVERSE_CONTROL_DOMINANCE_NOT_MET' END],
        lambda x: x IS NOT NULL) AS economic FROM metrics""",
}
DECIDED = "CASE WHEN len(evidence) > 0 THEN 'insufficient_evidence' WHEN len(economic) > 0 THEN 'rejected' ELSE 'eligible_for_further_review' END"


@query("d11_member_gates", with_views(*VIEWS, more=METRICS_SQL) + f"""
SELECT member, episodes, positive_folds, round(base_total, 9) AS base_total, round(q_value, 9) AS q_value,
  {DECIDED} AS decision_status, array_to_string(list_concat(evidence, economic), ',') AS reason_codes FROM decided""")
def d11(t):
    out = decisions.member_decisions(member_metrics(t), GATES)
    return rounded(
        out.select(
            "member", "episodes", "positive_folds", "base_total", "q_value", "decision_status",
            F.array_join("reason_codes", ",").alias("reason_codes"),
        ), 9,
    )


@query("d12_family_decision", with_views(*VIEWS, more=METRICS_SQL) + f"""
SELECT count(*) AS members, max(fold_count) AS fold_count, count_if({DECIDED} = 'eligible_for_further_review') AS eligible,
  coalesce(string_agg(CASE WHEN {DECIDED} = 'eligible_for_further_review' THEN member END, ',' ORDER BY member), '') AS eligible_members,
  CASE WHEN count_if({DECIDED} = 'eligible_for_further_review') > 0 THEN 'eligible_candidate_available'
    ELSE 'no_eligible_candidate' END AS family_status FROM decided""")
def d12(t):
    decided = decisions.member_decisions(member_metrics(t), GATES)
    eligible = F.col("decision_status") == decisions.ELIGIBLE
    return decided.agg(
        F.count("*").alias("members"), F.max("fold_count").alias("fold_count"),
        F.count_if(eligible).alias("eligible"),
        F.array_join(F.array_sort(F.collect_list(F.when(eligible, F.col("member")))), ",").alias("eligible_members"),
        F.when(F.count_if(eligible) > 0, "eligible_candidate_available")
        .otherwise("no_eligible_candidate").alias("family_status"),
    )


EXTRAS = ("turnover", "turnover_cost", "funding_cost")


@query("d34_extras_means", with_views(*VIEWS, more=REPORT_SQL) + "\nUNION ALL ".join(
    f"SELECT member, '{x}' AS extra, round(avg({x}), 9) AS mean FROM report WHERE scenario = 'base' AND NOT held_nothing GROUP BY ALL"
    for x in EXTRAS))
def d34(t):
    kept = fold_report(t).filter((F.col("scenario") == "base") & ~F.col("held_nothing"))
    long = kept.select("member", *EXTRAS).unpivot(["member"], list(EXTRAS), "extra", "value")
    return rounded(long.groupBy("member", "extra").agg(F.avg("value").alias("mean")), 9)


@query("d30_running_totals", with_views(*VIEWS, more=REPORT_SQL) + """
SELECT member, scenario, round(sum(net_return), 9) AS total, round(sum(CASE WHEN decision_ns < last_ns THEN net_return ELSE 0 END), 9) AS total_before_last,
  count_if(decision_ns < last_ns) AS episodes_before_last
FROM (SELECT *, max(decision_ns) OVER () AS last_ns FROM report) GROUP BY ALL""")
def d30(t):
    rows = fold_report(t)
    before = F.col("decision_ns") < rows.select(F.max("decision_ns")).scalar()
    return rounded(
        rows.withColumn("_before", before).groupBy("member", "scenario").agg(
            F.sum("net_return").alias("total"),
            F.sum(F.when(F.col("_before"), F.col("net_return")).otherwise(0.0)).alias("total_before_last"),
            F.count_if("_before").alias("episodes_before_last"),
        ), 9,
    )


@query("d18_final_exit_cost", with_views(*VIEWS, more={**REPORT_SQL, "last": """
    SELECT fold_index, max(decision_ns) AS decision_ns FROM calendar WHERE NOT skipped GROUP BY ALL"""}) + """
SELECT l.fold_index, l.member, c.scenario, round(sum(abs(l.weight) * (fee + CASE WHEN coalesce(u.tier, 2) = 1 THEN slip1 ELSE slip2 END) / 10000), 9) AS exit_cost
FROM lines l JOIN last USING (fold_index, decision_ns) LEFT JOIN universe u ON u.decision_ns = l.decision_ns AND u.contract_id = l.contract_id
JOIN scenarios c ON c.scenario = l.scenario WHERE l.weight <> 0 GROUP BY ALL""")
def d18(t):
    from pyspark.sql import Window as W

    from tidepanel.operators import accounting

    lines = fold_lines(t)
    last = F.max("decision_ns").over(W.partitionBy("fold_index"))
    cost = accounting.scenario_column(S.SCENARIOS)
    held = lines.withColumn("_last", last).filter((F.col("decision_ns") == F.col("_last")) & (F.col("weight") != 0))
    priced = held.withColumn("cost", F.element_at(F.filter(cost, lambda c: c["scenario"] == F.col("scenario")), 1))
    return rounded(
        priced.groupBy("fold_index", "member", "scenario").agg(
            F.sum(F.abs("weight") * accounting.per_side_bps() / accounting.BPS).alias("exit_cost")
        ), 9,
    )


@query("d28_best_candidate_after_exit", with_views(*VIEWS, more={**REPORT_SQL, "last": """
    SELECT fold_index, max(decision_ns) AS decision_ns FROM calendar WHERE NOT skipped GROUP BY ALL""",
    "exits": """
    SELECT member, sum(abs(l.weight) * (fee + CASE WHEN coalesce(u.tier, 2) = 1 THEN slip1 ELSE slip2 END) / 10000) AS cost
    FROM lines l JOIN last USING (fold_index, decision_ns) LEFT JOIN universe u ON u.decision_ns = l.decision_ns AND u.contract_id = l.contract_id
    JOIN scenarios c ON c.scenario = l.scenario WHERE l.scenario = 'adverse' GROUP BY ALL""",
    "scores": f"""
    SELECT member, sum(fold_total) - coalesce(any_value(cost), 0) AS score, list_position([{MEMBER_LIST}], member) AS declared
    FROM totals LEFT JOIN exits USING (member) WHERE scenario = 'adverse' AND member IN ({MEMBER_LIST}) GROUP BY member"""}) + """
SELECT member, round(score, 9) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, declared) AS rk FROM scores) WHERE rk = 1""")
def d28(t):
    exits = d18(t).filter(F.col("scenario") == "adverse").groupBy("member").agg(F.sum("exit_cost").alias("_cost"))
    declared = F.array_position(F.array(*[F.lit(n) for n in MEMBER_NAMES]), F.col("member"))
    scores = (
        pooling.fold_totals(fold_report(t))
        .filter((F.col("scenario") == "adverse") & F.col("member").isin(*MEMBER_NAMES))
        .groupBy("member").agg(F.sum("fold_total").alias("_total")).join(exits, "member", "left")
        .withColumn("score", F.col("_total") - F.coalesce("_cost", F.lit(0.0)))
    )
    return rounded(scores.orderBy(F.desc("score"), declared).limit(1).select("member", "score"), 9)


@query("g04_fold_set_audit", with_views(*VIEWS, more=REPORT_SQL) + """
SELECT fold_index, 'missing' AS problem FROM (SELECT fold_index FROM folds EXCEPT SELECT CASE WHEN fold_index = 1 THEN 99 ELSE fold_index END FROM report)
UNION ALL SELECT fold_index, 'unexpected' FROM (SELECT CASE WHEN fold_index = 1 THEN 99 ELSE fold_index END AS fold_index FROM report EXCEPT SELECT fold_index FROM folds)""")
def g04(t):
    samples = walkforward.rebalance_samples(t.decisions, holding_days=7)
    expected = walkforward.fold_table(walkforward.calendar_bounds(samples, S.GEOMETRY), S.GEOMETRY).select("fold_index")
    # Fold 1's report is filed under a fold that does not exist.
    filed = F.when(F.col("fold_index") == 1, 99).otherwise(F.col("fold_index")).alias("fold_index")
    actual = fold_report(t).select(filed).distinct()
    return expected.subtract(actual).withColumn("problem", F.lit("missing")).unionByName(
        actual.subtract(expected).withColumn("problem", F.lit("unexpected"))
    )


@query("c20_report_agreement", with_views(*VIEWS, more=REPORT_SQL) + """
SELECT 'candidates' AS field, count(DISTINCT c) AS distinct_values FROM (SELECT fold_index, string_agg(DISTINCT member, ',' ORDER BY member) AS c FROM report WHERE fold_index <> 1 OR member <> 'no_trade' GROUP BY ALL)
UNION ALL SELECT 'scenarios', count(DISTINCT s) FROM (SELECT fold_index, string_agg(DISTINCT scenario, ',' ORDER BY scenario) AS s FROM report GROUP BY ALL)""")
def c20(t):
    listing = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    # One report lacks a control.
    told = F.when((F.col("fold_index") != 1) | (F.col("member") != "no_trade"), F.col("member"))
    reports = fold_report(t).groupBy("fold_index").agg(
        listing(told).alias("candidates"), listing("scenario").alias("scenarios")
    )
    return decisions.disagreements(reports, ["candidates", "scenarios"])


@query("d29b_test_fold_confirmation", with_views(*VIEWS, more={**METRICS_SQL,
    "h": f"""SELECT m.member, m.base_total, m.adverse_total, m.episodes, mc, me,
      (SELECT base_total FROM sums WHERE member = 'no_trade') AS idle_base,
      (SELECT base_total FROM sums WHERE member = 'random_ranks') AS random_base,
      (SELECT adverse_total FROM sums WHERE member = 'random_ranks') AS random_adverse,
      (SELECT count(*) FROM calendar WHERE skipped) AS skipped
    FROM metrics m LEFT JOIN c USING (member) LEFT JOIN e USING (member)"""}) + """
SELECT member, base_total > 0 AS base_total_positive, adverse_total >= 0 AS adverse_non_negative,
  base_total > idle_base AS dominates_no_trade, base_total > random_base AS dominates_random,
  adverse_total >= random_adverse AS adverse_dominates_random,
  CASE WHEN base_total > 0 THEN me / base_total ELSE 0 END <= 0.4 AS episode_share_within_limit,
  CASE WHEN base_total > 0 THEN mc / base_total ELSE 0 END <= 0.4 AS contract_share_within_limit,
  skipped <= 4 AS skipped_within_limit FROM h""")
def d29b(t):
    m = member_metrics(t)
    sums = pooling.fold_totals(fold_report(t)).groupBy("member", "scenario").agg(F.sum("fold_total").alias("v"))
    of = lambda member, scenario: sums.filter(
        (F.col("member") == member) & (F.col("scenario") == scenario)
    ).select("v").scalar()
    samples = walkforward.rebalance_samples(t.decisions, holding_days=7)
    calendar = walkforward.test_calendar(
        walkforward.fold_membership(samples, walkforward.calendar_bounds(samples, S.GEOMETRY), S.GEOMETRY)
    )
    live = fold_report(t).select("decision_ns").distinct()
    skipped = calendar.join(live, "decision_ns", "left_anti").select(F.count("*")).scalar()
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) <= 0.4
    return m.select(
        "member",
        (F.col("base_total") > 0).alias("base_total_positive"),
        (F.col("adverse_total") >= 0).alias("adverse_non_negative"),
        (F.col("base_total") > of("no_trade", "base")).alias("dominates_no_trade"),
        (F.col("base_total") > of("random_ranks", "base")).alias("dominates_random"),
        (F.col("adverse_total") >= of("random_ranks", "adverse")).alias("adverse_dominates_random"),
        share("largest_episode_share").alias("episode_share_within_limit"),
        share("largest_contract_share").alias("contract_share_within_limit"),
        (skipped <= 4).alias("skipped_within_limit"),
    )


BAR = S.BAR_GEOMETRY
BAR_FOLD_SQL = {
    **SIGNALS_SQL,
    **P.folds(BAR, "(SELECT DISTINCT decision_ns FROM samples)"),
    "fold_net": f"""
    SELECT f.fold_index, n.* FROM (SELECT s.*, scenario, CASE WHEN signal = 0 THEN 0 ELSE signal * forward_return - cost END AS net_return
      FROM signals s CROSS JOIN (VALUES {', '.join(f"('{c.scenario}', {c.round_trip(SPREAD_BPS)!r}::DOUBLE)" for c in S.SIGNAL_COSTS)}) v(scenario, cost)) n
    JOIN folds f ON n.decision_ns >= test_start_ns AND n.decision_ns < test_end_ns AND label_available_ns < test_end_ns""",
    "cells": """
    SELECT fold_index, instrument_id, candidate, sum(CASE WHEN scenario = 'base' THEN net_return END) AS base_total,
      sum(CASE WHEN scenario = 'adverse' THEN net_return END) AS adverse_total,
      count_if(scenario = 'base' AND signal <> 0) AS trade_count FROM fold_net GROUP BY ALL""",
    "series": """
    SELECT fold_index, instrument_id, candidate, net_return, row_number() OVER w - 1 AS at,
      count(*) OVER (PARTITION BY fold_index, instrument_id, candidate) AS n FROM fold_net WHERE scenario = 'base' AND signal <> 0
    WINDOW w AS (PARTITION BY fold_index, instrument_id, candidate ORDER BY decision_ns)""",
    **bootstrap_sql("series", "fold_index, instrument_id, candidate", **BOOT),
    "tested": """
    SELECT c.*, b.lower, coalesce(b.p_value, 1) AS p_value FROM cells c LEFT JOIN boot_test b USING (fold_index, instrument_id, candidate)""",
    "evaluated": """
    SELECT *, least(1, min(p_value * m / rk) OVER (PARTITION BY fold_index, instrument_id ORDER BY rk
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value
    FROM (SELECT *, row_number() OVER (PARTITION BY fold_index, instrument_id ORDER BY p_value, candidate) AS rk,
      count(*) OVER (PARTITION BY fold_index, instrument_id) AS m FROM tested)""",
}


def bar_fold_samples(t: Tables, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples with their fold and partition, and the fold bounds."""
    labelled = rows.withColumn("label_end_ns", F.col("label_available_ns"))
    bounds = walkforward.calendar_bounds(labelled, BAR)
    members = walkforward.fold_membership(labelled, bounds, BAR).select("fold_index", "partition", "sample_id")
    return labelled.join(members, "sample_id"), bounds


def evaluated_folds(signals: DataFrame) -> DataFrame:
    """Signals on test rows by fold, instrument and candidate: totals, bootstrap and q-values."""
    net = stats.net_returns(signals, S.SIGNAL_COSTS, SPREAD_BPS)
    cell = ["fold_index", "instrument_id", "candidate"]
    base = F.col("scenario") == "base"
    totals = net.groupBy(*cell).agg(
        F.sum(F.when(base, F.col("net_return"))).alias("base_total"),
        F.sum(F.when(~base, F.col("net_return"))).alias("adverse_total"),
        F.count_if(base & (F.col("signal") != 0)).alias("trade_count"),
    )
    active = net.filter(base & (F.col("signal") != 0))
    tests = stats.bootstrap_test(active, cell, "decision_ns", **BOOT).select(*cell, "lower", "p_value")
    joined = totals.join(tests, cell, "left").withColumn("p_value", F.coalesce("p_value", F.lit(1.0)))
    return stats.benjamini_hochberg(joined, ["fold_index", "instrument_id"], "candidate")


def bar_fold_evaluation(t: Tables) -> DataFrame:
    """Baselines per fold and instrument: totals, bootstrap, q-values, decision."""
    def build() -> DataFrame:
        rows, _ = bar_fold_samples(t, bar_samples(t))
        return evaluated_folds(stats.baseline_signals(rows.filter(F.col("partition") == "test"), seed=S.PANEL.random_seed))

    return report(t, "bar-folds", build)


@query("p11_baseline_fold_evaluation", with_views("hour_bars", more=BAR_FOLD_SQL) + """
SELECT fold_index, instrument_id, candidate, trade_count, round(base_total, 9) AS base_total,
  round(adverse_total, 9) AS adverse_total, round(lower, 8) AS lower, round(p_value, 9) AS p_value,
  round(q_value, 9) AS q_value FROM evaluated""")
def p11(t):
    out = bar_fold_evaluation(t)
    return rounded(rounded(out, 8, ["lower"]), 9, ["base_total", "adverse_total", "p_value", "q_value"])


CANDIDATE_SQL = f"""
SELECT {{group}}candidate, CASE WHEN candidate = 'no_trade' THEN 'contextual_baseline'
    WHEN fold_count < {GATES.fold_floor} OR trade_count < {GATES.trade_floor} THEN 'insufficient_evidence'
    WHEN base_total <= 0 OR coalesce(lower, 0) <= 0 OR adverse_total <= 0 THEN 'rejected'
    ELSE 'eligible_for_further_review' END AS decision_status,
  concat_ws(',', CASE WHEN candidate <> 'no_trade' AND fold_count < {GATES.fold_floor} THEN 'FOLD_FLOOR_NOT_MET' END,
    CASE WHEN candidate <> 'no_trade' AND trade_count < {GATES.trade_floor} THEN 'EPISODE_FLOOR_NOT_MET' END,
    CASE WHEN candidate <> 'no_trade' AND base_total <= 0 THEN 'BASE_NET_NON_POSITIVE' END,
    CASE WHEN candidate <> 'no_trade' AND coalesce(lower, 0) <= 0 THEN 'BASE_LOWER_BOUND_NON_POSITIVE' END,
    CASE WHEN candidate <> 'no_trade' AND adverse_total <= 0 THEN 'ADVERSE_NET_NON_POSITIVE' END,
    CASE WHEN candidate = 'no_trade' THEN 'NON_PROMOTABLE_CONTEXT' END) AS reason_codes FROM {{rows}}"""


@query("d15_candidate_decision", with_views("hour_bars", more={**BAR_FOLD_SQL, "whole": "SELECT e.*, (SELECT max(fold_count) FROM bounds) AS fold_count FROM evaluated e"})
       + CANDIDATE_SQL.format(group="fold_index, instrument_id, ", rows="whole"))
def d15(t):
    _, bounds = bar_fold_samples(t, bar_samples(t))
    folds = bounds.agg(F.max("fold_count").alias("n")).scalar()
    rows = bar_fold_evaluation(t).withColumn("fold_count", folds)
    status, codes = decisions.candidate_decision(GATES, F.col("fold_count"))
    return rows.select("fold_index", "instrument_id", "candidate", status.alias("decision_status"), F.array_join(codes, ",").alias("reason_codes"))


@query("d15b_candidate_decision_by_fold", with_views("hour_bars", more={**BAR_FOLD_SQL, "single": "SELECT candidate, fold_index, count(*) AS fold_count, sum(trade_count) AS trade_count, sum(base_total) AS base_total, min(lower) AS lower, sum(adverse_total) AS adverse_total FROM (SELECT * FROM evaluated) GROUP BY ALL",
    "counted": "SELECT * REPLACE (1 AS fold_count) FROM single"}) + CANDIDATE_SQL.format(group="fold_index, ", rows="counted"))
def d15b(t):
    """One fold by itself, over all instruments: the fold floor is never met."""
    rows = bar_fold_evaluation(t).groupBy("fold_index", "candidate").agg(
        F.sum("trade_count").alias("trade_count"), F.sum("base_total").alias("base_total"), F.min("lower").alias("lower"),
        F.sum("adverse_total").alias("adverse_total"))
    status, codes = decisions.candidate_decision(GATES, F.lit(1))
    return rows.select("fold_index", "candidate", status.alias("decision_status"), F.array_join(codes, ",").alias("reason_codes"))


AGGREGATE_SQL = {
    **BAR_FOLD_SQL,
    "rolled": """
    SELECT candidate, count_if(base_total > 0) AS positive_folds, sum(base_total) AS base_total,
      sum(adverse_total) AS adverse_total, max(q_value) AS maximum_q_value,
      (SELECT max(fold_count) FROM bounds) AS fold_count FROM (
      SELECT fold_index, candidate, sum(base_total) AS base_total, sum(adverse_total) AS adverse_total,
        max(q_value) AS q_value FROM evaluated GROUP BY ALL) GROUP BY ALL""",
    "agg": """
    SELECT *, CASE WHEN candidate = 'no_trade' THEN 'NON_PROMOTABLE_CONTEXT' ELSE concat_ws(',',
      CASE WHEN positive_folds < (2 * fold_count + 2) // 3 THEN 'POSITIVE_FOLD_FRACTION_NOT_MET' END,
      CASE WHEN base_total <= 0 THEN 'AGGREGATE_BASE_NET_NON_POSITIVE' END,
      CASE WHEN adverse_total <= 0 THEN 'AGGREGATE_ADVERSE_NET_NON_POSITIVE' END,
      CASE WHEN maximum_q_value > 0.10 THEN 'MULTIPLE_TESTING_GATE_NOT_MET' END) END AS reason_codes FROM rolled""",
    "statused": """
    SELECT *, CASE WHEN candidate = 'no_trade' THEN 'contextual_baseline' WHEN reason_codes <> '' THEN 'rejected'
      ELSE 'eligible_for_further_review' END AS decision_status FROM agg""",
}


def bar_aggregate(t: Tables) -> DataFrame:
    folds = bar_fold_evaluation(t).groupBy("fold_index", "candidate").agg(
        F.sum("base_total").alias("base_total"), F.sum("adverse_total").alias("adverse_total"),
        F.max("q_value").alias("q_value"),
    )
    _, bounds = bar_fold_samples(t, bar_samples(t))
    return decisions.fold_aggregate(folds, bounds.select("fold_count").scalar(), GATES)


@query("d13_cross_fold_aggregate", with_views("hour_bars", more=AGGREGATE_SQL) + """
SELECT candidate, positive_folds, round(base_total, 9) AS base_total, round(adverse_total, 9) AS adverse_total,
  round(maximum_q_value, 9) AS maximum_q_value, reason_codes, decision_status FROM statused""")
def d13(t):
    return rounded(bar_aggregate(t).withColumn("reason_codes", F.array_join("reason_codes", ",")), 9)


@query("d14_model_dominance", with_views("hour_bars", more={**AGGREGATE_SQL, "m": """
    SELECT *, base_total - (SELECT base_total FROM statused WHERE candidate = 'no_trade') AS base_margin,
      adverse_total - (SELECT adverse_total FROM statused WHERE candidate = 'no_trade') AS adverse_margin FROM statused""",
    "d": """SELECT *, base_margin > 0 AND adverse_margin > 0 AND positive_folds >= 2 AND maximum_q_value <= 0.10
      AND decision_status = 'eligible_for_further_review' AS dominates_no_trade FROM m"""}) + """
SELECT candidate, round(base_margin, 9) AS base_margin, round(adverse_margin, 9) AS adverse_margin, dominates_no_trade,
  dominates_no_trade AND row_number() OVER (PARTITION BY dominates_no_trade ORDER BY base_total DESC, adverse_total DESC, candidate) = 1 AS strongest
FROM d""")
def d14(t):
    out = decisions.dominance(bar_aggregate(t), GATES)
    return rounded(out.select("candidate", "base_margin", "adverse_margin", "dominates_no_trade", "strongest"), 9)
