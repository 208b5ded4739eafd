"""Multi-week families: trend, funding cross-section and two-leg carry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog import panelsql as P
from tidepanel.catalog import settings as S
from tidepanel.catalog.q_accounting import EPISODE_COLUMNS
from tidepanel.catalog.q_windows import recursive, votes_sql
from tidepanel.catalog.registry import query, rounded
from tidepanel.catalog.reports import report
from tidepanel.catalog.sqlviews import WEEK, with_views
from tidepanel.operators import carry, funding, microstructure, universe, vectors, windows
from tidepanel.plans import families as J
from tidepanel.plans.momentum import CONTROLS
from tidepanel.session import staged

TREND = (J.TrendMember("ts_1w", "time_series"), J.TrendMember("xs_4w", "cross_sectional", 4))
FUNDING = (
    J.FundingMember("fx_1w", 1), J.FundingMember("fx_l4_h4", 4, 4), J.FundingMember("fx_l4_h4_exit", 4, 4, True),
)
LEG_RULES = universe.UniverseRules(30, 2, 0.0, 10**6, 1, 2)
CARRY = J.CarryRules(carry.PairRules(LEG_RULES, 2, 5, 2), carry.Selection(1, 2))
SLOTS = J.CarryRules(carry.PairRules(LEG_RULES, 2, 5, 2), carry.Selection(1, 2), slots=2)
CARRY_MEMBERS = (
    J.CarryMember("c_l2_h4", 2, 4), J.CarryMember("c_l2_h4_exit", 2, 4, True), J.CarryMember("c_l4_h8_hurdle", 4, 8, False, 0.05),
)
COSTS = (S.CARRY_BASE, S.CARRY_ADVERSE)


def warm_calendar(weeks: int, live: str) -> dict[str, str]:
    return {
        **P.folds(),
        "all_days": f"""
    SELECT fold_index, decision_ns, ordinal, false AS is_warm_up FROM fold_days UNION ALL
    SELECT fold_index, f - k * {WEEK}, 1 - k, true FROM (SELECT fold_index, min(decision_ns) AS f FROM fold_days GROUP BY ALL)
      CROSS JOIN (SELECT unnest(range(1, {weeks + 1})) AS k)""",
        "whole": f"""
    SELECT *, decision_ns NOT IN (SELECT decision_ns FROM {live}) AS skipped FROM all_days""",
        "calendar": "SELECT * FROM whole WHERE NOT is_warm_up",
    }


def cohort_sql(weekly: str, holds: dict[str, int]) -> dict[str, str]:
    hold = "CASE member " + " ".join(f"WHEN '{m}' THEN {h}" for m, h in holds.items()) + " ELSE 1 END"
    return {
        "weights": f"""
    SELECT fold_index, member, decision_ns, contract_id, sum(w / h) AS weight FROM (
      SELECT d.fold_index, v.member, d.decision_ns, v.contract_id, v.weight AS w, {hold} AS h
      FROM {weekly} v JOIN whole f ON f.decision_ns = v.decision_ns AND NOT f.skipped
      JOIN calendar d ON d.fold_index = f.fold_index AND NOT d.skipped AND d.decision_ns >= f.decision_ns
        AND d.decision_ns < f.decision_ns + ({hold}) * {WEEK}
      WHERE NOT EXISTS (SELECT 1 FROM calendar s WHERE s.fold_index = f.fold_index AND s.skipped
        AND s.decision_ns > f.decision_ns AND s.decision_ns <= d.decision_ns)) GROUP BY fold_index, member, decision_ns, contract_id
    HAVING abs(sum(w / h)) > 1e-15"""
    }


TREND_HOLDS = {m.name: m.hold_weeks for m in TREND}
TREND_SQL = {
    **P.universe(), **P.volatility(5), **votes_sql(S.SHORT_INDICATORS),
    "s": """
    SELECT u.decision_ns, 'ts_1w' AS member, u.contract_id, v.sigma,
      CASE WHEN t.score >= 0.25 THEN 1 WHEN t.score <= -0.25 THEN -1 ELSE 0 END AS sgn, t.score FROM universe u
    JOIN trend t ON t.contract_id = u.contract_id AND t.close_time_ns = u.decision_ns AND t.score IS NOT NULL
    JOIN volatility v ON v.contract_id = u.contract_id AND v.close_time_ns = u.decision_ns""",
    **P.inverse_vol("s"),
    "sx": "SELECT decision_ns, 'xs_4w' AS member, contract_id, score FROM s",
    "xs": P.quintile("sx"),
    **P.controls(),
    "weekly": " UNION ALL ".join(f"SELECT decision_ns, member, contract_id, weight FROM {x}" for x in ("xs", "capped", "passive", "random_ranks")),
    **warm_calendar(3, "universe"),
    **cohort_sql("weekly", TREND_HOLDS),
}
TREND_EPISODES = {**TREND_SQL, **P.episodes(folds=True), **P.grid([*TREND_HOLDS, *CONTROLS], folds=True)}


@query("c14_vector_cohort_book", recursive(with_views("bars_type", "decisions", more=TREND_SQL)) + """
SELECT fold_index, member, decision_ns, contract_id, round(weight, 9) AS weight FROM weights""")
def c14(t):
    bars = staged(t.bars(), "bars")
    eligible = staged(universe.select_universe(bars, S.UNIVERSE), "universe")
    calendar = staged(J.with_skips(J.fold_calendar(t.decisions, S.GEOMETRY, 3), eligible), "calendar")
    formed = J.in_folds(J.trend_vectors(bars, eligible, S.PANEL, TREND, S.SHORT_INDICATORS), calendar)
    return rounded(vectors.cohort_book(formed, calendar, TREND_HOLDS, J.BOOK), 9)


def trend_report(t):
    return report(t, "trend", lambda: J.trend_fold(
        t.bars(), t.decisions, S.PANEL, S.GEOMETRY, TREND, S.SHORT_INDICATORS, S.SCENARIOS
    ))


@query("p04_trend_family", recursive(with_views("bars_type", "decisions", more=TREND_EPISODES)) + f"""
SELECT fold_index, {EPISODE_COLUMNS} FROM grid_episodes""")
def p04(t):
    return rounded(trend_report(t).drop("ordinal"), 9)


@query("p03_vector_fold_totals", recursive(with_views("bars_type", "decisions", more=TREND_EPISODES)) + """
SELECT fold_index, member, scenario, count(*) AS episodes, round(sum(net_return), 9) AS net_return, round(sum(turnover), 9) AS turnover
FROM grid_episodes GROUP BY ALL""")
def p03(t):
    out = trend_report(t).groupBy("fold_index", "member", "scenario").agg(
        F.count("*").alias("episodes"), F.sum("net_return").alias("net_return"), F.sum("turnover").alias("turnover")
    )
    return rounded(out, 9)


@query("d38_signalled_and_abstained", recursive(with_views("bars_type", more=TREND_SQL)) + """
SELECT decision_ns, count_if(sgn <> 0) AS signalled, count_if(sgn = 0) AS abstained, round(avg(score), 9) AS mean_score FROM s GROUP BY ALL""")
def d38(t):
    bars = staged(t.bars(), "bars")
    scored = windows.annualised_volatility(windows.trend_score(bars, "score", S.SHORT_INDICATORS), 5).select(
        "contract_id", F.col("close_time_ns").alias("decision_ns"), "score"
    ).filter(F.col("score").isNotNull())
    rows = universe.select_universe(bars, S.UNIVERSE).join(scored, ["contract_id", "decision_ns"])
    strong = F.abs("score") >= 0.25
    return rounded(rows.groupBy("decision_ns").agg(
        F.count_if(strong).alias("signalled"), F.count_if(~strong).alias("abstained"), F.avg("score").alias("mean_score")
    ), 9)


LOOKBACKS = tuple(sorted({m.lookback_weeks for m in FUNDING}))


@query("d38b_funding_scores", with_views("bars_type", "funding_type", more={**P.universe(),
    "settled_weeks": f"""
    SELECT instrument_id, (calc_time_ns - 345600000000000 + {WEEK - 1}) // {WEEK} * {WEEK} + 345600000000000 AS week_ns, sum(rate) AS settled FROM funding_type GROUP BY ALL""",
    "eligible_contracts": "SELECT DISTINCT u.decision_ns, u.contract_id, b.instrument_id FROM universe u JOIN (SELECT DISTINCT contract_id, instrument_id FROM bars_type) b USING (contract_id)",
    "scored": f"""
    SELECT e.decision_ns, lookback_weeks, e.contract_id, CAST(sum(settled) AS DOUBLE) AS score
    FROM eligible_contracts e CROSS JOIN (VALUES {', '.join(f'({n})' for n in LOOKBACKS)}) v(lookback_weeks)
    LEFT JOIN settled_weeks s ON s.instrument_id = e.instrument_id AND week_ns > e.decision_ns - lookback_weeks * {WEEK} AND week_ns <= e.decision_ns GROUP BY ALL"""}) + """
SELECT decision_ns, lookback_weeks, count(score) AS scored, count_if(score IS NULL) AS unscored, round(coalesce(avg(score), 0), 9) AS mean_score FROM scored GROUP BY ALL""")
def d38b(t):
    """What the funding members could rank on at each decision."""
    bars = staged(t.bars(), "bars")
    weekly = funding.for_contracts(funding.weekly_settlements(t.funding()), bars)
    return rounded(funding.score_extras(weekly, universe.select_universe(bars, S.UNIVERSE), LOOKBACKS), 9)


@query("l10_warm_up_calendar", with_views("bars_type", "decisions", more={**P.universe(), **warm_calendar(3, "universe")}) + """
SELECT fold_index, decision_ns, ordinal, is_warm_up FROM whole""")
def l10(t):
    return J.fold_calendar(t.decisions, S.GEOMETRY, 3).select("fold_index", "decision_ns", "ordinal", "is_warm_up")


@query("p05_funding_cross_section")
def p05(t):
    rows = J.funding_fold(t.bars(), t.funding(), t.decisions, S.PANEL, S.GEOMETRY, FUNDING, S.SCENARIOS)
    return rounded(rows.drop("ordinal"), 9)


PAIR_SQL = {
    "screened": P.universe("legs_type", LEG_RULES)["screened"],
    "spots": """SELECT *, CASE WHEN row_number() OVER (PARTITION BY decision_ns ORDER BY median_quote_volume DESC, contract_id) <= 2 THEN 1 ELSE 2 END AS spot_tier
      FROM screened WHERE contract_id LIKE 'spot:%'""",
    "pairs": """
    SELECT *, CASE WHEN liquidity_rank <= 2 THEN 1 ELSE 2 END AS perp_tier, greatest(CASE WHEN liquidity_rank <= 2 THEN 1 ELSE 2 END, spot_tier) AS tier FROM (
      SELECT p.decision_ns, p.contract_id AS pair_id, p.contract_id AS perp_contract, s.contract_id AS spot_contract, spot_tier,
        row_number() OVER (PARTITION BY p.decision_ns ORDER BY p.median_quote_volume DESC, p.contract_id) AS liquidity_rank,
        count(*) OVER (PARTITION BY p.decision_ns) AS n
      FROM screened p JOIN spots s ON s.decision_ns = p.decision_ns AND s.instrument_id = p.instrument_id WHERE p.contract_id LIKE 'perp:%')
    WHERE n >= 2 AND liquidity_rank <= 5""",
}


def declared_pairs(t):
    """Every instrument's perpetual with its spot of the same name."""
    return t.read("part").select(F.col("p_type").alias("perpetual"), F.col("p_type").alias("spot")).distinct()


@query("c07_pair_universe", with_views("legs_type", more=PAIR_SQL) + """
SELECT decision_ns, pair_id, spot_contract, liquidity_rank, perp_tier, spot_tier, tier FROM pairs""")
def c07(t):
    return carry.select_pairs(t.legs(), declared_pairs(t), CARRY.pairs).drop("perp_contract", "median_quote_volume")


@query("f08_stratified_rank_sample", with_views("legs_type", more=PAIR_SQL) + """
SELECT decision_ns, 1 AS sample_tier, liquidity_rank, 'spot' AS market, spot_contract AS contract_id FROM pairs UNION ALL
SELECT decision_ns, 1, liquidity_rank, 'perp', perp_contract FROM pairs""")
def f08(t):
    return microstructure.stratified_sample(carry.select_pairs(t.legs(), declared_pairs(t), CARRY.pairs))


WIDE_PAIRS = carry.PairRules(LEG_RULES, 2, 40, 2)
WIDE_SQL = {
    **PAIR_SQL, "screened": P.universe("legs_brand", LEG_RULES)["screened"], "pairs": PAIR_SQL["pairs"].replace("liquidity_rank <= 5", "liquidity_rank <= 40"),
    "sampled": f"""
    SELECT *, CASE WHEN liquidity_rank IN {microstructure.TIER_ONE_RANKS} THEN 1 WHEN liquidity_rank IN {microstructure.TIER_TWO_RANKS} THEN 2 END AS sample_tier
    FROM pairs""",
}


@query("f08b_stratified_sample_of_brands", with_views("legs_brand", more=WIDE_SQL) + """
SELECT decision_ns, sample_tier, liquidity_rank, 'spot' AS market, spot_contract AS contract_id FROM sampled WHERE sample_tier IS NOT NULL UNION ALL
SELECT decision_ns, sample_tier, liquidity_rank, 'perp', perp_contract FROM sampled WHERE sample_tier IS NOT NULL""")
def f08b(t):
    """Pairs beyond rank eight: every third or fourth of them is in the second tier, the ranks between are not sampled."""
    names = t.read("part").select(F.col("p_brand").alias("perpetual"), F.col("p_brand").alias("spot")).distinct()
    return microstructure.stratified_sample(carry.select_pairs(t.legs("p_brand"), names, WIDE_PAIRS))


SETTLED_SQL = {
    "settlements": f"""
    SELECT c.contract_id, (calc_time_ns - 345600000000000 + {WEEK - 1}) // {WEEK} * {WEEK} + 345600000000000 AS decision_ns, sum(rate) AS settled,
      sum(CASE WHEN rate > 0 THEN rate ELSE 0 END) AS positive, sum(CASE WHEN rate < 0 THEN rate ELSE 0 END) AS negative
    FROM funding_type f JOIN (SELECT DISTINCT instrument_id, contract_id FROM legs_type WHERE venue = 'perp') c USING (instrument_id) GROUP BY ALL""",
    "asked": "SELECT * FROM pairs CROSS JOIN (VALUES " + ", ".join(
        f"('{m.name}', {m.lookback_weeks}, {m.hold_weeks}, {str(m.exit_on_negative).lower()}, {m.hurdle_multiple if m.hurdle_multiple is not None else 'NULL'}::DOUBLE)"
        for m in CARRY_MEMBERS) + ") v(member, lb, hold, exits, multiple)",
    "trailed": f"""
    SELECT a.*, t.trail_sum FROM asked a LEFT JOIN (SELECT a.member, a.decision_ns, a.pair_id, CAST(sum(settled) AS DOUBLE) AS trail_sum
      FROM asked a JOIN settlements s ON s.contract_id = a.perp_contract AND s.decision_ns > a.decision_ns - lb * {WEEK} AND s.decision_ns <= a.decision_ns GROUP BY ALL) t
    USING (member, decision_ns, pair_id)""",
    "paying": """
    SELECT *, count(*) OVER (PARTITION BY member, decision_ns) AS paying FROM (SELECT *, count(*) OVER (PARTITION BY member, decision_ns) AS eligible FROM trailed)
    WHERE trail_sum > 0 AND (multiple IS NULL OR trail_sum >= 2 * multiple * (15 + 2 * CASE WHEN tier = 1 THEN 2 ELSE 5 END) / 10000 * (lb / hold))""",
    "ranked": """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member, decision_ns ORDER BY trail_sum DESC, pair_id) AS rank FROM paying WHERE paying >= 1)
    WHERE rank <= greatest(1, eligible // 2)""",
}


REFERENCE = J.control_reference(CARRY_MEMBERS)
CONTROL_SQL = {
    "lent": f"SELECT * FROM trailed WHERE member = '{REFERENCE.name}'",
    "drawn_pairs": f"""
    SELECT *, row_number() OVER (PARTITION BY decision_ns ORDER BY {P.random_score(CARRY.random_seed, 'decision_ns', 'pair_id')}, pair_id) AS rk,
      count(*) OVER (PARTITION BY decision_ns) AS total FROM lent""",
    "formed_of": """
    SELECT member, decision_ns, pair_id, perp_contract, spot_contract, hold, exits, rank FROM ranked
    UNION ALL SELECT 'random_pairs', decision_ns, pair_id, perp_contract, spot_contract, hold, false, rk FROM drawn_pairs WHERE rk <= greatest(1, total // 2)
    UNION ALL SELECT 'all_pairs', decision_ns, pair_id, perp_contract, spot_contract, hold, false, row_number() OVER (PARTITION BY decision_ns ORDER BY pair_id)
    FROM lent WHERE trail_sum > 0""",
}


def inputs(t, rules=CARRY):
    return J.carry_inputs(t.legs(), declared_pairs(t), t.funding(), t.decisions, rules, S.GEOMETRY, CARRY_MEMBERS)


@query("e14_paying_rank", with_views("legs_type", "funding_type", more={**PAIR_SQL, **SETTLED_SQL}) + """
SELECT member, decision_ns, pair_id, rank, round(trail_sum, 9) AS "trailing" FROM ranked""")
def e14(t):
    out = J.rank_members(inputs(t).eligible, CARRY_MEMBERS, CARRY, S.CARRY_BASE)
    return rounded(out.select("member", "decision_ns", "pair_id", "rank", "trailing"), 9)


@query("f04_first_unheld_ranks", with_views("legs_type", "funding_type", more={**PAIR_SQL, **SETTLED_SQL}) + f"""
SELECT member, decision_ns, pair_id FROM (SELECT *, row_number() OVER (PARTITION BY member, decision_ns ORDER BY rank, pair_id) AS slot_n FROM ranked r
  WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.member = r.member AND b.pair_id = r.pair_id AND b.decision_ns = r.decision_ns - {WEEK})) WHERE slot_n <= 1""")
def f04(t):
    ranked = J.rank_members(inputs(t).eligible, CARRY_MEMBERS, CARRY, S.CARRY_BASE)
    last_week = ranked.select("member", "pair_id", (F.col("decision_ns") + F.lit(WEEK)).alias("decision_ns"))
    out = carry.fill_slots(ranked, last_week, free=1, group=["member", "decision_ns"])
    return out.select("member", "decision_ns", "pair_id")


COHORT_SQL = {
    **PAIR_SQL, **SETTLED_SQL, **CONTROL_SQL, **warm_calendar(7, "pairs"),
    "named": "SELECT DISTINCT pair_id, perp_contract, spot_contract FROM pairs",
    "prices": P.prices("legs_type"),
    "facts": """
    SELECT n.pair_id, p.decision_ns, p.exit_close IS NULL OR s.exit_close IS NULL AS forced, coalesce(w.settled > 0, false) AS paid
    FROM named n JOIN prices p ON p.contract_id = n.perp_contract JOIN prices s ON s.contract_id = n.spot_contract AND s.decision_ns = p.decision_ns
    LEFT JOIN settlements w ON w.contract_id = n.perp_contract AND w.decision_ns = p.decision_ns""",
    "entries": """
    SELECT f.fold_index, r.member, r.pair_id, r.perp_contract, r.spot_contract, r.hold, r.exits, r.decision_ns AS formed,
      count(*) OVER (PARTITION BY f.fold_index, r.member, r.decision_ns) AS formed_size
    FROM formed_of r JOIN whole f ON f.decision_ns = r.decision_ns AND NOT f.skipped""",
    "live": f"""
    SELECT e.*, d.decision_ns FROM entries e JOIN calendar d ON d.fold_index = e.fold_index AND NOT d.skipped AND d.decision_ns >= formed
      AND d.decision_ns < formed + hold * {WEEK}
    WHERE NOT EXISTS (SELECT 1 FROM calendar x LEFT JOIN facts k ON k.pair_id = e.pair_id AND k.decision_ns = x.decision_ns
      WHERE x.fold_index = e.fold_index AND x.decision_ns >= formed AND x.decision_ns <= d.decision_ns AND (
        (x.skipped AND x.decision_ns > formed) OR k.pair_id IS NULL OR (exits AND NOT k.paid) OR (k.forced AND x.decision_ns < d.decision_ns)))""",
    "weights": """
    SELECT fold_index, member, decision_ns, contract_id, sum(w) AS weight FROM (
      SELECT fold_index, member, decision_ns, spot_contract AS contract_id, 1.0::DOUBLE / hold / formed_size / 2 AS w FROM live UNION ALL
      SELECT fold_index, member, decision_ns, perp_contract, -1.0::DOUBLE / hold / formed_size / 2 FROM live) GROUP BY ALL""",
}


@query("c13_carry_cohort_book", with_views("legs_type", "funding_type", "decisions", more=COHORT_SQL) + """
SELECT fold_index, member, decision_ns, contract_id, round(weight, 9) AS weight FROM weights""")
def c13(t):
    return rounded(J.carry_legs(inputs(t), CARRY_MEMBERS, CARRY, S.CARRY_BASE, controls=True), 9)


@query("c15_pairs_removed_from_cohorts", with_views("legs_type", "funding_type", "decisions", more=COHORT_SQL) + """
SELECT e.fold_index, e.member, e.formed, e.pair_id, count(l.decision_ns) AS weeks_held FROM entries e
LEFT JOIN live l USING (fold_index, member, formed, pair_id) GROUP BY ALL""")
def c15(t):
    got = inputs(t)
    entries = J.carry_entries(got, CARRY_MEMBERS, CARRY, S.CARRY_BASE, controls=True)
    live = carry.live_cohorts(entries, got.calendar, got.facts, book=J.BOOK)
    keys = ["fold_index", "member", "formed_ns", "pair_id"]
    weeks = live.groupBy(*keys).agg(F.count("*").alias("weeks_held"))
    return entries.select(*keys).join(weeks, keys, "left").fillna(0, ["weeks_held"]).withColumnRenamed("formed_ns", "formed")


@query("c16_untradeable_pairs", with_views("legs_type", "decisions", more={**PAIR_SQL, "named": "SELECT DISTINCT pair_id, perp_contract, spot_contract FROM pairs"}) + """
SELECT n.pair_id, d.decision_ns FROM named n CROSS JOIN decisions d
LEFT JOIN legs_type p ON p.contract_id = n.perp_contract AND p.close_time_ns = d.decision_ns
LEFT JOIN legs_type s ON s.contract_id = n.spot_contract AND s.close_time_ns = d.decision_ns WHERE p.contract_id IS NULL OR s.contract_id IS NULL""")
def c16(t):
    legs = staged(t.legs(), "legs")
    named = carry.select_pairs(legs, declared_pairs(t), CARRY.pairs).select("pair_id", "perp_contract", "spot_contract").distinct()
    span = t.decisions.agg(F.array_sort(F.collect_set("decision_ns")).alias("d"))
    grid = named.withColumn("d", span.select("d").scalar()).withColumn("decision_ns", F.explode("d"))
    bars = lambda c: legs.select(F.col("contract_id").alias(c), F.col("close_time_ns").alias("decision_ns"))
    both = grid.join(bars("perp_contract"), ["perp_contract", "decision_ns"], "left_semi").join(
        bars("spot_contract"), ["spot_contract", "decision_ns"], "left_semi"
    )
    return grid.join(both, ["pair_id", "decision_ns"], "left_anti").select("pair_id", "decision_ns")


@query("c22_legs_without_bar", with_views("legs_type", "decisions", more={**PAIR_SQL, "n": "SELECT DISTINCT perp_contract AS leg FROM pairs UNION SELECT DISTINCT spot_contract FROM pairs"}) + """
SELECT d.decision_ns, string_agg(n.leg, ',' ORDER BY n.leg) AS missing_legs FROM n CROSS JOIN decisions d
WHERE NOT EXISTS (SELECT 1 FROM legs_type b WHERE b.contract_id = n.leg AND b.close_time_ns = d.decision_ns) GROUP BY ALL""")
def c22(t):
    legs = staged(t.legs(), "legs")
    pairs = carry.select_pairs(legs, declared_pairs(t), CARRY.pairs)
    names = pairs.select(F.explode(F.array("perp_contract", "spot_contract")).alias("leg")).distinct()
    span = t.decisions.agg(F.array_sort(F.collect_set("decision_ns")).alias("d"))
    grid = names.withColumn("d", span.select("d").scalar()).select("leg", F.explode("d").alias("decision_ns"))
    bars = legs.select(F.col("contract_id").alias("leg"), F.col("close_time_ns").alias("decision_ns"))
    gone = grid.join(bars, ["leg", "decision_ns"], "left_anti")
    return gone.groupBy("decision_ns").agg(F.array_join(F.array_sort(F.collect_list("leg")), ",").alias("missing_legs"))


CARRY_NAMES = J.carry_names(CARRY_MEMBERS, controls=True)
CARRY_SQL = {
    **COHORT_SQL,
    "leg_tiers": "SELECT decision_ns, tier, perp_contract AS contract_id FROM pairs UNION ALL SELECT decision_ns, tier, spot_contract FROM pairs",
    **P.episodes(bars="legs_type", folds=True, tiers="leg_tiers", settlements="settlements", scenarios=COSTS),
    **P.grid(CARRY_NAMES, folds=True, scenarios=COSTS),
}


def carry_line_report(t):
    return report(t, "carry-lines", lambda: J.carry_lines(inputs(t), CARRY_MEMBERS, CARRY, COSTS, controls=True))


def carry_report(t):
    return report(t, "carry", lambda: J.carry_episodes(carry_line_report(t), inputs(t), COSTS, CARRY_NAMES))


# Half shares of round rates end in a 5 at the tenth digit, so costs keep eleven.
FINE_COSTS = ["funding_cost", "forced_close_cost", "turnover_cost"]
LEG_COLUMNS = EPISODE_COLUMNS
for _cost in FINE_COSTS:
    LEG_COLUMNS = LEG_COLUMNS.replace(f"round({_cost}, 9)", f"round({_cost}, 11)")


@query("d17_two_leg_episodes", with_views("legs_type", "funding_type", "decisions", more=CARRY_SQL) + f"""
SELECT fold_index, {LEG_COLUMNS} FROM grid_episodes""")
def d17(t):
    rows = rounded(carry_report(t).drop("ordinal"), 11, FINE_COSTS)
    return rounded(rows, 9, [a for a in P.AMOUNTS if a not in FINE_COSTS])


SIDES = {"spot": "contract_id LIKE 'spot:%'", "perp": "contract_id LIKE 'perp:%'"}


@query("d17b_leg_split", with_views("legs_type", "funding_type", "decisions", more=CARRY_SQL) + f"""
SELECT fold_index, member, decision_ns, scenario, round(sum(CASE WHEN {SIDES['spot']} THEN turnover_cost ELSE 0 END), 11) AS spot_cost,
  round(sum(CASE WHEN {SIDES['perp']} THEN turnover_cost ELSE 0 END), 11) AS perp_cost,
  count_if(forced AND weight <> 0 AND {SIDES['spot']}) AS forced_spot_legs, count_if(forced AND weight <> 0 AND {SIDES['perp']}) AS forced_perp_legs,
  round(-sum(funding_cost), 11) AS funding_collected, round(sum(gross), 9) AS basis_pnl FROM lines GROUP BY ALL""")
def d17b(t):
    out = J.leg_split(carry_line_report(t))
    return rounded(rounded(out, 11, ["spot_cost", "perp_cost", "funding_collected"]), 9, ["basis_pnl"])


@query("d17c_pair_contributions", with_views("legs_type", "funding_type", "decisions", more={**CARRY_SQL,
    "of_pair": "SELECT DISTINCT pair_id, perp_contract AS contract_id FROM pairs UNION SELECT DISTINCT pair_id, spot_contract FROM pairs"}) + """
SELECT fold_index, member, decision_ns, scenario, pair_id, round(sum(net), 8) AS net FROM lines JOIN of_pair USING (contract_id) GROUP BY ALL""")
def d17c(t):
    return rounded(J.pair_contributions(carry_line_report(t), inputs(t).eligible), 8)


@query("p06_carry_decisions", with_views("legs_type", "funding_type", "decisions", more=CARRY_SQL) + """
SELECT member, scenario, count(*) AS episodes, count_if(positions = 0) AS held_nothing, round(sum(net_return), 9) AS net_return,
  round(-sum(funding_cost), 9) AS funding_collected, round(sum(gross_return), 9) AS basis_pnl FROM grid_episodes GROUP BY ALL""")
def p06(t):
    return rounded(carry_report(t).groupBy("member", "scenario").agg(
        F.count("*").alias("episodes"), F.count_if(F.col("positions") == 0).alias("held_nothing"),
        F.sum("net_return").alias("net_return"), (-F.sum("funding_cost")).alias("funding_collected"),
        F.sum("gross_return").alias("basis_pnl"),
    ), 9)


@query("p08_carry_fold_report", with_views("legs_type", "funding_type", "decisions", more=CARRY_SQL) + """
SELECT fold_index, member, scenario, round(sum(net_return), 9) AS net_return, CAST(sum(forced_close_count) AS BIGINT) AS forced_closes FROM grid_episodes GROUP BY ALL""")
def p08(t):
    return rounded(carry_report(t).groupBy("fold_index", "member", "scenario").agg(
        F.sum("net_return").alias("net_return"), F.sum("forced_close_count").alias("forced_closes")
    ), 9)


@query("p07_cohort_selection", with_views("legs_type", "funding_type", more={**PAIR_SQL, **SETTLED_SQL, **CONTROL_SQL}) + """
SELECT member, decision_ns, count(*) AS cohort_size, string_agg(pair_id, ',' ORDER BY rank) AS pairs FROM formed_of GROUP BY ALL""")
def p07(t):
    ranked = J.rank_members(inputs(t).eligible, CARRY_MEMBERS, CARRY, S.CARRY_BASE, controls=True)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "pair_id")))
    return ranked.groupBy("member", "decision_ns").agg(
        F.count("*").alias("cohort_size"), F.array_join(F.transform(ordered, lambda s: s["pair_id"]), ",").alias("pairs")
    )


@query("k05_slot_book")
def k05(t):
    return rounded(J.carry_legs(inputs(t, SLOTS), CARRY_MEMBERS, SLOTS, S.CARRY_BASE), 9)


@query("k05b_slot_carry_episodes")
def k05b(t):
    return rounded(J.carry_fold(inputs(t, SLOTS), CARRY_MEMBERS, SLOTS, COSTS).drop("ordinal"), 9)


@query("d35_final_books", with_views("legs_type", "funding_type", "decisions", more={**COHORT_SQL,
    "last": "SELECT fold_index, max(decision_ns) AS decision_ns FROM calendar WHERE NOT skipped GROUP BY ALL"}) + """
SELECT fold_index, member, contract_id, round(weight, 9) AS weight FROM weights JOIN last USING (fold_index, decision_ns)""")
def d35(t):
    got = inputs(t)
    live = got.calendar.filter(~F.col("is_warm_up") & ~F.col("skipped"))
    last = live.groupBy("fold_index").agg(F.max("decision_ns").alias("decision_ns"))
    legs = J.carry_legs(got, CARRY_MEMBERS, CARRY, S.CARRY_BASE, controls=True)
    return rounded(legs.join(last, ["fold_index", "decision_ns"]).select("fold_index", "member", "contract_id", "weight"), 9)


@query("b25_control_borrows_shortest_hold", with_views("legs_type", more=PAIR_SQL) + f"""
SELECT decision_ns, count(*) AS pairs, greatest(1, count(*) // 2) AS book_width, '{REFERENCE.name}' AS control_reference FROM pairs GROUP BY ALL""")
def b25(t):
    pairs = carry.select_pairs(t.legs(), declared_pairs(t), CARRY.pairs)
    return pairs.groupBy("decision_ns").agg(F.count("*").alias("pairs")).withColumns({
        "book_width": F.greatest(F.lit(1), F.floor(F.col("pairs") / 2)), "control_reference": F.lit(REFERENCE.name)
    })


@query("c17_enriched_pairs", with_views("legs_type", "funding_type", more={**PAIR_SQL, **SETTLED_SQL}) + """
SELECT decision_ns, pair_id, liquidity_rank, CAST(settled AS DOUBLE) AS last_week, settled IS NULL AS unmeasured FROM pairs p
LEFT JOIN settlements s ON s.contract_id = p.perp_contract AND s.decision_ns = p.decision_ns""".replace("SELECT decision_ns, pair_id", "SELECT p.decision_ns, pair_id"))
def c17(t):
    got = inputs(t)
    weekly = got.weekly.select(F.col("contract_id").alias("perp_contract"), "decision_ns", F.col("settled").cast("double").alias("last_week"))
    out = got.eligible.join(weekly, ["perp_contract", "decision_ns"], "left")
    return out.select("decision_ns", "pair_id", "liquidity_rank", "last_week", F.col("last_week").isNull().alias("unmeasured"))


@query("p10_weekly_book_labels", with_views("legs_type", "funding_type", more={**PAIR_SQL, **SETTLED_SQL}) + f"""
SELECT p.decision_ns, pair_id, CASE WHEN settled IS NULL THEN NULL WHEN settled > 0.0005 THEN 1 WHEN settled < 0 THEN -1 ELSE 0 END AS label
FROM pairs p LEFT JOIN settlements s ON s.contract_id = p.perp_contract AND s.decision_ns = p.decision_ns + {WEEK}""")
def p10(t):
    from tidepanel.functions.rules import outcome_label

    got = inputs(t)
    ahead = got.weekly.select(
        F.col("contract_id").alias("perp_contract"), (F.col("decision_ns") - F.lit(WEEK)).alias("decision_ns"),
        F.col("settled").cast("double").alias("_s"),
    )
    return got.eligible.join(ahead, ["perp_contract", "decision_ns"], "left").select(
        "decision_ns", "pair_id", outcome_label(F.col("_s"), 0.0005).alias("label")
    )


@query("g02_cohort_weight_union", recursive(with_views("bars_type", "decisions", more=TREND_SQL)) + """
SELECT fold_index, member, decision_ns, count(*) AS positions, round(sum(abs(weight)), 7) AS gross FROM weights GROUP BY ALL""")
def g02(t):
    return rounded(c14(t).groupBy("fold_index", "member", "decision_ns").agg(
        F.count("*").alias("positions"), F.sum(F.abs("weight")).alias("gross")
    ), 7)


def live_pairs(t):
    """The carry job's inputs and the pairs its cohorts hold at each decision, controls included."""
    got = inputs(t)
    entries = J.carry_entries(got, CARRY_MEMBERS, CARRY, S.CARRY_BASE, controls=True)
    return got, carry.live_cohorts(entries, got.calendar, got.facts, book=J.BOOK)


@query("c22b_held_legs_without_bar", with_views("legs_type", "funding_type", "decisions", more={**COHORT_SQL, "held_legs": f"""
    SELECT DISTINCT l.fold_index, l.member, l.decision_ns + {WEEK} AS decision_ns, unnest([perp_contract, spot_contract]) AS leg
    FROM live l JOIN calendar c ON c.fold_index = l.fold_index AND c.decision_ns = l.decision_ns + {WEEK} WHERE l.decision_ns + {WEEK} < formed + hold * {WEEK}"""}) + """
SELECT fold_index, member, decision_ns, string_agg(leg, ',' ORDER BY leg) AS missing_legs, count(*) AS legs FROM held_legs h
WHERE NOT EXISTS (SELECT 1 FROM legs_type b WHERE b.contract_id = h.leg AND b.close_time_ns = h.decision_ns) GROUP BY ALL""")
def c22b(t):
    """Legs still to be held at the next decision that have no bar there; a book's width bounds each list."""
    got, live = live_pairs(t)
    following = F.col("decision_ns") + F.lit(WEEK)
    legs = live.filter(following < F.col("formed_ns") + F.col("hold_weeks") * F.lit(WEEK)).select(
        "fold_index", "member", following.alias("decision_ns"), F.explode(F.array("perp_contract", "spot_contract")).alias("leg")).distinct()
    reported = got.calendar.filter(~F.col("is_warm_up")).select("fold_index", "decision_ns")
    bars = got.legs.select(F.col("contract_id").alias("leg"), F.col("close_time_ns").alias("decision_ns"))
    gone = legs.join(reported, ["fold_index", "decision_ns"], "left_semi").join(bars, ["leg", "decision_ns"], "left_anti")
    return gone.groupBy("fold_index", "member", "decision_ns").agg(
        F.array_join(F.array_sort(F.collect_list("leg")), ",").alias("missing_legs"), F.count("*").alias("legs"))


@query("c16b_held_pairs_untradeable", with_views("legs_type", "funding_type", "decisions", more=COHORT_SQL) + f"""
SELECT DISTINCT l.fold_index, l.member, l.pair_id, l.decision_ns + {WEEK} AS decision_ns FROM live l
JOIN calendar c ON c.fold_index = l.fold_index AND c.decision_ns = l.decision_ns + {WEEK}
JOIN facts k ON k.pair_id = l.pair_id AND k.decision_ns = l.decision_ns WHERE k.forced AND l.decision_ns + {WEEK} < formed + hold * {WEEK}""")
def c16b(t):
    """Pairs that leave every cohort at a decision because a leg could not be priced there."""
    got, live = live_pairs(t)
    closing = got.facts.filter("closes_forced").select("pair_id", "decision_ns")
    following = F.col("decision_ns") + F.lit(WEEK)
    held = live.join(closing, ["pair_id", "decision_ns"], "left_semi").filter(following < F.col("formed_ns") + F.col("hold_weeks") * F.lit(WEEK))
    reported = got.calendar.filter(~F.col("is_warm_up")).select("fold_index", "decision_ns")
    out = held.select("fold_index", "member", "pair_id", following.alias("decision_ns")).distinct()
    return out.join(reported, ["fold_index", "decision_ns"], "left_semi")


@query("d35b_final_book_entries", with_views("legs_type", "funding_type", "decisions", more={**COHORT_SQL,
    "last": "SELECT fold_index, max(decision_ns) AS decision_ns FROM calendar WHERE NOT skipped GROUP BY ALL"}) + f"""
SELECT fold_index, member, pair_id, min(formed) AS entered_ns, CAST((max(decision_ns) - min(formed)) // {WEEK} AS BIGINT) AS weeks_held,
  count(*) AS cohorts, round(sum(1.0::DOUBLE / hold / formed_size), 9) AS capital FROM live JOIN last USING (fold_index, decision_ns) GROUP BY ALL""")
def d35b(t):
    """The pairs of each fold's last book: when the oldest cohort entered, how long ago, and the capital they are held with."""
    got, live = live_pairs(t)
    open_days = got.calendar.filter(~F.col("is_warm_up") & ~F.col("skipped"))
    last = open_days.groupBy("fold_index").agg(F.max("decision_ns").alias("decision_ns"))
    out = live.join(last, ["fold_index", "decision_ns"]).groupBy("fold_index", "member", "pair_id").agg(
        F.min("formed_ns").alias("entered_ns"), ((F.max("decision_ns") - F.min("formed_ns")) / F.lit(WEEK)).cast("long").alias("weeks_held"),
        F.count("*").alias("cohorts"), F.sum(F.lit(1.0) / F.col("hold_weeks") / F.col("formed_size")).alias("capital"))
    return rounded(out, 9)
