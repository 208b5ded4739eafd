"""Row rules, joins, quality, lineage and set operations over the panel views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.catalog import settings as S
from tidepanel.catalog.registry import query, rounded
from tidepanel.catalog.sqlviews import DAY, HOUR, WEEK, with_views
from tidepanel.catalog.tables import chain_hash
from tidepanel.functions import canonical, rules, timefns
from tidepanel.functions.timefns import DAY_NS, HOUR_NS, int_div
from tidepanel.operators import accounting, carry, chain, endpoints, funding, quality

CONTRACTS = "SELECT DISTINCT instrument_id, contract_id FROM bars_brand"


@query("b01_bar_constraints", with_views("bars_brand") + f"""
SELECT contract_id, close_time_ns, concat_ws(',', CASE WHEN least(open, high, low * (1 - 2 * (day % 9 = 0)::INT), close) <= 0 THEN 'NON_POSITIVE_PRICE' END,
  CASE WHEN low * (1 - 2 * (day % 9 = 0)::INT) > least(open, close) OR high * (1 - 0.5::DOUBLE * (day % 7 = 0)::INT) < greatest(open, close) THEN 'RANGE_NOT_CONTAINING' END,
  CASE WHEN available_time_ns - (day % 5 = 0)::INT * {2} < close_time_ns THEN 'AVAILABLE_BEFORE_CLOSE' END) AS reasons FROM bars_brand""")
def b01(t):
    d = F.col("day")
    broken = t.bars("p_brand").withColumns({
        "low": F.when(d % 9 == 0, -F.col("low")).otherwise(F.col("low")),
        "high": F.when(d % 7 == 0, F.col("high") * 0.5).otherwise(F.col("high")),
        "available_time_ns": F.when(d % 5 == 0, F.col("available_time_ns") - 2).otherwise(F.col("available_time_ns")),
    })
    return broken.select("contract_id", "close_time_ns", F.array_join(quality.bar_reasons(), ",").alias("reasons"))


@query("b10_per_side_cost", with_views("bars_type") + """
SELECT contract_id, close_time_ns, scenario, fee + CASE WHEN day % 3 = 1 THEN s1 ELSE s2 END AS per_side_bps FROM bars_type
CROSS JOIN (VALUES ('base', 5.0::DOUBLE, 2.0::DOUBLE, 5.0::DOUBLE), ('adverse', 5.0, 6.0, 15.0)) v(scenario, fee, s1, s2)""")
def b10(t):
    tier = F.when(F.col("day") % 3 == 0, F.lit(None)).otherwise(F.col("day") % 3)
    rows = t.bars().withColumn("tier", tier).withColumn("cost", F.explode(accounting.scenario_column(S.SCENARIOS)))
    return rows.select("contract_id", "close_time_ns", "cost.scenario", accounting.per_side_bps().alias("per_side_bps"))


@query("b11_round_trip_and_hurdle", with_views("bars_type") + """
SELECT contract_id, close_time_ns, 15.0::DOUBLE + 2 * CASE WHEN day % 2 = 1 THEN 2.0::DOUBLE ELSE 5 END AS round_trip_bps,
  round(2 * 1.5::DOUBLE * (15.0::DOUBLE + 2 * CASE WHEN day % 2 = 1 THEN 2.0::DOUBLE ELSE 5 END) / 10000 * 4 / 13, 9) AS hurdle FROM bars_type""")
def b11(t):
    tier = F.when(F.col("day") % 2 == 1, 1).otherwise(2)
    return rounded(t.bars().select(
        "contract_id", "close_time_ns", carry.round_trip_bps(S.CARRY_BASE, tier).alias("round_trip_bps"),
        carry.hurdle(S.CARRY_BASE, tier, multiple=1.5, lookback_weeks=4, hold_weeks=13).alias("hurdle"),
    ), 9)


def intents(t):
    """Order intents with account state, derived from ticks."""
    e, k = F.col("event_id"), F.col("quantity")
    return t.ticks.select(
        "event_id", "instrument_id", (e % 101 == 0).alias("hard_kill_switch"), (k / 9).alias("cumulative_loss"),
        (k / 80).alias("daily_loss"), (k / 30).alias("weekly_loss"), F.lit(100.0).alias("high_water_mark"),
        (100 - k / 18).alias("equity"), (e % 23 == 0).alias("unknown_order"), (e % 19 != 0).alias("audit_sink_healthy"),
        (e % 17 != 0).alias("account_synchronized"), (e % 13 != 0).alias("market_data_healthy"), (e % 11 != 0).alias("book_valid"),
        (e % 29 != 0).alias("rules_valid"), F.col("event_time_ns").alias("now_ns"),
        F.when(e % 7 == 0, F.col("event_time_ns") + 1).alias("cooldown_until_ns"),
        (F.col("event_time_ns") + (e % 5) - 1).alias("expires_at_ns"), (e % 31 != 0).alias("lineage_complete"),
        (e % 37 != 0).alias("forecast_eligible"), (e % 41 != 0).alias("has_exit"),
        ((e % 9) - 1).cast("double").alias("expected_net_return_adverse"), F.array(F.lit("error")).alias("open_order_intents"),
        F.col("price").alias("requested_notional"), (e % 3).cast("double").alias("instrument_exposure"),
        (k / 3).alias("gross_exposure"), (F.col("price") / 100 + 0.01).alias("planned_loss"), F.lit(0.5).alias("step"),
        F.lit(2.0).alias("minimum_notional"), (e % 4).alias("open_positions"),
    )


L = rules.RiskLimits()
REJECTION_SQL = f"""CASE WHEN event_id % 101 = 0 THEN 'HARD_KILL_SWITCH' WHEN quantity / 9 >= {L.hard_cumulative_loss} THEN 'CUMULATIVE_LOSS_LIMIT'
  WHEN quantity / 80 >= {L.maximum_daily_loss} THEN 'DAILY_LOSS_LIMIT' WHEN quantity / 30 >= {L.maximum_weekly_loss} THEN 'WEEKLY_LOSS_LIMIT'
  WHEN 100.0::DOUBLE - (100 - quantity / 18) >= {L.maximum_drawdown} THEN 'DRAWDOWN_LIMIT' WHEN event_id % 23 = 0 THEN 'UNKNOWN_ORDER_OUTCOME'
  WHEN event_id % 19 = 0 THEN 'AUDIT_SINK_UNHEALTHY' WHEN event_id % 17 = 0 THEN 'ACCOUNT_NOT_SYNCHRONIZED'
  WHEN event_id % 13 = 0 OR event_id % 11 = 0 THEN 'MARKET_DATA_UNHEALTHY' WHEN event_id % 29 = 0 THEN 'INVALID_VENUE_RULES'
  WHEN event_id % 7 = 0 THEN 'COOLDOWN_ACTIVE' WHEN event_id % 5 = 0 THEN 'INTENT_EXPIRED' WHEN event_id % 31 = 0 THEN 'LINEAGE_INCOMPLETE'
  WHEN event_id % 37 = 0 THEN 'FORECAST_INELIGIBLE' WHEN event_id % 41 = 0 THEN 'EXIT_UNDEFINED' WHEN event_id % 9 <= 1 THEN 'ADVERSE_EV_NON_POSITIVE'
  WHEN instrument_id = 'error' THEN 'OPEN_ORDER_INTENT_LIMIT' END"""


@query("b12_first_failing_rule", with_views("ticks") + f"SELECT event_id, {REJECTION_SQL} AS rejection FROM ticks")
def b12(t):
    return intents(t).select("event_id", rules.entry_rejection(L).alias("rejection"))


SIZE_SQL = f"floor(greatest(least(price, {L.maximum_instrument_exposure} - event_id % 3, {L.maximum_gross_exposure} - quantity / 3, price * {L.maximum_planned_loss}::DOUBLE / (price / 100 + 0.01::DOUBLE)), 0) / 0.5::DOUBLE) * 0.5::DOUBLE"


@query("b13_capped_size", with_views("ticks", more={"z": f"SELECT *, {SIZE_SQL} AS size FROM ticks"}) + f"""
SELECT event_id, size, CASE WHEN event_id % 3 = 0 AND event_id % 4 >= {L.maximum_positions} THEN 'POSITION_COUNT_LIMIT'
  WHEN size < 2 THEN 'VENUE_MINIMUM_EXCEEDS_SAFE_SIZE' WHEN size < price THEN 'SIZE_REDUCED' END AS reason FROM z""")
def b13(t):
    sized = intents(t).withColumn("size", rules.capped_size(L))
    return sized.select("event_id", "size", rules.sizing_reason(L, F.col("size")).alias("reason"))


SETTLED = f"""SELECT instrument_id, (calc_time_ns - {4 * DAY} + {WEEK - 1}) // {WEEK} * {WEEK} + {4 * DAY} AS decision_ns,
  CAST(sum(rate) AS DOUBLE) AS settled FROM funding_brand GROUP BY ALL"""


@query("b14_outcome_label", with_views("funding_brand", "decisions", more={"w": SETTLED, "g": "SELECT * FROM (SELECT DISTINCT instrument_id FROM w) CROSS JOIN decisions"}) + """
SELECT instrument_id, decision_ns, CASE WHEN settled IS NULL THEN NULL WHEN settled > 0.0005 THEN 1 WHEN settled < 0 THEN -1 ELSE 0 END AS label
FROM g LEFT JOIN w USING (instrument_id, decision_ns)""")
def b14(t):
    weekly = funding.weekly_settlements(t.funding("p_brand"))
    names = weekly.select("instrument_id").distinct()
    # Every instrument gets a row per decision, so that silence shows as NULL.
    span = t.decisions.agg(F.array_sort(F.collect_set("decision_ns")).alias("d"))
    grid = names.withColumn("d", span.select("d").scalar()).select("instrument_id", F.explode("d").alias("decision_ns"))
    joined = grid.join(weekly, ["instrument_id", "decision_ns"], "left")
    return joined.select("instrument_id", "decision_ns", rules.outcome_label(F.col("settled").cast("double"), 0.0005).alias("label"))


def sources(t):
    """Source inventory: one row per kind, instrument and month with a status."""
    month = timefns.month_string(F.col("day") * F.lit(DAY_NS))
    front = 11_500 - F.pmod(F.length("contract_id") * 7 + F.substring("instrument_id", 7, 2).cast("int") * 13, F.lit(120))
    base = t.bars("p_brand").select("instrument_id", month.alias("month"), (F.col("day") >= front).alias("late"))
    rows = base.groupBy("instrument_id", "month").agg(F.count("*").alias("days"), F.bool_or("late").alias("late"))
    kinds = F.array(F.lit("klines"), F.lit("funding"))
    # Coverage ends at another day for each instrument: later months are listed, but not there yet.
    return rows.withColumn("kind", F.explode(kinds)).withColumn(
        "status", F.when(F.col("late"), "pending")
        .when((F.col("kind") == "funding") & (F.col("days") % 4 == 0), "absent").otherwise("present")
    ).drop("late").withColumn("hash", F.sha2(F.concat_ws("|", "kind", "instrument_id", "month"), 256))


SOURCES = {
    "base": f"""SELECT instrument_id, strftime(make_timestamp(day * {DAY // 1000}), '%Y-%m') AS month,
      day >= 11500 - (length(contract_id) * 7 + CAST(substr(instrument_id, 7, 2) AS INT) * 13) % 120 AS late FROM bars_brand""",
    "sources": """SELECT kind, instrument_id, month, CASE WHEN late THEN 'pending' WHEN kind = 'funding' AND days % 4 = 0 THEN 'absent' ELSE 'present' END AS status
      FROM (SELECT instrument_id, month, count(*) AS days, bool_or(late) AS late FROM base GROUP BY ALL) CROSS JOIN (VALUES ('klines'), ('funding')) k(kind)""",
    "covered": "SELECT kind, instrument_id, max(month) AS covered_month FROM sources WHERE status = 'present' GROUP BY ALL",
    "classed": """SELECT *, (CAST(substr(front, 1, 4) AS INT) - CAST(substr(covered_month, 1, 4) AS INT)) * 12
        + CAST(substr(front, 6, 2) AS INT) - CAST(substr(covered_month, 6, 2) AS INT) AS behind
      FROM (SELECT *, max(covered_month) OVER (PARTITION BY kind) AS front FROM covered)""",
}


@query("b15_coverage_class", with_views("bars_brand", more=SOURCES) + """
SELECT kind, instrument_id, covered_month, CASE behind WHEN 0 THEN 'current' WHEN 1 THEN 'lagging' ELSE 'stale' END AS coverage FROM classed""")
def b15(t):
    return quality.coverage_class(quality.coverage_months(sources(t))).select("kind", "instrument_id", "covered_month", "coverage")


@query("d31_coverage_month", with_views("bars_brand", more=SOURCES) + """
SELECT min(m) AS coverage_month FROM (SELECT kind, max(month) AS m FROM sources WHERE status = 'present' GROUP BY ALL)""")
def d31(t):
    return quality.coverage_month(sources(t))


@query("d36_absent_at_source", with_views("bars_brand", more=SOURCES) + """
SELECT instrument_id, string_agg(month, ',' ORDER BY month) AS absent FROM sources WHERE kind = 'funding' AND status = 'absent' GROUP BY ALL""")
def d36(t):
    rows = sources(t).filter((F.col("kind") == "funding") & (F.col("status") == "absent"))
    return rows.groupBy("instrument_id").agg(F.array_join(F.array_sort(F.collect_set("month")), ",").alias("absent"))


@query("d40_stale_instruments", with_views("bars_brand", more=SOURCES) + """
SELECT kind, count(*) AS instruments, count_if(behind > 1) AS stale, max(front) AS furthest_month FROM classed GROUP BY ALL""")
def d40(t):
    return quality.coverage_class(quality.coverage_months(sources(t))).groupBy("kind").agg(
        F.count("*").alias("instruments"), F.count_if(F.col("coverage") == "stale").alias("stale"),
        F.max("furthest_month").alias("furthest_month"),
    )


@query("d40b_stale_list", with_views("bars_brand", more=SOURCES) + """
SELECT kind, instrument_id, covered_month, front AS furthest_month, behind AS months_behind FROM classed WHERE behind > 1""")
def d40b(t):
    """The stale instruments by name, a row each, so that the list is as long as it has to be."""
    return quality.stale_instruments(quality.coverage_class(quality.coverage_months(sources(t))))


@query("g06_months_by_instrument", with_views("bars_brand", more=SOURCES) + """
SELECT kind, instrument_id, count(DISTINCT month) AS months, min(month) AS first_month, max(month) AS last_month FROM sources
WHERE status = 'present' GROUP BY ALL""")
def g06(t):
    months = F.array_sort(F.collect_set("month"))
    return sources(t).filter("status = 'present'").groupBy("kind", "instrument_id").agg(months.alias("m")).select(
        "kind", "instrument_id", F.size("m").cast("bigint").alias("months"), F.element_at("m", 1).alias("first_month"),
        F.element_at("m", -1).alias("last_month"),
    )


@query("b19_month_range", with_views("bars_brand", more=SOURCES) + """
SELECT instrument_id, month FROM sources WHERE kind = 'klines' AND month >= '1996-03' AND month <= '1997-08'""")
def b19(t):
    return sources(t).filter((F.col("kind") == "klines") & timefns.month_between(F.col("month"), "1996-03", "1997-08")).select(
        "instrument_id", "month"
    )


@query("b22_covers_decision_day", with_views("bars_brand", "decisions", more={**SOURCES, "m": "SELECT instrument_id, list(month) AS months FROM sources WHERE kind = 'klines' GROUP BY ALL"}) + f"""
SELECT instrument_id, decision_ns, list_contains(months, strftime(make_timestamp(decision_ns // 1000), '%Y-%m')) AS covered FROM m CROSS JOIN decisions""")
def b22(t):
    months = sources(t).filter("kind = 'klines'").groupBy("instrument_id").agg(F.collect_set("month").alias("months"))
    span = t.decisions.agg(F.array_sort(F.collect_set("decision_ns")).alias("d"))
    rows = months.withColumn("d", span.select("d").scalar()).select("instrument_id", "months", F.explode("d").alias("decision_ns"))
    covered = rules.covers_day(
        F.lit(None).cast("string"), F.col("months"), timefns.day_string(F.col("decision_ns")), timefns.month_string(F.col("decision_ns"))
    )
    return rows.select("instrument_id", "decision_ns", covered.alias("covered"))


@query("b22b_covers_decision_day_by_tail", with_views("bars_brand", "decisions", more={**SOURCES, "m": f"""
    SELECT s.instrument_id, list(DISTINCT CASE WHEN status = 'present' THEN month END) AS months,
      (SELECT strftime(make_timestamp(max(day) * {DAY // 1000}), '%Y-%m-%d') FROM bars_brand b WHERE b.instrument_id = s.instrument_id AND day % 5 <> 0
        AND CAST(substr(s.instrument_id, 7, 2) AS INT) % 2 = 0 AND day < 10000) AS tail FROM sources s WHERE kind = 'klines' GROUP BY ALL"""}) + f"""
SELECT instrument_id, count(*) AS decisions, count_if(CASE WHEN tail IS NOT NULL THEN tail >= strftime(make_timestamp(decision_ns // 1000), '%Y-%m-%d')
    ELSE list_contains(months, strftime(make_timestamp(decision_ns // 1000), '%Y-%m')) END) AS covered, any_value(tail) AS tail_day FROM m CROSS JOIN decisions GROUP BY ALL""")
def b22b(t):
    """Instruments with a tail of daily files are covered up to its last day, the others by their months."""
    months = sources(t).filter("kind = 'klines'").groupBy("instrument_id").agg(
        F.collect_set(F.when(F.col("status") == "present", F.col("month"))).alias("months"))
    has_tail = F.substring("instrument_id", 7, 2).cast("int") % 2 == 0
    tails = t.bars("p_brand").filter(has_tail & (F.col("day") % 5 != 0) & (F.col("day") < 10_000)).groupBy("instrument_id").agg(
        timefns.day_string(F.max("day") * F.lit(DAY_NS)).alias("tail_day"))
    days = t.decisions.agg(F.array_sort(F.collect_set("decision_ns"))).scalar()
    asked = F.transform("_days", lambda d: rules.covers_day(F.col("tail_day"), F.col("months"), timefns.day_string(d), timefns.month_string(d)))
    return months.join(tails, "instrument_id", "left").withColumn("_days", days).select(
        "instrument_id", F.size(asked).cast("long").alias("decisions"), F.size(F.filter(asked, lambda c: c)).cast("long").alias("covered"), "tail_day")


EXIT_SQL = {
    **SOURCES,
    "reached": "SELECT min(m) AS coverage_month FROM (SELECT kind, max(month) AS m FROM sources WHERE status = 'present' GROUP BY ALL)",
}


@query("c21c_exit_gate", with_views("bars_brand", more={**EXIT_SQL, "named": f"""
    SELECT (d + 1) * {DAY} AS exit_ns, count(*) AS asked, count(b.day) AS with_bar FROM (SELECT DISTINCT day AS d FROM bars_brand WHERE day % 7 = 3)
    CROSS JOIN (SELECT DISTINCT instrument_id FROM bars_brand) i LEFT JOIN bars_brand b ON b.instrument_id = i.instrument_id AND b.day = d GROUP BY ALL""",
    "gated": f"""
    SELECT *, (SELECT coverage_month FROM reached) AS coverage_month, strftime(make_timestamp((exit_ns - {DAY}) // 1000), '%Y-%m') AS exit_month FROM named"""}) + """
SELECT exit_ns, asked, with_bar, coverage_month, concat_ws(',', CASE WHEN with_bar = 0 THEN 'EXIT_BAR_MISSING' WHEN with_bar < asked THEN 'EXIT_BAR_INCOMPLETE' END,
  CASE WHEN exit_month > coverage_month THEN 'COVERAGE_MONTH_NOT_REACHED' END) AS reasons FROM gated""")
def c21c(t):
    """Every exit close: how many instruments have their bar, and whether the covered months reach it."""
    bars = t.bars("p_brand").select("instrument_id", "day").distinct()
    exits = bars.filter("day % 7 = 3").groupBy("day").agg(F.count("*").alias("with_bar"))
    asked = bars.agg(F.countDistinct("instrument_id")).scalar()
    return quality.exit_gate(exits, asked, quality.coverage_month(sources(t)).scalar())


@query("c21_required_exit_bar", with_views("bars_brand", more={"e": "SELECT max(close_time_ns) AS exit_ns FROM bars_brand WHERE day % 7 = 3"}) + """
SELECT instrument_id, bool_or(close_time_ns = exit_ns) AS has_exit_bar FROM bars_brand CROSS JOIN e GROUP BY ALL""")
def c21(t):
    bars = t.bars("p_brand")
    last = bars.filter("day % 7 = 3").select(F.max("close_time_ns")).scalar()
    return bars.withColumn("_x", F.col("close_time_ns") == last).groupBy("instrument_id").agg(F.bool_or("_x").alias("has_exit_bar"))


@query("c08_superset_lineage", with_views("bars_brand", more=SOURCES) + """
SELECT kind, instrument_id, month, CASE WHEN month LIKE '%-03' THEN 'missing' WHEN month LIKE '%-05' THEN 'hash' WHEN status <> 'present' THEN 'status' END AS reason
FROM sources WHERE month LIKE '%-03' OR month LIKE '%-05' OR status <> 'present'""")
def c08(t):
    original = sources(t)
    extended = original.filter(~F.col("month").endswith("-03")).withColumns({
        "hash": F.when(F.col("month").endswith("-05"), F.sha2(F.lit("x"), 256)).otherwise(F.col("hash")),
        "status": F.lit("present"),
    })
    return quality.superset_reasons(original, extended, ["kind", "instrument_id", "month"])


@query("c09_row_reconciliation", with_views("bars_brand") + """
SELECT contract_id, close_time_ns, CASE WHEN day % 11 = 0 THEN 'missing_in_base' ELSE 'trade_count' END AS field FROM bars_brand WHERE day % 11 = 0 OR day % 4 = 0""")
def c09(t):
    rows = t.bars("p_brand").select("contract_id", "close_time_ns", "day", "base_volume", "trade_count")
    base = rows.filter("day % 11 <> 0").withColumn(
        "trade_count", F.when(F.col("day") % 4 == 0, F.col("trade_count") + 1).otherwise(F.col("trade_count"))
    )
    return quality.field_mismatches(rows, base, ["contract_id", "close_time_ns"], ["base_volume", "trade_count"]).select(
        "contract_id", "close_time_ns", "field"
    )


@query("c19_tail_split_by_coverage", with_views("bars_brand", more=SOURCES) + f"""
SELECT b.instrument_id, open_time_ns, CASE WHEN strftime(make_timestamp(open_time_ns // 1000), '%Y-%m') <= covered_month THEN 'superseded' ELSE 'carried' END AS disposition
FROM bars_brand b LEFT JOIN covered c ON c.instrument_id = b.instrument_id AND c.kind = 'klines' WHERE day >= 11300""")
def c19(t):
    covered = quality.coverage_months(sources(t)).filter("kind = 'klines'")
    tail = t.bars("p_brand").filter("day >= 11300").select("instrument_id", "open_time_ns")
    return quality.split_by_coverage(tail, covered, ["instrument_id"])


@query("g01_union_with_precedence", with_views("bars_brand") + """
SELECT instrument_id, open_time_ns, CASE WHEN day < 10500 THEN 0 WHEN day % 2 = 0 THEN 1 ELSE 2 END AS source_rank, trade_count FROM bars_brand""")
def g01(t):
    rows = t.bars("p_brand").select("instrument_id", "open_time_ns", "day", "trade_count")
    out = quality.union_by_precedence([rows.filter("day < 10500"), rows.filter("day % 2 = 0"), rows], ["instrument_id", "open_time_ns"])
    return out.select("instrument_id", "open_time_ns", "source_rank", "trade_count")


MISSING_SQL = """
    SELECT instrument_id, day FROM (SELECT instrument_id, unnest(range(min(day), max(day) + 1)) AS day FROM bars_brand GROUP BY instrument_id)
    EXCEPT SELECT instrument_id, day FROM bars_brand"""


@query("g03_missing_days", with_views("bars_brand", more={"m": MISSING_SQL}) + "SELECT * FROM m")
def g03(t):
    return quality.missing_days(t.bars("p_brand"))


@query("e19_contiguous_missing_runs", with_views("bars_brand", more={"m": MISSING_SQL}) + """
SELECT instrument_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM (
  SELECT *, day - row_number() OVER (PARTITION BY instrument_id ORDER BY day) AS isl FROM m) GROUP BY instrument_id, isl""")
def e19(t):
    return quality.contiguous_runs(quality.missing_days(t.bars("p_brand")), ["instrument_id"])


@query("g05_uncovered_days", with_views("bars_brand", more={"m": MISSING_SQL}) + "SELECT instrument_id, day FROM m WHERE day % 3 <> 0")
def g05(t):
    gaps = quality.missing_days(t.bars("p_brand"))
    covered = gaps.filter("day % 3 = 0")
    return gaps.join(covered, ["instrument_id", "day"], "left_anti")


@query("c18_claimed_absences", with_views("bars_brand", more={"m": MISSING_SQL}) + """
SELECT instrument_id, day FROM bars_brand WHERE day % 50 = 0""")
def c18(t):
    bars = t.bars("p_brand").select("instrument_id", "day")
    claimed = quality.missing_days(t.bars("p_brand")).unionByName(bars.filter("day % 50 = 0"))
    return claimed.join(quality.missing_days(t.bars("p_brand")), ["instrument_id", "day"], "left_anti")


@query("c23_gap_backfill", with_views("bars_brand", "legs_brand", more={"m": MISSING_SQL, "p": "SELECT instrument_id, day FROM legs_brand WHERE venue = 'spot'",
    "perp": "SELECT instrument_id, day FROM legs_brand WHERE venue = 'perp'",
    "gap": "SELECT instrument_id, day FROM (SELECT instrument_id, unnest(range(min(day), max(day) + 1)) AS day FROM perp GROUP BY instrument_id) EXCEPT SELECT instrument_id, day FROM perp"}) + """
SELECT instrument_id, gap.day, CASE WHEN p.day IS NULL THEN 'absent_at_source' ELSE 'filled' END AS status FROM gap LEFT JOIN p USING (instrument_id, day)""")
def c23(t):
    legs = t.legs("p_brand")
    gaps = quality.missing_days(legs.filter("venue = 'perp'"))
    secondary = legs.filter("venue = 'spot'").select("instrument_id", "day", "close")
    return quality.backfill(gaps, secondary, ["instrument_id"]).select("instrument_id", "day", "status")


@query("d01_quality_rollup", with_views("bars_brand") + """
SELECT instrument_id, count(*) AS rows, min(day) AS first_day, max(day) AS last_day, max(day) - min(day) + 1 - count(*) AS missing_days
FROM bars_brand GROUP BY ALL""")
def d01(t):
    return quality.quality_rollup(t.bars("p_brand"))


@query("b21_unexplained_gap_gate", with_views("bars_brand", more={"m": MISSING_SQL,
    "r": "SELECT instrument_id, count(*) AS missing_days, count_if(day % 3 <> 0) AS unexplained FROM m GROUP BY ALL"}) + """
SELECT * FROM r WHERE unexplained > 3""")
def b21(t):
    bars = t.bars("p_brand")
    absent = quality.missing_days(bars).filter("day % 3 = 0")
    return quality.unexplained_gaps(quality.quality_rollup(bars), absent, ["instrument_id"], 3)


@query("d02_conflict_checked_distinct", with_views("ticks") + """
SELECT count(DISTINCT event_id) AS keys, count_if(event_id % 3 = 0 AND event_id % 15 <> 0) AS identical_duplicates, count_if(event_id % 15 = 0) AS conflicting_keys FROM ticks""")
def d02(t):
    rows = t.ticks.select("event_id", "instrument_id", "price")
    again = rows.filter("event_id % 3 = 0").withColumn(
        "price", F.when(F.col("event_id") % 15 == 0, F.col("price") + 1).otherwise(F.col("price"))
    )
    _, report = quality.admit(rows.unionByName(again), ["event_id"], ["instrument_id", "price"])
    return report


@query("e02_missing_intervals", with_views("hour_bars") + f"""
SELECT instrument_id, CAST(coalesce(sum(gap // {HOUR} - 1), 0) AS BIGINT) AS missing, count_if(gap % {HOUR} <> 0) AS misaligned
FROM (SELECT instrument_id, lead(open_time_ns) OVER (PARTITION BY instrument_id ORDER BY open_time_ns) - open_time_ns AS gap FROM hour_bars) GROUP BY ALL""")
def e02(t):
    return quality.missing_intervals(t.hour_bars, ["instrument_id"], HOUR_NS)


@query("c06_first_open_identity", with_views("bars_brand") + """
SELECT instrument_id, min(open_time_ns) AS first_open_ns, instrument_id || ':' || min(open_time_ns) AS contract_id FROM bars_brand GROUP BY instrument_id""")
def c06(t):
    from tidepanel.operators.universe import attach_contract_id

    bars = attach_contract_id(t.bars("p_brand").drop("contract_id"))
    return bars.groupBy("instrument_id", "contract_id").agg(F.min("open_time_ns").alias("first_open_ns"))


SPAN = 3 * DAY


@query("c04_interval_sum", with_views("bars_brand", "funding_brand") + f"""
SELECT b.instrument_id, b.close_time_ns, CAST(sum(f.rate) AS DOUBLE) AS trailing FROM bars_brand b LEFT JOIN funding_brand f
  ON f.instrument_id = b.instrument_id AND f.calc_time_ns > b.close_time_ns - {SPAN} AND f.calc_time_ns <= b.close_time_ns GROUP BY ALL""")
def c04(t):
    asked = t.bars("p_brand").select("instrument_id", "close_time_ns")
    out = funding.interval_sum(
        t.funding("p_brand"), asked, keys=["instrument_id"], span_ns=SPAN, event_ns="calc_time_ns",
        query_ns="close_time_ns", value="rate", name="trailing",
    )
    return out.withColumn("trailing", F.col("trailing").cast("double"))


@query("c05_holding_settlements", with_views("funding_brand", "decisions") + f"""
SELECT instrument_id, decision_ns, CAST(sum(CASE WHEN rate > 0 THEN rate ELSE 0 END) AS DOUBLE) AS positive,
  CAST(sum(CASE WHEN rate < 0 THEN rate ELSE 0 END) AS DOUBLE) AS negative
FROM funding_brand JOIN decisions ON calc_time_ns > decision_ns AND calc_time_ns <= decision_ns + {WEEK} GROUP BY ALL""")
def c05(t):
    weekly = funding.weekly_settlements(t.funding("p_brand")).select(
        "instrument_id", (F.col("decision_ns") - F.lit(WEEK)).alias("decision_ns"),
        F.col("positive").cast("double").alias("positive"), F.col("negative").cast("double").alias("negative"),
    )
    return weekly.join(t.decisions, "decision_ns", "left_semi")


@query("e18_settlement_intervals", with_views("funding_brand", more={"d": f"SELECT DISTINCT instrument_id, calc_time_ns + CASE WHEN calc_time_ns // {DAY} % 11 = 0 THEN {HOUR // 3} ELSE 0 END AS calc_time_ns FROM funding_brand",
    "g": "SELECT *, coalesce(lead(calc_time_ns) OVER w - calc_time_ns, calc_time_ns - lag(calc_time_ns) OVER w, 28800000000000) AS gap FROM d WINDOW w AS (PARTITION BY instrument_id ORDER BY calc_time_ns)"}) + f"""
SELECT instrument_id, calc_time_ns, interval_hours, interval_hours <= 0 OR abs(gap - interval_hours * {HOUR}) > 60000000000 AS irregular
FROM (SELECT *, (gap + {HOUR // 2}) // {HOUR} AS interval_hours FROM g)""")
def e18(t):
    # On every eleventh day settlements come twenty minutes late.
    late = F.when(F.pmod(int_div(F.col("calc_time_ns"), DAY), F.lit(11)) == 0, HOUR // 3).otherwise(0)
    times = t.funding("p_brand").select("instrument_id", (F.col("calc_time_ns") + late).alias("calc_time_ns")).distinct()
    return quality.settlement_intervals(times, ["instrument_id"])


@query("b16_half_even_rounding", with_views("ticks") + """
SELECT event_id, CAST(round_even(price * 100, 0) AS BIGINT) AS cents, CAST(ceil(price) AS BIGINT) AS whole FROM ticks""")
def b16(t):
    return t.ticks.select(
        "event_id", rules.quantised(F.col("price") * 100, 0).cast("bigint").alias("cents"), rules.whole_bps(F.col("price")).alias("whole")
    )


@query("b17_time_formatting", with_views("ticks") + """
SELECT event_id, strftime(make_timestamp(event_time_ns // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_time_ns // 1000 % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(event_time_ns // 1000 % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS iso,
  strftime(make_timestamp(event_time_ns // 1000), '%Y-%m-%d') AS day, strftime(make_timestamp(event_time_ns // 1000), '%Y-%m') AS month FROM ticks""")
def b17(t):
    ns = F.col("event_time_ns")
    return t.ticks.select("event_id", timefns.iso_utc(ns).alias("iso"), timefns.day_string(ns).alias("day"), timefns.month_string(ns).alias("month"))


@query("b18_sample_ids", with_views("decisions") + "SELECT 'XV:' || decision_ns || ':w1' AS sample_id, decision_ns AS parsed_ns FROM decisions")
def b18(t):
    out = t.decisions.select(timefns.sample_id("XV", F.col("decision_ns")).alias("sample_id"))
    return out.withColumn("parsed_ns", timefns.sample_decision_ns(F.col("sample_id")))


@query("b20_default_horizon", with_views("ticks") + "SELECT event_id, coalesce(nullif(event_id % 4, 0), 1) AS horizon FROM ticks")
def b20(t):
    return t.ticks.select("event_id", rules.horizon_bars(F.nullif(F.col("event_id") % 4, F.lit(0))).alias("horizon"))


@query("b23_snapshot_of_the_week", with_views("ticks", more={"s": f"SELECT (min(event_time_ns) // {WEEK} + 2) * {WEEK} AS decision_ns FROM ticks"}) + f"""
SELECT instrument_id, count(*) AS rows FROM ticks CROSS JOIN s WHERE event_time_ns > decision_ns - {WEEK} AND event_time_ns <= decision_ns GROUP BY ALL""")
def b23(t):
    decision = (int_div(t.ticks.select(F.min("event_time_ns")).scalar(), WEEK) + 2) * F.lit(WEEK)
    rows = t.ticks.withColumn("_d", decision)
    inside = (F.col("event_time_ns") > F.col("_d") - F.lit(WEEK)) & (F.col("event_time_ns") <= F.col("_d"))
    return rows.filter(inside).groupBy("instrument_id").agg(F.count("*").alias("rows"))


@query("g07_decisions_in_range", with_views("decisions", "bars_type", more={"k": "SELECT DISTINCT close_time_ns AS decision_ns FROM bars_type WHERE close_time_ns BETWEEN 820000000000000000 AND 900000000000000000"}) + """
SELECT decision_ns FROM decisions INTERSECT SELECT decision_ns FROM k""")
def g07(t):
    own = t.bars().filter(
        F.col("close_time_ns").between(820_000_000_000_000_000, 900_000_000_000_000_000)
    ).select(F.col("close_time_ns").alias("decision_ns"))
    return t.decisions.intersect(own)


CANON = """'{"event_id":' || event_id || ',"kind":"' || kind || '","payload":"' || payload || '","sequence":' || sequence || '}'"""


@query("h01_canonical_json_hash", with_views("chain") + f"SELECT event_id, {CANON} AS canonical, sha256({CANON}) AS content_hash FROM chain")
def h01(t):
    columns = {c: F.col(c) for c in ("sequence", "payload", "kind", "event_id")}
    return t.chain.select("event_id", canonical.canonical_json(columns).alias("canonical"), canonical.content_sha256(columns).alias("content_hash"))


@query("h12_sealed_records", with_views("chain", more={"s": f"SELECT event_id, sha256({CANON}) = CASE WHEN event_id % 10 = 0 THEN '0' ELSE sha256({CANON}) END AS sealed FROM chain"}) + """
SELECT sealed, count(*) AS records FROM s GROUP BY ALL""")
def h12(t):
    columns = ["sequence", "payload", "kind", "event_id"]
    honest = canonical.content_sha256({c: F.col(c) for c in columns})
    rows = t.chain.withColumn("recorded", F.when(F.col("event_id") % 10 == 0, "0").otherwise(honest))
    return rows.groupBy(canonical.sealed(columns, "recorded").alias("sealed")).agg(F.count("*").alias("records"))


CHAIN_REASONS = {
    "w": """SELECT c.*, p.content_hash AS linked FROM broken_chain c LEFT JOIN broken_chain p ON p.chain_id = c.chain_id AND p.sequence = c.sequence - 1""",
    "r": """SELECT *, concat_ws(',',
      CASE WHEN sha256(chain_id::VARCHAR || '|' || sequence::VARCHAR || '|' || kind || '|' || payload) <> content_hash THEN 'SEGMENT_HASH_MISMATCH' END,
      CASE WHEN linked IS NULL AND sequence <> 1 THEN 'SEGMENT_SEQUENCE_GAP' END,
      CASE WHEN previous_hash <> coalesce(linked, CASE WHEN sequence = 1 THEN repeat('0', 64) END) THEN 'CHAIN_LINK_BROKEN' END) AS reasons FROM w""",
}


@query("e17_hash_chain_verification", with_views("broken_chain", more=CHAIN_REASONS) + "SELECT chain_id, sequence, reasons FROM r")
def e17(t):
    return chain.chain_reasons(t.broken_chain, chain_hash()).select("chain_id", "sequence", F.array_join("reasons", ",").alias("reasons"))


@query("e23_chain_head_check", with_views("broken_chain", more={
    "i": "SELECT chain_id, count(*) AS segment_count, max(sequence) AS last_sequence, arg_max(content_hash, sequence) AS final_hash FROM broken_chain GROUP BY ALL"}) + """
SELECT chain_id, CASE WHEN chain_id % 11 = 0 THEN 'CHAIN_HEAD_MISSING' WHEN chain_id % 3 = 0 THEN 'CHAIN_HEAD_MISMATCH:segment_count' ELSE '' END AS reasons FROM i""")
def e23(t):
    implied = chain.implied_heads(t.broken_chain)
    heads = implied.filter("chain_id % 11 <> 0").withColumn(
        "segment_count", F.when(F.col("chain_id") % 3 == 0, F.col("segment_count") + 1).otherwise(F.col("segment_count"))
    )
    return chain.head_mismatches(heads, implied).select("chain_id", F.array_join("reasons", ",").alias("reasons"))


WINDOW = (1_704_672_000_000_000_000, 1_705_276_800_000_000_000)


@query("k04_windowed_chain_anchor", with_views("broken_chain") + f"""
SELECT chain_id, max(CASE WHEN received_time_ns < {WINDOW[0]} THEN sequence END) AS anchor_sequence,
  min(CASE WHEN received_time_ns BETWEEN {WINDOW[0]} AND {WINDOW[1]} THEN sequence END) AS first_sequence,
  count_if(received_time_ns BETWEEN {WINDOW[0]} AND {WINDOW[1]}) AS segments FROM broken_chain GROUP BY ALL""")
def k04(t):
    return chain.window_anchor(t.broken_chain, *WINDOW).select("chain_id", "anchor_sequence", "first_sequence", "segments")


@query("f07_last_n_segments", with_views("chain") + """
SELECT chain_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY sequence DESC) AS rk FROM chain) WHERE rk <= 20""")
def f07(t):
    newest = W.partitionBy("chain_id").orderBy(F.desc("sequence"))
    return t.chain.withColumn("rk", F.row_number().over(newest)).filter("rk <= 20").select("chain_id", "sequence")


@query("d27_journal_health", with_views("chain") + f"""
SELECT chain_id, count(*) AS rounds, round(count_if(kind <> 'error') / count(*), 6) AS ok_rate, round(count_if(event_id % 7 = 0) / count(*), 6) AS degraded_rate,
  round((max(received_time_ns) - min(received_time_ns)) / 1e9 / nullif(count(*) - 1, 0), 3) AS mean_period_s FROM chain GROUP BY ALL""")
def d27(t):
    n = F.count("*")
    out = t.chain.groupBy("chain_id").agg(
        n.alias("rounds"), (F.count_if(F.col("kind") != "error") / n).alias("ok_rate"),
        (F.count_if(F.col("event_id") % 7 == 0) / n).alias("degraded_rate"),
        F.try_divide((F.max("received_time_ns") - F.min("received_time_ns")) / F.lit(1e9), n - 1).alias("mean_period_s"),
    )
    return rounded(rounded(out, 6, ["ok_rate", "degraded_rate"]), 3, ["mean_period_s"])


FAILURES = "CASE WHEN event_id % 6 = 0 THEN kind || ':timeout' WHEN event_id % 10 = 0 THEN kind || ':refused' END"


def failures(t):
    e = F.col("event_id")
    reason = F.when(e % 6 == 0, ":timeout").when(e % 10 == 0, ":refused")
    return t.chain.withColumn("failure", F.concat("kind", reason))


@query("h10_failure_counts", with_views("chain", more={"f": f"SELECT {FAILURES} AS failure FROM chain"}) + """
SELECT split_part(failure, ':', 1) AS endpoint, split_part(failure, ':', 2) AS reason, count(*) AS failures FROM f WHERE failure IS NOT NULL GROUP BY ALL""")
def h10(t):
    rows = failures(t).filter(F.col("failure").isNotNull())
    part = lambda i: F.split_part("failure", F.lit(":"), F.lit(i))
    return rows.groupBy(part(1).alias("endpoint"), part(2).alias("reason")).agg(F.count("*").alias("failures"))


@query("h11_safe_share", with_views("chain", more={"f": f"SELECT *, {FAILURES} AS failure FROM chain"}) + """
SELECT kind, round(CASE WHEN count_if(event_id % 5 = 0) = 0 THEN 0 ELSE count_if(failure IS NOT NULL AND event_id % 5 = 0) / count_if(event_id % 5 = 0) END, 4) AS failure_share FROM f GROUP BY ALL""")
def h11(t):
    fifth = F.col("event_id") % 5 == 0
    rows = failures(t).groupBy("kind").agg(F.count_if(fifth & F.col("failure").isNotNull()).alias("a"), F.count_if(fifth).alias("n"))
    return rounded(rows.select("kind", rules.safe_share(F.col("a"), F.col("n"), 6).alias("failure_share")), 4)


ENDPOINTS = ("premium_index", "perp_book", "spot_book")
EVERY, LAST = 5, 20
# Every fifth round asks three endpoints; each fails and leaves symbols out by its own rule.
HEALTH_SQL = {
    "segments": f"""
    SELECT *, sequence % {EVERY} = 0 AS asked, event_id % 16 AS depth_failed,
      row_number() OVER (PARTITION BY chain_id ORDER BY sequence DESC) AS rk FROM chain""",
    "recent": f"SELECT * FROM segments WHERE rk <= {LAST}",
    "told": f"""
    SELECT chain_id, unnest(['premium_index', 'perp_book', 'spot_book']) AS endpoint, count(*) AS rounds, count_if(asked) AS snapshot_rounds,
      unnest([count_if(asked AND event_id % 6 = 0), count_if(asked AND event_id % 10 = 0), count_if(asked AND event_id % 15 = 0)]) AS failures,
      unnest([sum(CASE WHEN asked THEN event_id % 4 ELSE 0 END), sum(CASE WHEN asked THEN event_id % 3 ELSE 0 END), 0])::BIGINT AS excluded_total,
      sum(depth_failed) / (15.0::DOUBLE * count(*)) AS depth_failure_rate, max(sequence) AS last_sequence, max(received_time_ns) AS newest_ns
    FROM recent GROUP BY chain_id""",
}


def health_segments(t):
    """Rounds of a journal as segments: what failed, what was left out, how many depth requests went unanswered."""
    e, asked = F.col("event_id"), F.col("sequence") % EVERY == 0
    failures = F.array_compact(F.array(*[F.when(asked & (e % n == 0), f"{name}:timeout") for name, n in zip(ENDPOINTS, (6, 10, 15), strict=True)]))
    left_out = F.create_map(F.lit(ENDPOINTS[0]), F.when(asked, e % 4).otherwise(0), F.lit(ENDPOINTS[1]), F.when(asked, e % 3).otherwise(0))
    return t.chain.withColumns({"failures": failures, "excluded": left_out, "depth_asked": F.lit(15), "depth_failed": e % 16})


@query("d26_endpoint_health", with_views("chain", more=HEALTH_SQL) + """
SELECT chain_id, endpoint, rounds, snapshot_rounds, failures, round(CASE WHEN snapshot_rounds > 0 THEN failures / snapshot_rounds ELSE 0 END, 6) AS failure_rate,
  excluded_total, round(depth_failure_rate, 6) AS depth_failure_rate, last_sequence, newest_ns FROM told""")
def d26(t):
    return rounded(endpoints.endpoint_health(health_segments(t), "chain_id", ENDPOINTS, last=LAST, every=EVERY), 6)


@query("d39_data_freshness", with_views("chain") + """
SELECT kind, coalesce(max(CASE WHEN event_id % 8 = 0 THEN received_time_ns END), max(received_time_ns)) AS available_ns FROM chain GROUP BY ALL""")
def d39(t):
    tail = F.max(F.when(F.col("event_id") % 8 == 0, F.col("received_time_ns")))
    return t.chain.groupBy("kind").agg(F.coalesce(tail, F.max("received_time_ns")).alias("available_ns"))


@query("h14_leg_keys", with_views("legs_type") + """
SELECT DISTINCT contract_id, split_part(contract_id, ':', 1) AS market, 'perp:' || instrument_id AS perp_leg, 'spot:' || instrument_id AS spot_leg FROM legs_type""")
def h14(t):
    return t.legs().select(
        "contract_id", carry.leg_market(F.col("contract_id")).alias("market"),
        carry.perp_leg(F.col("instrument_id")).alias("perp_leg"), carry.spot_leg(F.col("instrument_id")).alias("spot_leg"),
    ).distinct()


@query("d19_complete_window_median", with_views("bars_type") + f"""
SELECT contract_id, close_time_ns, CASE WHEN count(*) OVER w = 5 THEN median(quote_volume) OVER w END AS median_quote_volume FROM bars_type
WINDOW w AS (PARTITION BY contract_id ORDER BY close_time_ns RANGE BETWEEN {4 * DAY} PRECEDING AND CURRENT ROW)""")
def d19(t):
    w = W.partitionBy("contract_id").orderBy("close_time_ns").rangeBetween(-4 * DAY_NS, 0)
    med = F.when(F.count("*").over(w) == 5, F.percentile("quote_volume", F.lit(0.5)).over(w))
    return t.bars().select("contract_id", "close_time_ns", med.alias("median_quote_volume"))


@query("c12_fold_membership_restriction", with_views("hour_bars") + f"""
SELECT sample_id, requested FROM (SELECT source_id AS sample_id, true AS requested FROM hour_bars WHERE trade_count >= 2
  UNION ALL SELECT source_id || ':x', false FROM hour_bars WHERE trade_count >= 6)""")
def c12(t):
    bars = t.hour_bars.select("source_id", "trade_count")
    wanted = bars.filter("trade_count >= 2").select("source_id").unionByName(
        bars.filter("trade_count >= 6").select(F.concat("source_id", F.lit(":x")).alias("source_id"))
    )
    found = bars.join(wanted, "source_id", "left_semi").select(F.col("source_id").alias("sample_id"), F.lit(True).alias("requested"))
    absent = wanted.join(bars, "source_id", "left_anti").select(F.col("source_id").alias("sample_id"), F.lit(False).alias("requested"))
    return found.unionByName(absent)
