"""Samples, labels and single-position evaluation over ticks and hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog import panelsql as P
from tidepanel.catalog import settings as S
from tidepanel.catalog.registry import query, rounded, six, six_sql
from tidepanel.catalog.sqlviews import HOUR, SECOND, with_views
from tidepanel.functions.timefns import DAY_NS, HOUR_NS, MINUTE_NS, int_div
from tidepanel.operators import samples, stats, walkforward

REFERENCE = "view"
SPREAD_BPS = 2.0
SAMPLES_SQL = {
    "samples": f"""
    SELECT p.instrument_id, p.instrument_id || ':' || p.open_time_ns AS sample_id,
      p.available_time_ns AS decision_ns, label_available_ns,
      CASE WHEN r.available_time_ns <= p.available_time_ns THEN [prev_id, p.source_id, r.source_id]
        ELSE [prev_id, p.source_id] END AS input_ids,
      p.close / prev_close - 1 AS observed_return, (p.high - p.low) / p.close * 10000 AS range_bps,
      CASE WHEN prev_volume > 0 THEN p.base_volume / prev_volume - 1 END AS volume_change,
      CASE WHEN r.available_time_ns <= p.available_time_ns THEN p.close / r.close - 1 END AS cross_basis,
      next_close / p.close - 1 AS forward_return
    FROM (SELECT *, lag(close) OVER w AS prev_close, lag(base_volume) OVER w AS prev_volume,
        lag(source_id) OVER w AS prev_id, lead(close) OVER w AS next_close,
        lead(available_time_ns) OVER w AS label_available_ns
      FROM hour_bars WHERE instrument_id <> '{REFERENCE}'
      WINDOW w AS (PARTITION BY instrument_id ORDER BY open_time_ns)) p
    LEFT JOIN hour_bars r ON r.instrument_id = '{REFERENCE}' AND r.open_time_ns = p.open_time_ns
    WHERE prev_close IS NOT NULL AND next_close IS NOT NULL""",
}
DRAW = P.random_score(S.PANEL.random_seed, "sample_id")
SIGNALS_SQL = {
    **SAMPLES_SQL,
    "signals": f"""
    SELECT s.*, candidate, CASE candidate WHEN 'no_trade' THEN 0 WHEN 'momentum' THEN CAST(sign(observed_return) AS INT)
        WHEN 'mean_reversion' THEN -CAST(sign(observed_return) AS INT) ELSE CAST(floor({DRAW} * 3) AS INT) - 1 END AS signal
    FROM samples s CROSS JOIN (VALUES ('no_trade'), ('momentum'), ('mean_reversion'), ('random')) c(candidate)""",
    "net": f"""
    SELECT s.*, scenario, CASE WHEN signal = 0 THEN 0 ELSE signal * forward_return - cost END AS net_return
    FROM signals s CROSS JOIN (VALUES {', '.join(f"('{c.scenario}', {c.round_trip(SPREAD_BPS)!r}::DOUBLE)" for c in S.SIGNAL_COSTS)}) v(scenario, cost)""",
}


def bar_samples(t):
    bars = t.hour_bars
    return samples.bar_samples(
        bars.filter(F.col("instrument_id") != REFERENCE), bars.filter(F.col("instrument_id") == REFERENCE)
    )


def signal_returns(t):
    signals = stats.baseline_signals(bar_samples(t), seed=S.PANEL.random_seed)
    return stats.net_returns(signals, S.SIGNAL_COSTS, SPREAD_BPS)


@query("c01_cross_venue_samples", with_views("hour_bars", more=SAMPLES_SQL) + """
SELECT sample_id, decision_ns, label_available_ns, array_to_string(input_ids, ',') AS input_ids,
  round(observed_return, 9) AS observed_return, round(range_bps, 6) AS range_bps,
  round(volume_change, 9) AS volume_change, round(cross_basis, 9) AS cross_basis,
  round(forward_return, 9) AS forward_return FROM samples""")
def c01(t):
    out = bar_samples(t).drop("instrument_id").withColumn("input_ids", F.array_join("input_ids", ","))
    out = rounded(out, 6, ["range_bps"])
    return rounded(out, 9, ["observed_return", "volume_change", "cross_basis", "forward_return"])


LABEL_HORIZON = 30 * MINUTE_NS
LABELS_SQL = {
    "labels_raw": f"""
    SELECT k.instrument_id, k.event_id AS source_event_id, p.event_id AS outcome_event_id,
      k.event_time_ns AS label_start_ns, p.event_time_ns AS label_end_ns, p.available_time_ns AS label_available_ns,
      p.price / k.price - 1 AS gross_return
    FROM (SELECT *, event_time_ns + {LABEL_HORIZON} AS target FROM ticks) k
    ASOF JOIN ticks p ON p.instrument_id = k.instrument_id AND p.event_time_ns >= k.target""",
    "return_labels": """
    SELECT *, coalesce(lead(label_start_ns) OVER (PARTITION BY instrument_id ORDER BY label_start_ns, source_event_id)
      < label_end_ns, false) AS overlaps_next FROM labels_raw""",
}


def return_labels(t):
    return samples.forward_labels(
        t.ticks, horizon_ns=LABEL_HORIZON, round_trip_cost_bps=50.0, bucket_ns=6 * HOUR_NS
    )


# Of prices of the same instant the one with the smallest id counts; against a zero price nothing is measured.
PRICED_SQL = {
    "points": "SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time_ns ORDER BY event_id) = 1",
    "priced": f"""
    SELECT k.instrument_id, k.event_id AS source_event_id, p.event_id AS outcome_event_id,
      k.event_time_ns AS label_start_ns, p.event_time_ns AS label_end_ns, p.available_time_ns AS label_available_ns,
      p.price / nullif(k.price, 0) - 1 AS gross_return
    FROM (SELECT *, event_time_ns + {LABEL_HORIZON} AS target FROM ticks) k
    ASOF JOIN points p ON p.instrument_id = k.instrument_id AND p.event_time_ns >= k.target""",
}


@query("c02_forward_asof_labels", with_views("ticks", more=PRICED_SQL) + f"""
SELECT instrument_id, source_event_id, outcome_event_id, label_start_ns, label_end_ns, label_available_ns,
  {six_sql("gross_return")} AS gross_return, {six_sql("gross_return - 0.005::DOUBLE")} AS net_return,
  CASE WHEN gross_return > 0.005 THEN 1 WHEN gross_return < -0.005 THEN -1 WHEN gross_return IS NOT NULL THEN 0 END AS direction
FROM priced""")
def c02(t):
    out = return_labels(t).drop("overlaps_next")
    return out.withColumns({c: six(F.col(c)) for c in ("gross_return", "net_return")})


@query("e16_label_overlap", with_views("ticks", more=LABELS_SQL) + """
SELECT instrument_id, source_event_id, overlaps_next FROM return_labels""")
def e16(t):
    return return_labels(t).select("instrument_id", "source_event_id", "overlaps_next")


LOOKBACK = 5
MAX_AGE = 60 * SECOND
STATES_SQL = {
    "states": f"""
    SELECT instrument_id, event_id, event_time_ns AS decision_ns, available_time_ns - {SECOND} AS available_time_ns,
      price AS mid_price, price * 0.999::DOUBLE AS best_bid, price * 1.001::DOUBLE AS best_ask, quantity AS bid_size,
      CAST(event_id % 7 AS DOUBLE) AS ask_size, CASE WHEN side = 'buy' THEN quantity ELSE 0 END AS buy_quantity,
      CASE WHEN side = 'sell' THEN quantity ELSE 0 END AS sell_quantity, event_id % 11 <> 0 AS book_valid,
      (event_id % 5) * {30 * SECOND} AS feed_age_ns FROM ticks""",
    "returns": """
    SELECT *, mid_price / lag(mid_price) OVER (PARTITION BY instrument_id ORDER BY decision_ns, event_id) - 1 AS r
    FROM states""",
}


def market_states(t):
    """Book and trade state at each tick, with some stale and some invalid books."""
    e = F.col("event_id")
    return t.ticks.select(
        "instrument_id", "event_id", F.col("event_time_ns").alias("decision_ns"),
        (F.col("available_time_ns") - F.lit(SECOND)).alias("available_time_ns"),
        F.col("price").alias("mid_price"), (F.col("price") * 0.999).alias("best_bid"),
        (F.col("price") * 1.001).alias("best_ask"), F.col("quantity").alias("bid_size"),
        (e % 7).cast("double").alias("ask_size"),
        F.when(F.col("side") == "buy", F.col("quantity")).otherwise(0.0).alias("buy_quantity"),
        F.when(F.col("side") == "sell", F.col("quantity")).otherwise(0.0).alias("sell_quantity"),
        (e % 11 != 0).alias("book_valid"), ((e % 5) * F.lit(30 * SECOND)).alias("feed_age_ns"),
    )


# Against a zero price nothing is measured.
GUARDED_SQL = {**STATES_SQL, "returns": STATES_SQL["returns"].replace("mid_price / lag(mid_price) OVER (PARTITION BY instrument_id ORDER BY decision_ns, event_id)",
                                                                    "mid_price / nullif(lag(mid_price) OVER (PARTITION BY instrument_id ORDER BY decision_ns, event_id), 0)")}


@query("e01_point_in_time_features", with_views("ticks", more=GUARDED_SQL) + f"""
SELECT instrument_id, event_id, {six_sql("r")} AS simple_return, {six_sql("sqrt(avg(r * r) OVER w)")} AS realized_volatility,
  array_to_string(list(event_id) OVER w, ',') AS lineage, max(available_time_ns) OVER w AS input_available_ns,
  book_valid AND feed_age_ns <= {MAX_AGE} AS feed_healthy,
  round(CASE WHEN buy_quantity + sell_quantity <> 0 THEN (buy_quantity - sell_quantity) / (buy_quantity + sell_quantity) END, 9)
    AS trade_flow_imbalance
FROM returns WINDOW w AS (PARTITION BY instrument_id ORDER BY decision_ns, event_id
  ROWS BETWEEN {LOOKBACK - 1} PRECEDING AND CURRENT ROW)""")
def e01(t):
    out = samples.point_in_time_features(
        market_states(t), keys=["instrument_id"], lookback=LOOKBACK, max_feed_age_ns=MAX_AGE,
        bucket=int_div(F.col("decision_ns"), DAY_NS), chunk_rows=256,
    ).withColumn("lineage", F.array_join(F.transform("input_event_ids", lambda i: i.cast("string")), ","))
    out = out.withColumns({c: six(F.col(c)) for c in ("simple_return", "realized_volatility")})
    return rounded(out, 9, ["trade_flow_imbalance"]).select(
        "instrument_id", "event_id", "simple_return", "realized_volatility", "lineage", "input_available_ns",
        "feed_healthy", "trade_flow_imbalance",
    )


@query("b04_staleness_gated_book", with_views("ticks", more=STATES_SQL) + f"""
SELECT event_id, round(CASE WHEN book_valid AND feed_age_ns <= {MAX_AGE}
    THEN (best_ask - best_bid) / mid_price * 10000 END, 6) AS spread_bps,
  round(CASE WHEN book_valid AND feed_age_ns <= {MAX_AGE} AND bid_size + ask_size <> 0
    THEN (bid_size - ask_size) / (bid_size + ask_size) END, 9) AS book_imbalance FROM states""")
def b04(t):
    healthy = F.col("book_valid") & (F.col("feed_age_ns") <= MAX_AGE)
    spread = F.try_divide(F.col("best_ask") - F.col("best_bid"), F.col("mid_price")) * 10_000.0
    out = market_states(t).select(
        "event_id", F.when(healthy, spread).alias("spread_bps"),
        F.when(healthy, samples.imbalance(F.col("bid_size"), F.col("ask_size"))).alias("book_imbalance"),
    )
    return rounded(rounded(out, 6, ["spread_bps"]), 9, ["book_imbalance"])


@query("h07_imbalance", with_views("ticks") + """
SELECT instrument_id, round(CASE WHEN b + s <> 0 THEN (b - s) / (b + s) END, 9) AS imbalance
FROM (SELECT instrument_id, sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) AS b,
  sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) AS s FROM ticks GROUP BY ALL)""")
def h07(t):
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("quantity")).otherwise(0.0))
    flow = t.ticks.groupBy("instrument_id").agg(side("buy").alias("b"), side("sell").alias("s"))
    return rounded(flow.select("instrument_id", samples.imbalance(F.col("b"), F.col("s")).alias("imbalance")), 9)


@query("b02_tick_availability", with_views("ticks") + f"""
SELECT instrument_id, count(*) AS rows, count_if(available_time_ns < event_time_ns + (event_id % 3) * {SECOND}) AS refused
FROM ticks GROUP BY ALL""")
def b02(t):
    received = F.col("event_time_ns") + (F.col("event_id") % 3) * F.lit(SECOND)
    return t.ticks.groupBy("instrument_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("available_time_ns") < received).alias("refused")
    )


@query("b03_lookahead_guard", with_views("hour_bars", more=SAMPLES_SQL) + f"""
SELECT count(*) AS rows, count_if(decision_ns > label_available_ns - {HOUR}) AS violations FROM samples""")
def b03(t):
    rows = bar_samples(t).withColumn("known", F.col("label_available_ns") - F.lit(HOUR_NS))
    return samples.lookahead_violations(rows, "decision_ns", "known")


@query("b08_baseline_signals", with_views("hour_bars", more=SIGNALS_SQL) + """
SELECT sample_id, candidate, signal FROM signals""")
def b08(t):
    return stats.baseline_signals(bar_samples(t), seed=S.PANEL.random_seed).select("sample_id", "candidate", "signal")


@query("b09_round_trip_cost", with_views("hour_bars", more=SAMPLES_SQL) + f"""
SELECT sample_id, scenario, round((fee * 2 + range_bps * mult + slip * 2 + fund) / 10000, 9) AS cost
FROM samples CROSS JOIN (VALUES {', '.join(f"('{c.scenario}', {c.fee_bps}::DOUBLE, {c.spread_multiplier}::DOUBLE, {c.slippage_bps}::DOUBLE, {c.funding_bps}::DOUBLE)" for c in S.SIGNAL_COSTS)})
  v(scenario, fee, mult, slip, fund)""")
def b09(t):
    costs = F.array(*[
        F.struct(F.lit(c.scenario).alias("scenario"), stats.round_trip_cost(c, F.col("range_bps")).alias("cost"))
        for c in S.SIGNAL_COSTS
    ])
    return rounded(bar_samples(t).withColumn("_c", F.explode(costs)).select("sample_id", "_c.scenario", "_c.cost"), 9)


@query("b05_threshold_signal", with_views("hour_bars", more=SAMPLES_SQL) + """
SELECT sample_id, CASE WHEN observed_return > 0.1 THEN 1 WHEN observed_return < -0.1 THEN -1 ELSE 0 END AS signal
FROM samples""")
def b05(t):
    return bar_samples(t).select("sample_id", stats.threshold_signal(F.col("observed_return"), 0.1).alias("signal"))


SIGMOID = "CASE WHEN observed_return >= 0 THEN 1 / (1 + exp(-observed_return)) ELSE exp(observed_return) / (1 + exp(observed_return)) END"


@query("b07_probability_margin_signal", with_views("hour_bars", more=SAMPLES_SQL) + f"""
SELECT sample_id, CASE WHEN p - 0.5 > 0.05 THEN 1 WHEN p - 0.5 < -0.05 THEN -1 ELSE 0 END AS signal
FROM (SELECT sample_id, {SIGMOID} AS p FROM samples)""")
def b07(t):
    from tidepanel.operators.models import sigmoid

    return bar_samples(t).select(
        "sample_id", stats.margin_signal(sigmoid(F.col("observed_return")), 0.05).alias("signal")
    )


@query("h08_sigmoid", with_views("hour_bars", more=SAMPLES_SQL) + f"""
SELECT sample_id, round({SIGMOID}, 9) AS probability FROM samples""")
def h08(t):
    from tidepanel.operators.models import sigmoid

    return rounded(bar_samples(t).select("sample_id", sigmoid(F.col("observed_return")).alias("probability")), 9)


@query("d32_probability_metrics", with_views("hour_bars", more={**SAMPLES_SQL, "s": f"""
    SELECT instrument_id, {SIGMOID} AS p, CASE WHEN forward_return > 0 THEN 1.0::DOUBLE ELSE 0 END AS y FROM samples"""}) + """
SELECT instrument_id, count(*) AS samples, round(avg((p - y) * (p - y)), 9) AS brier,
  round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss
FROM (SELECT instrument_id, y, least(greatest(p, 1e-15), 1 - 1e-15) AS p FROM s) GROUP BY ALL""")
def d32(t):
    from tidepanel.operators.models import sigmoid

    scored = bar_samples(t).withColumn("probability", sigmoid(F.col("observed_return")))
    return rounded(stats.probability_metrics(scored, ["instrument_id"]), 9)


@query("d03_signal_pnl", with_views("hour_bars", more=SIGNALS_SQL) + """
SELECT instrument_id, candidate, scenario, count(*) AS samples, count_if(signal <> 0) AS trade_count,
  round(sum(net_return), 9) AS total_net_return,
  round(CASE WHEN count_if(signal <> 0) > 0 THEN sum(net_return) / count_if(signal <> 0) ELSE 0 END, 9) AS mean_net_return,
  round(CASE WHEN count_if(signal <> 0) > 0 THEN count_if(signal <> 0 AND net_return > 0) / count_if(signal <> 0) ELSE 0 END, 9)
    AS win_rate FROM net GROUP BY ALL""")
def d03(t):
    return rounded(stats.evaluate_signals(signal_returns(t), ["instrument_id", "candidate", "scenario"]), 9)


BOOT = dict(block=4, repetitions=200, seed=17)
SERIES_SQL = {
    **SIGNALS_SQL,
    "series": """
    SELECT instrument_id, candidate, net_return, row_number() OVER w - 1 AS at, count(*) OVER (PARTITION BY instrument_id, candidate) AS n
    FROM net WHERE scenario = 'base' WINDOW w AS (PARTITION BY instrument_id, candidate ORDER BY decision_ns)""",
}


def bootstrap_sql(series: str, group: str, *, block: int, repetitions: int, seed: int) -> dict[str, str]:
    """`boot_test` from `series(group, net_return, at, n)`."""
    low, high = int(0.025 * (repetitions - 1)), int(0.975 * (repetitions - 1))
    on = " AND ".join(f"s.{c} = d.{c}" for c in group.split(", "))
    return {
        "boot_cells": f"SELECT {group}, any_value(n) AS n, avg(net_return) AS observed_mean FROM {series} GROUP BY {group}",
        "boot_draws": f"""
    SELECT *, ('0x' || substr(md5('{seed}:' || rep || ':' || (j // {block})), 1, 12))::BIGINT % n AS st
    FROM (SELECT *, unnest(range(n)) AS j FROM (
      SELECT *, unnest(range({repetitions})) AS rep FROM boot_cells WHERE n >= {block}))""",
        "boot_means": f"""
    SELECT {', '.join('d.' + c for c in group.split(', '))}, d.n, observed_mean, rep, sum(s.net_return) / d.n AS mean
    FROM boot_draws d JOIN {series} s ON {on} AND s.at = (d.st + j % {block}) % d.n
    GROUP BY {', '.join('d.' + c for c in group.split(', '))}, d.n, observed_mean, rep""",
        "boot_test": f"""
    SELECT {group}, n, observed_mean, max(CASE WHEN rk = {low} THEN mean END) AS lower,
      max(CASE WHEN rk = {high} THEN mean END) AS upper,
      (count_if(mean - observed_mean >= observed_mean) + 1) / {repetitions + 1}.0::DOUBLE AS p_value
    FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY mean, rep) - 1 AS rk FROM boot_means)
    GROUP BY {group}, n, observed_mean""",
    }


@query("d06_block_bootstrap", with_views("hour_bars", more={**SERIES_SQL, **bootstrap_sql("series", "instrument_id, candidate", **BOOT)}) + """
SELECT instrument_id, candidate, n, round(observed_mean, 9) AS observed_mean, round(lower, 8) AS lower,
  round(upper, 8) AS upper, round(p_value, 9) AS p_value FROM boot_test""")
def d06(t):
    base = signal_returns(t).filter(F.col("scenario") == "base")
    out = stats.bootstrap_test(base, ["instrument_id", "candidate"], "decision_ns", **BOOT)
    return rounded(rounded(out, 8, ["lower", "upper"]), 9, ["observed_mean", "p_value"])


@query("e15_benjamini_hochberg", with_views("hour_bars", more={**SERIES_SQL, **bootstrap_sql("series", "instrument_id, candidate", **BOOT),
    "raw": """
    SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY p_value, candidate) AS rk,
      count(*) OVER (PARTITION BY instrument_id) AS m FROM boot_test"""}) + """
SELECT instrument_id, candidate, round(p_value, 9) AS p_value, round(least(1, min(p_value * m / rk)
  OVER (PARTITION BY instrument_id ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q_value FROM raw""")
def e15(t):
    base = signal_returns(t).filter(F.col("scenario") == "base")
    tests = stats.bootstrap_test(base, ["instrument_id", "candidate"], "decision_ns", **BOOT)
    out = stats.benjamini_hochberg(tests, ["instrument_id"], "candidate")
    return rounded(out.select("instrument_id", "candidate", "p_value", "q_value"), 9)


SPLIT_SQL = """
    SELECT *, row_number() OVER (PARTITION BY instrument_id, candidate, scenario ORDER BY decision_ns) AS rn,
      count(*) OVER (PARTITION BY instrument_id, candidate, scenario) AS n FROM net"""


def out_of_sample(t, fraction: float = 0.3):
    """The chronologically last part of each instrument's samples."""
    from pyspark.sql import Window as W

    cell = W.partitionBy("instrument_id")
    n = F.count("*").over(cell)
    rn = F.row_number().over(cell.orderBy("decision_ns"))
    return bar_samples(t).withColumns({"_n": n, "_rn": rn}).withColumn(
        "is_oos", F.col("_rn") > F.col("_n") - F.ceil(F.col("_n") * F.lit(fraction))
    ).drop("_n", "_rn")


@query("d33_chronological_oos", with_views("hour_bars", more={**SIGNALS_SQL, "split": SPLIT_SQL}) + """
SELECT instrument_id, candidate, scenario, count_if(rn <= n - ceil(n * 0.3::DOUBLE)) AS train_samples,
  count_if(rn > n - ceil(n * 0.3::DOUBLE)) AS oos_samples,
  round(sum(CASE WHEN rn > n - ceil(n * 0.3::DOUBLE) THEN net_return ELSE 0 END), 9) AS oos_net_return,
  round(count(cross_basis) / count(*), 9) AS coverage FROM split GROUP BY ALL""")
def d33(t):
    signals = stats.baseline_signals(out_of_sample(t), seed=S.PANEL.random_seed)
    net = stats.net_returns(signals, S.SIGNAL_COSTS, SPREAD_BPS)
    return rounded(
        net.groupBy("instrument_id", "candidate", "scenario").agg(
            F.count_if(~F.col("is_oos")).alias("train_samples"),
            F.count_if("is_oos").alias("oos_samples"),
            F.sum(F.when(F.col("is_oos"), F.col("net_return")).otherwise(0.0)).alias("oos_net_return"),
            (F.count("cross_basis") / F.count("*")).alias("coverage"),
        ), 9,
    )


@query("p13_quick_oos_research", with_views("hour_bars", more={**SIGNALS_SQL, "split": SPLIT_SQL}) + """
SELECT candidate, scenario, count(*) AS samples, count_if(signal <> 0) AS trade_count,
  round(sum(net_return), 9) AS total_net_return
FROM split WHERE rn > n - ceil(n * 0.3::DOUBLE) GROUP BY ALL""")
def p13(t):
    signals = stats.baseline_signals(out_of_sample(t).filter("is_oos"), seed=S.PANEL.random_seed)
    net = stats.net_returns(signals, S.SIGNAL_COSTS, SPREAD_BPS)
    out = stats.evaluate_signals(net, ["candidate", "scenario"])
    return rounded(out.select("candidate", "scenario", "samples", "trade_count", "total_net_return"), 9)


@query("e21_chronology_check", with_views("ticks") + """
SELECT a.instrument_id, rows - times AS repeated_times, rows - ids AS repeated_ids FROM (
  SELECT instrument_id, count(*) AS rows, count(DISTINCT event_time_ns) AS times, count(DISTINCT event_id) AS ids
  FROM ticks GROUP BY ALL) a""")
def e21(t):
    return walkforward.chronology_violations(t.ticks, ["instrument_id"], "event_time_ns", "event_id")


@query("e22_validation_halves", with_views("hour_bars", more=SAMPLES_SQL) + """
SELECT sample_id, CASE WHEN row_number() OVER (PARTITION BY instrument_id ORDER BY decision_ns)
  <= count(*) OVER (PARTITION BY instrument_id) // 2 THEN 'calibration' ELSE 'selection' END AS half FROM samples""")
def e22(t):
    return walkforward.chronological_split(bar_samples(t), ["instrument_id"], "decision_ns").select("sample_id", "half")


GRID_SQL = {
    **SAMPLES_SQL,
    "ranked": """
    SELECT instrument_id, abs(observed_return) AS threshold, row_number() OVER (PARTITION BY instrument_id
      ORDER BY abs(observed_return)) - 1 AS rk, count(*) OVER (PARTITION BY instrument_id) AS n FROM samples""",
    "grid": """
    SELECT DISTINCT instrument_id, threshold FROM ranked
    WHERE rk IN (SELECT unnest(list_transform(range(8), lambda i: i * (n - 1) // 7)))
    UNION SELECT DISTINCT instrument_id, 0 FROM samples""",
}


@query("f05_threshold_grid", with_views("hour_bars", more=GRID_SQL) + """
SELECT instrument_id, round(threshold, 9) AS threshold FROM grid""")
def f05(t):
    return rounded(stats.threshold_grid(bar_samples(t), ["instrument_id"], F.col("observed_return")), 9)


@query("f06_best_threshold", with_views("hour_bars", more={**GRID_SQL, "trials": f"""
    SELECT g.instrument_id, threshold, sum(CASE WHEN observed_return > threshold THEN forward_return - {S.SIGNAL_COSTS[0].round_trip(SPREAD_BPS)!r}
        WHEN observed_return < -threshold THEN -forward_return - {S.SIGNAL_COSTS[0].round_trip(SPREAD_BPS)!r} ELSE 0 END) AS total,
      count_if(abs(observed_return) > threshold) AS trades
    FROM grid g JOIN samples s USING (instrument_id) GROUP BY ALL"""}) + """
SELECT instrument_id, round(threshold, 9) AS threshold, round(total, 9) AS total_net_return, trades AS trade_count
FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY total DESC, threshold DESC) AS rk
  FROM trials WHERE trades >= 10) WHERE rk = 1""")
def f06(t):
    rows = bar_samples(t)
    score = F.col("observed_return")
    grid = stats.threshold_grid(rows, ["instrument_id"], score)
    return rounded(
        stats.best_threshold(
            rows, grid, ["instrument_id"], score, cost=S.SIGNAL_COSTS[0].round_trip(SPREAD_BPS), minimum_trades=10
        ), 9,
    )
