"""Depth-of-book queries (H, D20 to D25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.registry import query, rounded, six, six_sql
from tidepanel.catalog.reports import report
from tidepanel.catalog.sqlviews import HOUR, with_views
from tidepanel.functions.timefns import DAY_NS, HOUR_NS, int_div
from tidepanel.operators import chain, endpoints, skewsafe
from tidepanel.operators import microstructure as micro

NOTIONALS = (5_000.0, 50_000.0, 150_000.0)
BOOK_SQL = {
    "sides": """
    SELECT *, 'ask' AS side, lvl AS level, price AS px FROM books UNION ALL
    SELECT *, 'bid', CASE WHEN l_orderkey % 23 = 0 THEN n_levels + 1 - lvl ELSE lvl END, bid_price FROM books""",
    "tops": """
    SELECT l_orderkey AS book_id, instrument_id, market, tier, received_time_ns,
      max(CASE WHEN side = 'bid' AND level = 1 THEN px END) AS best_bid, max(CASE WHEN side = 'ask' AND level = 1 THEN px END) AS best_ask,
      count_if(side = 'ask') AS n, sum(CASE WHEN side = 'bid' THEN px * quantity END) AS bn, sum(CASE WHEN side = 'ask' THEN px * quantity END) AS an
    FROM sides GROUP BY ALL""",
    "valid": """
    SELECT *, CASE WHEN book_id % 23 = 0 AND n > 1 THEN 'BIDS_UNSORTED' WHEN best_bid >= best_ask THEN 'BOOK_CROSSED' END AS reason,
      (best_bid + best_ask) / 2 AS mid FROM tops""",
    "cums": """
    SELECT l_orderkey AS book_id, side, level, px, quantity, sum(px * quantity) OVER w AS cq, sum(quantity) OVER w AS cb
    FROM sides WINDOW w AS (PARTITION BY l_orderkey, side ORDER BY level)""",
    "fills": f"""
    SELECT book_id, side, notional, min(notional / (cb - quantity + (notional - (cq - px * quantity)) / px)) AS vwap
    FROM (SELECT *, row_number() OVER (PARTITION BY book_id, side, notional ORDER BY level) AS rk
      FROM cums CROSS JOIN (VALUES {', '.join(f'({n}::DOUBLE)' for n in NOTIONALS)}) v(notional) WHERE cq >= notional) WHERE rk = 1 GROUP BY ALL""",
    "obs": f"""
    SELECT v.*, k.notional, CASE WHEN a.vwap IS NOT NULL AND b.vwap IS NOT NULL
      THEN round_even(greatest(a.vwap / mid - 1, 1 - b.vwap / mid) * 10000, 6) END AS slippage_bps
    FROM valid v CROSS JOIN (VALUES {', '.join(f'({n}::DOUBLE)' for n in NOTIONALS)}) k(notional)
    LEFT JOIN fills a ON a.book_id = v.book_id AND a.notional = k.notional AND a.side = 'ask'
    LEFT JOIN fills b ON b.book_id = v.book_id AND b.notional = k.notional AND b.side = 'bid' WHERE reason IS NULL""",
}


def observations(t):
    return report(t, "depth", lambda: micro.depth_observations(t.book_levels, NOTIONALS))


@query("h02_walk_notional", with_views("books", more=BOOK_SQL) + f"SELECT book_id, side, notional, {six_sql('vwap')} AS vwap FROM fills")
def h02(t):
    return micro.fill_prices(t.book_levels, NOTIONALS).withColumn("vwap", six(F.col("vwap")))


@query("h03_depth_observation", with_views("books", more=BOOK_SQL) + f"""
SELECT book_id, instrument_id, notional, {six_sql('mid')} AS mid, round_even((best_ask - best_bid) / mid * 10000, 6) AS spread_bps, slippage_bps FROM obs""")
def h03(t):
    out = observations(t).select("book_id", "instrument_id", "notional", "mid", "spread_bps", "slippage_bps")
    return out.withColumn("mid", six(F.col("mid")))


@query("h04_book_validity", with_views("books", more=BOOK_SQL) + "SELECT book_id, reason FROM valid")
def h04(t):
    return micro.validate_books(t.book_levels).select("book_id", "reason")


@query("h05_displayed_notional", with_views("books", more=BOOK_SQL) + """
SELECT book_id, round_even(least(bn, an), 2) AS displayed_notional FROM valid WHERE reason IS NULL""")
def h05(t):
    out = micro.validate_books(t.book_levels).filter("reason IS NULL")
    return out.select("book_id", "displayed_notional")


@query("h06_basis_and_spread", with_views("books", more=BOOK_SQL) + """
SELECT instrument_id, market, round(avg((best_ask - best_bid) / mid * 10000), 3) AS mean_spread_bps,
  round(avg((best_ask - mid) / mid * 10000), 3) AS mean_basis_bps FROM valid WHERE reason IS NULL GROUP BY ALL""")
def h06(t):
    books = micro.validate_books(t.book_levels).filter("reason IS NULL")
    out = books.groupBy("instrument_id", "market").agg(
        F.avg("spread_bps").alias("mean_spread_bps"),
        F.avg(F.bround((F.col("best_ask") - F.col("mid")) / F.col("mid") * 10_000.0, 6)).alias("mean_basis_bps"),
    )
    return rounded(out, 3)


@query("h13_top_of_book", with_views("books", more=BOOK_SQL) + f"""
SELECT l_orderkey AS book_id, {six_sql("max(CASE WHEN side = 'bid' THEN px END)")} AS best_bid,
  {six_sql("min(CASE WHEN side = 'ask' THEN px END)")} AS best_ask, arg_max(CASE WHEN side = 'bid' THEN quantity END, CASE WHEN side = 'bid' THEN px END) AS bid_quantity FROM sides GROUP BY l_orderkey""")
def h13(t):
    bid, ask = F.when(F.col("side") == "bid", F.col("price")), F.when(F.col("side") == "ask", F.col("price"))
    out = t.book_levels.groupBy("book_id").agg(
        F.max(bid).alias("best_bid"), F.min(ask).alias("best_ask"), F.max_by("quantity", bid).alias("bid_quantity")
    )
    return out.withColumns({c: six(F.col(c)) for c in ("best_bid", "best_ask")})


LIMITS = dict(minimum=50, minimum_span_ns=DAY_NS, eligibility_notional=5_000.0)
STATS_SQL = {
    **BOOK_SQL,
    "ranked": """
    SELECT instrument_id, market, tier, notional, slippage_bps, row_number() OVER (PARTITION BY instrument_id, notional ORDER BY slippage_bps) AS rk,
      count(*) OVER (PARTITION BY instrument_id, notional) AS n FROM obs WHERE slippage_bps IS NOT NULL""",
    "q": """
    SELECT instrument_id, notional, max(CASE WHEN rk = ceil(n * 0.50) THEN slippage_bps END) AS p50,
      max(CASE WHEN rk = ceil(n * 0.90) THEN slippage_bps END) AS p90, max(CASE WHEN rk = ceil(n * 0.99) THEN slippage_bps END) AS p99
    FROM ranked GROUP BY ALL""",
    "stats": f"""
    SELECT o.instrument_id, any_value(market) AS market, any_value(tier) AS tier, o.notional, count(slippage_bps) AS "count",
      count_if(slippage_bps IS NULL) AS insufficient_depth, any_value(p50) AS p50, any_value(p90) AS p90, any_value(p99) AS p99,
      any_value(e.n) >= {LIMITS['minimum']} AND any_value(e.span) >= {DAY_NS} AS eligible
    FROM obs o LEFT JOIN q ON q.instrument_id = o.instrument_id AND q.notional = o.notional
    LEFT JOIN (SELECT instrument_id, count(*) AS n, max(received_time_ns) - min(received_time_ns) AS span FROM obs
      WHERE notional = 5000 AND slippage_bps IS NOT NULL GROUP BY ALL) e ON e.instrument_id = o.instrument_id GROUP BY o.instrument_id, o.notional""",
    "med": """
    SELECT tier, market, notional, count(*) AS members, count(p50) AS contributing,
      CASE WHEN count(p50) >= 3 THEN quantile_disc(p50, 0.5) END AS p50_of_p50, CASE WHEN count(p90) >= 3 THEN quantile_disc(p90, 0.5) END AS p50_of_p90
    FROM stats WHERE eligible GROUP BY ALL""",
}


def statistics(t):
    return micro.instrument_statistics(observations(t), **LIMITS)


@query("d20_instrument_slippage", with_views("books", more=STATS_SQL) + """
SELECT instrument_id, notional, "count", insufficient_depth, CAST(round(CAST(p50 AS DECIMAL(28,9)), 4) AS DOUBLE) AS p50, CAST(round(CAST(p90 AS DECIMAL(28,9)), 4) AS DOUBLE) AS p90, CAST(round(CAST(p99 AS DECIMAL(28,9)), 4) AS DOUBLE) AS p99, eligible FROM stats""")
def d20(t):
    out = statistics(t).select("instrument_id", "notional", "count", "insufficient_depth", "p50", "p90", "p99", "eligible")
    return rounded(out, 4, ["p50", "p90", "p99"])


@query("d21_nearest_rank_quantile", with_views("ticks", more={"r": "SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY price) AS rk, count(*) OVER (PARTITION BY instrument_id) AS n FROM ticks"}) + """
SELECT instrument_id, v.q AS quantile, max(CASE WHEN rk = ceil(n * v.d) THEN price END) AS value
FROM r CROSS JOIN (VALUES ('0.5000', 0.50), ('0.9000', 0.90), ('0.9900', 0.99)) v(q, d) GROUP BY ALL""")
def d21(t):
    from tidepanel.operators.skewsafe import exact_quantiles

    out = exact_quantiles(t.ticks, ["instrument_id"], "price", list(micro.QUANTILES.values()))
    return out.select("instrument_id", F.col("quantile").cast("string").alias("quantile"), "value")


@query("d22_tier_medians", with_views("books", more=STATS_SQL) + """
SELECT tier, market, notional, members, contributing, CAST(round(CAST(p50_of_p50 AS DECIMAL(28,9)), 4) AS DOUBLE) AS p50_of_p50, CAST(round(CAST(p50_of_p90 AS DECIMAL(28,9)), 4) AS DOUBLE) AS p50_of_p90 FROM med""")
def d22(t):
    return rounded(micro.tier_medians(statistics(t), floor=3), 4, ["p50_of_p50", "p50_of_p90"])


@query("d24_measured_cost_tiers", with_views("books", more=STATS_SQL) + """
SELECT tier, CAST(ceil(max(CASE WHEN notional = 5000 THEN p50_of_p50 END)) AS BIGINT) AS base_bps,
  CAST(ceil(max(CASE WHEN notional = 50000 THEN p50_of_p90 END)) AS BIGINT) AS adverse_bps FROM med GROUP BY ALL""")
def d24(t):
    return micro.measured_cost_tiers(micro.tier_medians(statistics(t), floor=3), order_notional=2_000.0)


WINDOW_SQL = {
    "wk": "SELECT *, book_id * 61 // 604800 AS week FROM obs WHERE notional = 5000",
    "rounds": "SELECT week, instrument_id, tier, market, count(*) AS n, count(slippage_bps) AS filled FROM wk GROUP BY ALL",
}


@query("d23_window_tier_medians", with_views("books", more={**BOOK_SQL, **WINDOW_SQL,
    "wr": "SELECT *, row_number() OVER (PARTITION BY week, instrument_id ORDER BY slippage_bps) AS rk, count(*) OVER (PARTITION BY week, instrument_id) AS c FROM wk WHERE slippage_bps IS NOT NULL",
    "wp": "SELECT week, instrument_id, max(CASE WHEN rk = ceil(c * 0.50) THEN slippage_bps END) AS p50 FROM wr GROUP BY ALL",
    "wn": "SELECT week, max(n) AS rounds FROM rounds GROUP BY ALL"}) + """
SELECT week, tier, market, count(*) AS contributing, round(quantile_disc(p50, 0.5), 4) AS p50_of_p50
FROM rounds JOIN wp USING (week, instrument_id) JOIN wn USING (week) WHERE filled >= greatest(20, rounds // 2) GROUP BY ALL""")
def d23(t):
    from tidepanel.operators.skewsafe import exact_quantiles

    week = int_div(F.col("received_time_ns"), 604_800_000_000_000)
    rows = observations(t).filter("notional = 5000").withColumn("week", week)
    keys = ["week", "instrument_id", "tier", "market"]
    rounds = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("slippage_bps").alias("filled"))
    most = rounds.groupBy("week").agg(F.max("n").alias("rounds"))
    medians = exact_quantiles(rows, keys, "slippage_bps", [micro.QUANTILES["p50"]]).select(*keys, F.col("value").alias("p50"))
    floor = F.greatest(F.lit(20), int_div(F.col("rounds"), 2))
    kept = rounds.join(medians, keys).join(most, "week").filter(F.col("filled") >= floor)
    return rounded(kept.groupBy("week", "tier", "market").agg(
        F.count("*").alias("contributing"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY p50)").alias("p50_of_p50"),
    ), 4)


# Two endpoints asked by the hour: one never has `view`, the other never `error`.
ROUNDS_SQL = {
    "premium": f"""
    SELECT instrument_id, event_time_ns // {HOUR} AS round, last(quantity / 1e6 ORDER BY event_time_ns, event_id) AS rate,
      last(price / 100 ORDER BY event_time_ns, event_id) AS basis_bps FROM ticks WHERE event_id % 3 <> 0 AND instrument_id <> 'view' GROUP BY ALL""",
    "tops_read": f"""
    SELECT instrument_id, event_time_ns // {HOUR} AS round, last(10 + (event_id % 5) * 0.5::DOUBLE ORDER BY event_time_ns, event_id) AS spread_bps
    FROM ticks WHERE event_id % 3 <> 1 AND instrument_id <> 'error' GROUP BY ALL""",
    "merged": """
    SELECT instrument_id, round, rate, basis_bps, spread_bps, CASE WHEN b.there IS NULL THEN 'left_only' WHEN a.here IS NULL THEN 'right_only' ELSE 'both' END AS origin
    FROM (SELECT *, true AS here FROM premium) a FULL JOIN (SELECT *, true AS there FROM tops_read) b USING (instrument_id, round)""",
}


def merged_rounds(t):
    rows = t.ticks.withColumn("round", int_div(F.col("event_time_ns"), HOUR_NS))
    e, keys, order = F.col("event_id"), ["instrument_id", "round"], ["event_time_ns", "event_id"]
    premium = rows.filter((e % 3 != 0) & (F.col("instrument_id") != "view")).withColumns(
        {"rate": F.col("quantity") / 1e6, "basis_bps": F.col("price") / 100})
    tops = rows.filter((e % 3 != 1) & (F.col("instrument_id") != "error")).withColumn("spread_bps", 10 + (e % 5) * F.lit(0.5))
    return endpoints.merge_rounds(
        endpoints.last_of_round(premium, keys, order, ["rate", "basis_bps"]), endpoints.last_of_round(tops, keys, order, ["spread_bps"]), keys)


@query("d25_window_symbol_means", with_views("ticks", more=ROUNDS_SQL) + """
SELECT instrument_id, count_if(origin <> 'right_only') AS premium_rounds, count_if(origin <> 'left_only') AS book_rounds,
  count_if(origin = 'both') AS shared_rounds, round(avg(rate), 9) AS mean_rate,
  round(arg_max(rate, CASE WHEN origin <> 'right_only' THEN round END), 9) AS last_rate, round(avg(basis_bps), 6) AS mean_basis_bps,
  round(avg(spread_bps), 6) AS mean_spread_bps FROM merged GROUP BY ALL""")
def d25(t):
    out = endpoints.symbol_means(merged_rounds(t), "instrument_id", "round")
    return rounded(rounded(out, 9, ["mean_rate", "last_rate"]), 6, ["mean_basis_bps", "mean_spread_bps"])


@query("d25b_endpoint_rounds", with_views("ticks", more=ROUNDS_SQL) + """
SELECT instrument_id, round, origin, round(rate, 9) AS rate, round(basis_bps, 6) AS basis_bps, round(spread_bps, 6) AS spread_bps FROM merged""")
def d25b(t):
    return rounded(rounded(merged_rounds(t), 9, ["rate"]), 6, ["basis_bps", "spread_bps"])


# Every instrument's books are one journal; in tier two every 97th book was recorded with another hash.
JOURNAL_SQL = {
    "journal": """
    SELECT instrument_id AS chain_id, book_id, tier = 2 AND book_id % 97 = 0 AS tampered, row_number() OVER (PARTITION BY instrument_id ORDER BY received_time_ns, book_id) AS sequence FROM tops""",
    "hashed": "SELECT *, sha256(chain_id || '|' || sequence::VARCHAR || '|' || book_id::VARCHAR) AS true_hash FROM journal",
    "checked": """
    SELECT chain_id, tampered AS mismatch, coalesce(lag(tampered) OVER (PARTITION BY chain_id ORDER BY sequence), false) AS unlinked FROM hashed""",
    "verdict": """
    SELECT chain_id, count(*) AS segments, count_if(mismatch OR unlinked) AS faulty_segments,
      concat_ws(',', CASE WHEN bool_or(unlinked) THEN 'CHAIN_LINK_BROKEN' END, CASE WHEN bool_or(mismatch) THEN 'SEGMENT_HASH_MISMATCH' END) AS reasons
    FROM checked GROUP BY ALL""",
    "figures": """
    SELECT instrument_id AS chain_id, bool_or(eligible) AS eligible, CAST(sum("count") AS BIGINT) AS measured,
      CAST(sum(insufficient_depth) AS BIGINT) AS insufficient, max(CASE WHEN notional = 5000 THEN p50 END) AS p50 FROM stats GROUP BY ALL""",
}


def book_journal(t):
    """The books of each instrument as a hash chain in order of receipt, with the hash each record should have."""
    books = micro.validate_books(t.book_levels).select(F.col("instrument_id").alias("chain_id"), "book_id", "tier", "received_time_ns")
    bucket = skewsafe.even_bucket(books, "received_time_ns", 64)
    numbered = skewsafe.with_ordinal(books, ["chain_id"], ["received_time_ns", "book_id"], bucket, "sequence")
    true = F.sha2(F.concat_ws("|", "chain_id", F.col("sequence").cast("string"), F.col("book_id").cast("string")), 256)
    rows = numbered.withColumn("recomputed", true)
    before = rows.select("chain_id", (F.col("sequence") + 1).alias("sequence"), F.col("recomputed").alias("previous_hash"))
    recorded = F.when((F.col("tier") == 2) & (F.col("book_id") % 97 == 0), F.sha2(F.lit("another"), 256)).otherwise(F.col("recomputed"))
    return rows.join(before, ["chain_id", "sequence"], "left").withColumns({
        "previous_hash": F.coalesce("previous_hash", F.lit(chain.ZERO_HASH)), "content_hash": recorded})


@query("p14_cost_receipt", with_views("books", more={**STATS_SQL, **JOURNAL_SQL}) + """
SELECT v.chain_id AS instrument_id, CASE WHEN faulty_segments > 0 THEN 'refused' WHEN f.chain_id IS NULL THEN 'nothing_measured' ELSE 'sealed' END AS status,
  segments, faulty_segments, reasons, CASE WHEN faulty_segments = 0 THEN eligible END AS eligible, CASE WHEN faulty_segments = 0 THEN measured END AS measured,
  CASE WHEN faulty_segments = 0 THEN insufficient END AS insufficient, round(CASE WHEN faulty_segments = 0 THEN p50 END, 4) AS p50
FROM verdict v LEFT JOIN figures f USING (chain_id)""")
def p14(t):
    """A receipt per instrument over its finished journal, refused where the chain does not verify."""
    figures = statistics(t).groupBy(F.col("instrument_id").alias("chain_id")).agg(
        F.bool_or("eligible").alias("eligible"), F.sum("count").alias("measured"), F.sum("insufficient_depth").alias("insufficient"),
        F.max(F.when(F.col("notional") == 5_000.0, F.col("p50"))).alias("p50"))
    out = endpoints.gated_receipt(book_journal(t), F.col("recomputed"), figures, ["eligible", "measured", "insufficient", "p50"])
    return rounded(out.withColumnRenamed("chain_id", "instrument_id"), 4, ["p50"])


@query("p14b_receipt_totals", with_views("books", more=STATS_SQL) + """
SELECT count(DISTINCT instrument_id) AS instruments, count(DISTINCT CASE WHEN eligible THEN instrument_id END) AS eligible,
  CAST(sum("count") AS BIGINT) AS measured, CAST(sum(insufficient_depth) AS BIGINT) AS insufficient FROM stats""")
def p14b(t):
    return statistics(t).agg(
        F.countDistinct("instrument_id").alias("instruments"),
        F.countDistinct(F.when(F.col("eligible"), F.col("instrument_id"))).alias("eligible"),
        F.sum("count").alias("measured"), F.sum("insufficient_depth").alias("insufficient"),
    )
