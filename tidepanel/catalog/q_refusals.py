"""Companions of the decoder queries: what they refuse, from payloads of which some are damaged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.catalog.q_sources import BOUNDARY, PAGE_DAYS, SYMBOL_SQL, decimal_text, depth_sides, with_symbols
from tidepanel.catalog.registry import query
from tidepanel.catalog.sqlviews import with_views
from tidepanel.catalog.tables import Tables
from tidepanel.functions.timefns import DAY_NS, int_div
from tidepanel.sources import payloads, refusals


def damaged_pages(t: Tables):
    """Candle pages: some closes are no numbers, some rows lack their last field, and every fifth page is an error."""
    day = F.col("day")
    close = F.when(day % 17 == 0, F.lit("n/a")).otherwise(decimal_text("close"))
    fields = F.array(
        int_div(F.col("open_time_ns"), 1_000_000).cast("string"), *(decimal_text(c) for c in ("open", "high", "low")), close,
        *(decimal_text(c) for c in ("base_volume", "base_volume", "quote_volume")), F.lit("1"),
    )
    row = F.when(day % 19 == 0, F.slice(fields, 1, 8)).otherwise(fields)
    page = F.floor(day / F.lit(PAGE_DAYS))
    pages = t.bars("p_brand").groupBy("instrument_id", page.alias("page")).agg(F.collect_list(row).alias("data"))
    code = F.when(F.col("page") % 5 == 4, "50011").otherwise("0")
    return pages.select("instrument_id", F.to_json(F.struct(code.alias("code"), "data")).alias("payload"))


def sound_pages(t: Tables):
    """The same bars of every third day, fetched again."""
    fields = F.array(
        int_div(F.col("open_time_ns"), 1_000_000).cast("string"),
        *(decimal_text(c) for c in ("open", "high", "low", "close", "base_volume", "base_volume", "quote_volume")), F.lit("1"),
    )
    page = F.floor(F.col("day") / F.lit(PAGE_DAYS))
    pages = t.bars("p_brand").where("day % 3 = 0").groupBy("instrument_id", page.alias("page")).agg(F.collect_list(fields).alias("data"))
    return pages.select("instrument_id", F.to_json(F.struct(F.lit("0").alias("code"), "data")).alias("payload"))


def candles(pages):
    return payloads.array_candles(pages, "payload", interval_ns=DAY_NS, availability_lag_ns=1, keep=["instrument_id"])


BAR_KEYS = ["instrument_id", "open_time_ns"]
DAMAGED_SQL = "day % 17 = 0 OR day % 19 = 0 OR day // 100 % 5 = 4"


@query("a04b_candle_rejects", with_views("bars_brand") + f"""
SELECT instrument_id, open_time_ns, CASE WHEN day % 17 = 0 THEN 'close' ELSE 'shape' END AS reason FROM bars_brand WHERE {DAMAGED_SQL}""")
def a04b(t):
    return refusals.refused_fields(candles(damaged_pages(t)), BAR_KEYS, refusals.CANDLE_FIELDS)


@query("a05b_kline_rejects", with_views("bars_brand") + """
SELECT instrument_id, open_time_ns, CASE WHEN day % 17 = 0 THEN 'base_volume' ELSE 'shape' END AS reason FROM bars_brand
WHERE day % 17 = 0 OR day % 19 = 0""")
def a05b(t):
    day = F.col("day")
    volume = F.when(day % 17 == 0, F.lit("")).otherwise(decimal_text("base_volume"))
    fields = F.array(
        int_div(F.col("open_time_ns"), 1_000_000).cast("string"), *(decimal_text(c) for c in ("open", "high", "low", "close")), volume,
        (int_div(F.col("close_time_ns"), 1_000_000) - 1).cast("string"), decimal_text("quote_volume"), F.col("trade_count").cast("string"),
        *[F.lit("0")] * 3,
    )
    row = F.when(day % 19 == 0, F.slice(fields, 1, 11)).otherwise(fields)
    pages = t.bars("p_brand").groupBy("instrument_id", F.floor(day / F.lit(PAGE_DAYS)).alias("page")).agg(F.collect_list(row).alias("data"))
    rows = payloads.kline_candles(
        pages.select("instrument_id", F.to_json("data").alias("payload")), "payload", interval_ns=DAY_NS, availability_lag_ns=1,
        confirmed_through_ns=F.lit(BOUNDARY), keep=["instrument_id"],
    )
    return refusals.refused_fields(rows, BAR_KEYS, refusals.CANDLE_FIELDS)


@query("a13b_rest_depth_rejects", with_views("ticks", more={"sides": """
    SELECT *, CAST(price * 0.5::DOUBLE AS DECIMAL(20,4)) AS bid, CAST(price * 1.5::DOUBLE AS DECIMAL(20,4)) AS ask FROM ticks"""}) + """
SELECT event_id AS sequence, CASE WHEN event_id % 37 = 0 OR NOT coalesce(bid > 0 AND quantity >= 0, false) THEN 'bids'
  WHEN event_id % 41 = 0 OR NOT coalesce(ask > 0 AND quantity >= 0, false) THEN 'asks' ELSE 'header' END AS reason
FROM sides WHERE event_id % 37 = 0 OR event_id % 41 = 0 OR event_id % 43 = 0 OR NOT coalesce(bid > 0 AND ask > 0 AND quantity >= 0, false)""")
def a13b(t):
    e = F.col("event_id")
    bids, asks = depth_sides()
    zero = F.array(F.array(F.lit("0.0000"), F.lit("1.0000")))
    message = F.struct(
        e.alias("lastUpdateId"), F.when(e % 43 != 0, int_div(F.col("event_time_ns"), 1_000_000)).alias("T"),
        F.when(e % 37 == 0, zero).otherwise(bids).alias("bids"), F.when(e % 41 != 0, asks).alias("asks"),
    )
    rows = payloads.rest_depth(t.ticks.select(F.to_json(message).alias("m")), "m", [])
    return refusals.refused_books(rows, ["sequence"])


def refused_symbols_sql(reason: str, other: str) -> str:
    """Entries in scope and with a usable symbol of which a field does not parse."""
    return with_views("ticks", more={"p": f"SELECT *, {SYMBOL_SQL} AS symbol FROM ticks"}) + f"""
SELECT event_id, symbol, CASE WHEN event_id % 29 = 0 THEN '{reason}' ELSE '{other}' END AS reason FROM p
WHERE symbol LIKE 'SYM%USDT' AND (event_id % 29 = 0 OR event_id % 37 = 0)"""


def spoiled(t: Tables, column: str, text: Column, missing: str):
    e = F.col("event_id")
    return with_symbols(t).withColumns(
        {column: F.when(e % 29 == 0, text).otherwise(F.col(column)), missing: F.when(e % 37 != 0, F.col(missing))})


@query("a15b_premium_rejects", refused_symbols_sql("mark_price", "last_funding_rate"))
def a15b(t):
    entries = spoiled(t, "markPrice", F.lit("n/a"), "lastFundingRate")
    return refusals.refused_fields(payloads.premium_rows(entries, "USDT", ["event_id"]), ["event_id", "symbol"], refusals.PREMIUM_FIELDS)


@query("a16b_best_quote_rejects", refused_symbols_sql("bid_price", "ask_qty"))
def a16b(t):
    entries = spoiled(t, "bidPrice", F.lit(""), "askQty")
    return refusals.refused_fields(payloads.ticker_rows(entries, "USDT", ["event_id"]), ["event_id", "symbol"], refusals.TICKER_FIELDS)


@query("a21b_history_page_rejects", with_views("bars_brand") + f"""
SELECT instrument_id, open_time_ns, CASE WHEN day % 17 = 0 THEN 'close' ELSE 'shape' END AS reason, 2 AS copies, day % 3 = 0 AS recovered
FROM bars_brand WHERE {DAMAGED_SQL}""")
def a21b(t):
    damaged = candles(damaged_pages(t))
    rows = damaged.unionByName(damaged).unionByName(candles(sound_pages(t)))
    return refusals.recovered(rows, BAR_KEYS, refusals.CANDLE_FIELDS).withColumn("copies", F.col("copies").cast("int"))
