"""Scans, decoders and sinks, run on payloads derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.catalog.registry import query, rounded
from tidepanel.catalog.sqlviews import DAY, SECOND, with_views
from tidepanel.catalog.tables import VENUE, Tables
from tidepanel.functions.timefns import DAY_NS, int_div, normalise_epoch_ns
from tidepanel.operators import quality
from tidepanel.session import scratch_path
from tidepanel.sources import panel, payloads

BOUNDARY = 10_000 * DAY
PAGE_DAYS = 100
BAR_COLUMNS = ["instrument_id", "open_time_ns", "close_time_ns", "close", "quote_volume"]


def published(t: Tables) -> str:
    """The brand panel as a written dataset."""
    path = scratch_path(t.spark, "panel")
    bars = t.bars("p_brand").withColumn("source_payload_hash", F.sha2("contract_id", 256))
    columns = [c.strip().split(" ")[0] for c in panel.BAR_SCHEMA.split(",")]
    panel.publish_bars(bars.select(*columns), path)
    return path


@query("a01_point_in_time_scan", with_views("bars_brand") + f"""
SELECT contract_id, open_time_ns, close_time_ns, round(close, 8) AS close, quote_volume FROM bars_brand
WHERE available_time_ns < {BOUNDARY}""")
def a01(t):
    bars = panel.load_bars(t.spark, published(t), available_before_ns=BOUNDARY)
    return bars.select("contract_id", "open_time_ns", "close_time_ns", F.round("close", 8).alias("close"), "quote_volume")


@query("a02_research_bar_scan", with_views("legs_brand") + f"""
SELECT venue, instrument_id, open_time_ns, available_time_ns, round(high, 8) AS high, round(low, 8) AS low, base_volume
FROM legs_brand WHERE available_time_ns < {BOUNDARY}""")
def a02(t):
    path = scratch_path(t.spark, "research")
    bars = t.legs("p_brand").withColumn("source_payload_hash", F.sha2("contract_id", 256))
    columns = [c.strip().split(" ")[0] for c in panel.BAR_SCHEMA.split(",")]
    panel.publish_bars(bars.select(*columns), path)
    out = t.spark.read.schema(panel.BAR_SCHEMA).parquet(path).filter(F.col("available_time_ns") < BOUNDARY)
    return out.select(
        "venue", "instrument_id", "open_time_ns", "available_time_ns", F.round("high", 8).alias("high"),
        F.round("low", 8).alias("low"), "base_volume",
    )


@query("a03_funding_scan", with_views("bars_brand", "funding_brand") + """
SELECT contract_id, calc_time_ns, CAST(rate AS DOUBLE) AS rate FROM funding_brand
JOIN (SELECT DISTINCT instrument_id, contract_id FROM bars_brand) USING (instrument_id)""")
def a03(t):
    bars = published(t)
    path = scratch_path(t.spark, "funding")
    t.funding("p_brand").select(
        "instrument_id", "calc_time_ns", F.lit(8).cast("bigint").alias("funding_interval_hours"), "rate",
        F.lit(VENUE).alias("venue"),
    ).write.parquet(path)
    events = panel.load_funding(t.spark, path, bars)
    none = panel.load_funding(t.spark, path + "-absent", bars)
    return events.unionByName(none).withColumn("rate", F.col("rate").cast("double"))


def decimal_text(column: str) -> Column:
    return F.col(column).cast("decimal(20,8)").cast("string")


def candle_pages(t: Tables):
    """Nine-field candle pages of at most a hundred days each."""
    fields = F.array(
        int_div(F.col("open_time_ns"), 1_000_000).cast("string"),
        *[decimal_text(c) for c in ("open", "high", "low", "close", "base_volume", "base_volume", "quote_volume")],
        F.when(F.col("day") % 10 == 0, "0").otherwise("1"),
    )
    page = F.floor(F.col("day") / F.lit(PAGE_DAYS))
    rows = t.bars("p_brand").groupBy("instrument_id", page.alias("page")).agg(F.collect_list(fields).alias("data"))
    return rows.select("instrument_id", F.to_json(F.struct(F.lit("0").alias("code"), "data")).alias("payload"))


CANDLE_SQL = f"""
SELECT instrument_id, open_time_ns, open_time_ns + {DAY - 1} AS close_time_ns, round(close, 8) AS close,
  round(quote_volume, 2) AS quote_volume, day % 10 <> 0 AS confirmed FROM bars_brand"""


@query("a04_array_candle_payload", with_views("bars_brand") + CANDLE_SQL)
def a04(t):
    out = payloads.array_candles(
        candle_pages(t), "payload", interval_ns=DAY_NS, availability_lag_ns=1, keep=["instrument_id"]
    ).filter(~F.col("malformed"))
    out = out.select(
        "instrument_id", "open_time_ns", "close_time_ns", F.round(F.col("close").cast("double"), 8).alias("close"),
        F.col("quote_volume").cast("double").alias("quote_volume"), "confirmed",
    )
    return rounded(out, 2, ["quote_volume"])


@query("a05_kline_payload", with_views("bars_brand") + f"""
SELECT instrument_id, open_time_ns, close_time_ns - 1000000 AS close_time_ns, round(close, 8) AS close, trade_count,
  close_time_ns - 1000000 <= {BOUNDARY} AS confirmed FROM bars_brand""")
def a05(t):
    text = lambda c: F.concat(F.lit('"'), decimal_text(c), F.lit('"'))
    closed = (int_div(F.col("close_time_ns"), 1_000_000) - 1).cast("string")
    row = F.concat(
        F.lit("["),
        F.concat_ws(
            ",", int_div(F.col("open_time_ns"), 1_000_000).cast("string"), text("open"), text("high"), text("low"),
            text("close"), text("base_volume"), closed, text("quote_volume"), F.col("trade_count").cast("string"),
            F.lit('"0","0","0"'),
        ),
        F.lit("]"),
    )
    page = F.floor(F.col("day") / F.lit(PAGE_DAYS))
    pages = t.bars("p_brand").groupBy("instrument_id", page.alias("page")).agg(F.collect_list(row).alias("r")).select(
        "instrument_id", F.concat(F.lit("["), F.array_join("r", ","), F.lit("]")).alias("payload")
    )
    out = payloads.kline_candles(
        pages, "payload", interval_ns=DAY_NS, availability_lag_ns=1, confirmed_through_ns=F.lit(BOUNDARY),
        keep=["instrument_id"],
    ).filter(~F.col("malformed"))
    out = out.select(
        "instrument_id", "open_time_ns", "close_time_ns", F.round(F.col("close").cast("double"), 8).alias("close"), "trade_count",
        "confirmed",
    )
    return out


def csv_lines(t: Tables):
    """Dump lines with headers; the newest ones use microsecond epochs."""
    scale = F.when(F.col("day") >= 11_600, 1_000).otherwise(1_000_000)
    epoch = lambda ns: F.call_function("div", ns, scale.cast("bigint")).cast("string")
    line = F.concat_ws(
        ",", epoch(F.col("open_time_ns")), *[decimal_text(c) for c in ("open", "high", "low", "close", "base_volume")],
        epoch(F.col("close_time_ns") - 1_000_000), decimal_text("quote_volume"), F.col("trade_count").cast("string"),
        F.lit("0,0,0"),
    )
    bars = t.bars("p_brand")
    header = bars.select("instrument_id").distinct().withColumn("line", F.lit("open_time,open,high,low,close,volume"))
    return bars.select("instrument_id", line.alias("line")).unionByName(header)


@query("a06_kline_csv_dump", with_views("bars_brand") + """
SELECT instrument_id, open_time_ns, close_time_ns - 1000000 AS close_time_ns, close_time_ns - 999999 AS available_time_ns,
  round(close, 8) AS close, trade_count FROM bars_brand""")
def a06(t):
    out = payloads.kline_csv(csv_lines(t), "line", ["instrument_id"]).filter(~F.col("malformed"))
    out = out.withColumn("close", F.round(F.col("close").cast("double"), 8)).select(
        "instrument_id", "open_time_ns", "close_time_ns", "available_time_ns", "close", "trade_count"
    )
    return out


@query("a07_funding_csv_dump", with_views("funding_brand") + """
SELECT instrument_id, calc_time_ns, 8 AS funding_interval_hours, CAST(rate AS DOUBLE) AS rate FROM funding_brand""")
def a07(t):
    line = F.concat_ws(
        ",", int_div(F.col("calc_time_ns"), 1_000_000).cast("string"), F.lit("8"), F.col("rate").cast("string")
    )
    events = t.funding("p_brand")
    header = events.select("instrument_id").distinct().withColumn("line", F.lit("calc_time,interval,rate"))
    lines = events.select("instrument_id", line.alias("line")).unionByName(header)
    out = payloads.funding_csv(lines, "line", ["instrument_id"]).filter(~F.col("malformed")).drop("malformed")
    return out.withColumn("rate", F.col("rate").cast("double"))


@query("a08_mixed_era_epochs", with_views("ticks") + """
SELECT event_id, event_time_ns // 1000000 * 1000000 AS normalised_ns FROM ticks""")
def a08(t):
    # Ticks are recent enough for a microsecond epoch to be recognised as one.
    raw = F.when(F.col("event_id") % 2 == 0, int_div(F.col("event_time_ns"), 1_000)).otherwise(
        int_div(F.col("event_time_ns"), 1_000_000)
    )
    return t.ticks.select("event_id", normalise_epoch_ns(raw).alias("normalised_ns"))


FUNDING_DAILY = "SELECT instrument_id, day_ns + 0 AS calc_time_ns, sum(rate) AS rate FROM (SELECT *, calc_time_ns // 86400000000000 * 86400000000000 AS day_ns FROM funding_brand) GROUP BY ALL"


def daily_funding(t: Tables):
    """Settlements netted to one per instrument and day."""
    return t.funding("p_brand").groupBy(
        "instrument_id", (int_div(F.col("calc_time_ns"), DAY_NS) * F.lit(DAY_NS)).alias("calc_time_ns")
    ).agg(F.sum("rate").cast("decimal(18,8)").alias("rate"))


@query("a09_funding_history_pages", with_views("funding_brand", more={"d": FUNDING_DAILY}) + f"""
SELECT instrument_id, calc_time_ns, CAST(rate AS DOUBLE) AS rate, false AS truncated, false AS repeated FROM d
WHERE (calc_time_ns // {DAY}) % {PAGE_DAYS} < 90""")
def a09(t):
    item = F.struct(int_div(F.col("calc_time_ns"), 1_000_000).alias("fundingTime"), F.col("rate").cast("string").alias("fundingRate"))
    page = int_div(int_div(F.col("calc_time_ns"), DAY_NS), PAGE_DAYS)
    pages = daily_funding(t).groupBy("instrument_id", page.alias("page")).agg(F.to_json(F.collect_list(item)).alias("payload"))
    # Each page is asked for its first ninety days only.
    start = F.col("page") * F.lit(PAGE_DAYS * 86_400_000)
    windowed = pages.withColumns({"start_ms": start, "end_ms": start + F.lit(90 * 86_400_000 - 1)})
    out = payloads.funding_pages(windowed, "payload", row_limit=1_000, keep=["instrument_id"])
    return out.withColumn("rate", F.col("rate").cast("double"))


TRADE_KEYS = ["instrument_id", "trade_id"]


def trade_lines(t):
    """Every line twice; some prices are no numbers, and some second copies tell the price in another text, 1.5.

    Versions are told apart by the hash of the line, so 1.5 is another version than 1.5000, too.
    """
    e = F.col("event_id")
    price = F.col("price").cast("decimal(20,4)").cast("string")
    fields = lambda px: F.struct(
        F.col("instrument_id").alias("instId"), e.cast("string").alias("tradeId"), px.alias("px"),
        F.col("quantity").cast("decimal(20,4)").cast("string").alias("sz"), F.col("side").alias("side"),
        int_div(F.col("event_time_ns"), 1_000_000).cast("string").alias("ts"),
    )
    first = F.when(e % 41 == 0, F.concat(price, F.lit("x"))).otherwise(price)
    second = F.when((e % 43 == 0) & (e % 41 != 0), F.lit("1.5")).otherwise(first)
    return t.ticks.select(F.explode(F.array(F.to_json(fields(first)), F.to_json(fields(second)))).alias("line"))


def parsed_trades(t):
    return payloads.trades(trade_lines(t), "line", availability_lag_ns=SECOND, downloaded_at_ns=0)


@query("a10_trade_jsonl", with_views("ticks") + f"""
SELECT instrument_id, CAST(event_id AS VARCHAR) AS trade_id, event_time_ns // 1000000 * 1000000 AS event_time_ns,
  event_time_ns // 1000000 * 1000000 + {SECOND} AS available_time_ns, price, quantity, side FROM ticks
WHERE event_id % 41 <> 0 AND event_id % 43 <> 0""")
def a10(t):
    parsed = parsed_trades(t).filter(~F.col("malformed"))
    rows, _ = quality.admit(parsed, TRADE_KEYS, [c for c in parsed.columns if c not in TRADE_KEYS])
    return rows.select(
        *TRADE_KEYS, "event_time_ns", "available_time_ns", F.col("price").cast("double").alias("price"),
        F.col("quantity").cast("double").alias("quantity"), "side",
    )


@query("a10b_trade_rejects", with_views("ticks") + """
SELECT instrument_id, CAST(event_id AS VARCHAR) AS trade_id, 'malformed' AS reason, 2 AS lines FROM ticks WHERE event_id % 41 = 0
UNION ALL SELECT instrument_id, CAST(event_id AS VARCHAR), 'conflict', 2 FROM ticks WHERE event_id % 43 = 0 AND event_id % 41 <> 0""")
def a10b(t):
    parsed = parsed_trades(t)
    bad = parsed.filter("malformed").groupBy(*TRADE_KEYS).agg(F.count("*").alias("lines")).withColumn("reason", F.lit("malformed"))
    sound = parsed.filter(~F.col("malformed"))
    several = quality.conflicts(sound, TRADE_KEYS, ["price", "source_payload_hash"]).groupBy(*TRADE_KEYS).agg(F.sum("copies").alias("lines"))
    return bad.unionByName(several.withColumn("reason", F.lit("conflict"))).select(*TRADE_KEYS, "reason", F.col("lines").cast("int").alias("lines"))


AGGREGATE_KEYS = ["instrument_id", "sequence"]


def parsed_aggregates(t):
    """Some quantities are no numbers; some lines come again with the other maker flag."""
    e = F.col("event_id")
    quantity = F.col("quantity").cast("decimal(20,4)").cast("string")
    fields = lambda maker: F.struct(
        e.alias("a"), F.col("price").cast("decimal(20,4)").cast("string").alias("p"),
        F.when(e % 53 == 0, F.lit("?")).otherwise(quantity).alias("q"),
        int_div(F.col("event_time_ns"), 1_000_000).alias("T"), maker.alias("m"),
    )
    again = F.when(e % 47 == 0, F.array(F.to_json(fields(e % 3 != 0)))).otherwise(F.array().cast("array<string>"))
    lines = t.ticks.select("instrument_id", F.explode(F.concat(F.array(F.to_json(fields(e % 3 == 0))), again)).alias("line"))
    return payloads.aggregate_trades(lines, "line", availability_lag_ns=SECOND, keep=["instrument_id"])


@query("a11_aggregate_trade_jsonl", with_views("ticks") + """
SELECT instrument_id, event_id AS sequence, event_time_ns // 1000000 * 1000000 AS event_time_ns, price,
  CASE WHEN event_id % 3 = 0 THEN 'sell' ELSE 'buy' END AS side FROM ticks WHERE event_id % 53 <> 0 AND event_id % 47 <> 0""")
def a11(t):
    sound = parsed_aggregates(t).filter(~F.col("malformed"))
    rows, _ = quality.admit(sound, AGGREGATE_KEYS, ["event_time_ns", "price", "side", "source_payload_hash"])
    return rows.select(*AGGREGATE_KEYS, "event_time_ns", F.col("price").cast("double").alias("price"), "side")


@query("a11b_aggregate_trade_rejects", with_views("ticks") + """
SELECT instrument_id, event_id AS sequence, 'malformed' AS reason, CASE WHEN event_id % 47 = 0 THEN 2 ELSE 1 END AS lines FROM ticks WHERE event_id % 53 = 0
UNION ALL SELECT instrument_id, event_id, 'conflict', 2 FROM ticks WHERE event_id % 47 = 0 AND event_id % 53 <> 0""")
def a11b(t):
    parsed = parsed_aggregates(t)
    bad = parsed.filter("malformed").groupBy(*AGGREGATE_KEYS).agg(F.count("*").alias("lines")).withColumn("reason", F.lit("malformed"))
    sound = parsed.filter(~F.col("malformed"))
    several = quality.conflicts(sound, AGGREGATE_KEYS, ["side", "source_payload_hash"]).groupBy(*AGGREGATE_KEYS).agg(F.sum("copies").alias("lines"))
    return bad.unionByName(several.withColumn("reason", F.lit("conflict"))).select(*AGGREGATE_KEYS, "reason", F.col("lines").cast("int").alias("lines"))


def level_text(price: Column, quantity: Column) -> Column:
    return F.array(F.array(price.cast("decimal(20,4)").cast("string"), quantity.cast("decimal(20,4)").cast("string")))


def depth_sides():
    low, high = F.col("price") * 0.5, F.col("price") * 1.5
    return level_text(low, F.col("quantity")), level_text(high, F.col("quantity"))


# Both sides hold a level of a positive price and of a quantity.
SOUND_SQL = """coalesce(CAST(price * 0.5::DOUBLE AS DECIMAL(20,4)) > 0 AND CAST(price * 1.5::DOUBLE AS DECIMAL(20,4)) > 0 AND quantity >= 0, false)"""
DEPTH_SQL = """round(bid_price, 4) AS bid_price, round(ask_price, 4) AS ask_price
FROM (SELECT *, CAST(CAST(price * 0.5::DOUBLE AS DECIMAL(20,4)) AS DOUBLE) AS bid_price,
  CAST(CAST(price * 1.5::DOUBLE AS DECIMAL(20,4)) AS DOUBLE) AS ask_price FROM ticks)"""


@query("a12_channel_depth_messages", with_views("ticks") + f"""
SELECT instrument_id, event_id AS sequence, CASE WHEN event_id % 25 = 0 THEN 'snapshot' ELSE 'update' END AS action,
  CASE WHEN event_id % 25 <> 0 THEN event_id - 1 END AS previous_sequence, (event_id % 25 = 0 AND event_id % 50 <> 0) OR NOT {SOUND_SQL} AS malformed,
  CAST(quantity AS DOUBLE) AS bid_quantity FROM ticks""")
def a12(t):
    bids, asks = depth_sides()
    snapshot = F.col("event_id") % 25 == 0
    # Every other snapshot carries a link it must not have.
    previous = F.when(F.col("event_id") % 50 == 0, F.lit(-1)).otherwise(F.col("event_id") - 1)
    item = F.struct(
        F.col("event_id").alias("seqId"), previous.alias("prevSeqId"),
        int_div(F.col("event_time_ns"), 1_000_000).cast("string").alias("ts"), bids.alias("bids"), asks.alias("asks"),
    )
    message = F.struct(
        F.struct(F.lit("books").alias("channel"), F.col("instrument_id").alias("instId")).alias("arg"),
        F.when(snapshot, "snapshot").otherwise("update").alias("action"), F.array(item).alias("data"),
    )
    out = payloads.channel_depth(t.ticks.select(F.to_json(message).alias("m")), "m", [])
    return out.select(
        "instrument_id", "sequence", "action", "previous_sequence", "malformed",
        F.get("bids", F.lit(0))["quantity"].alias("bid_quantity"),
    )


@query("a13_rest_depth_snapshot", with_views("ticks") + f"""
SELECT event_id AS sequence, event_time_ns // 1000000 * 1000000 AS event_time_ns, {DEPTH_SQL} WHERE {SOUND_SQL}""")
def a13(t):
    bids, asks = depth_sides()
    message = F.struct(
        F.col("event_id").alias("lastUpdateId"), int_div(F.col("event_time_ns"), 1_000_000).alias("T"),
        bids.alias("bids"), asks.alias("asks"),
    )
    out = payloads.rest_depth(t.ticks.select(F.to_json(message).alias("m")), "m", []).filter(~F.col("malformed"))
    return rounded(
        out.select(
            "sequence", "event_time_ns", F.get("bids", F.lit(0))["price"].alias("bid_price"),
            F.get("asks", F.lit(0))["price"].alias("ask_price"),
        ), 4,
    )


@query("a14_depth_diff", with_views("ticks") + f"""
SELECT instrument_id, event_id AS sequence, event_id - 1 AS previous_sequence, event_id % 40 = 0 OR NOT {SOUND_SQL} AS malformed FROM ticks""")
def a14(t):
    bids, asks = depth_sides()
    e = F.col("event_id")
    message = F.struct(
        F.lit("depthUpdate").alias("e"), F.col("instrument_id").alias("s"),
        F.when(e % 40 == 0, e + 1).otherwise(e).alias("U"), e.alias("u"), (e - 1).alias("pu"),
        int_div(F.col("event_time_ns"), 1_000_000).alias("T"), bids.alias("b"), asks.alias("a"),
    )
    out = payloads.diff_depth(t.ticks.select(F.to_json(message).alias("m")), "m", [])
    return out.select("instrument_id", "sequence", "previous_sequence", "malformed")


SYMBOL_SQL = "CASE WHEN event_id % 7 = 0 THEN 'SYM' || (event_id % 97) || 'EUR' WHEN event_id % 31 = 0 THEN 'sym' || (event_id % 97) || 'USDT' ELSE 'SYM' || (event_id % 97) || 'USDT' END"


def with_symbols(t: Tables):
    e = F.col("event_id")
    name = lambda head, tail: F.concat(F.lit(head), (e % 97).cast("string"), F.lit(tail))
    symbol = F.when(e % 7 == 0, name("SYM", "EUR")).when(e % 31 == 0, name("sym", "USDT")).otherwise(name("SYM", "USDT"))
    text = lambda c: c.cast("decimal(20,4)").cast("string")
    return t.ticks.select(
        "event_id", symbol.alias("symbol"),
        text(F.when(e % 13 == 0, 0.0).otherwise(F.col("price") * 1.01)).alias("markPrice"), text(F.col("price")).alias("indexPrice"),
        F.lit("0.0001").alias("lastFundingRate"), int_div(F.col("event_time_ns"), 1_000_000).alias("nextFundingTime"),
        text(F.when(e % 13 == 0, 0.0).otherwise(F.col("price"))).alias("bidPrice"), text(F.col("quantity")).alias("bidQty"),
        text(F.col("price") * F.when(e % 17 == 0, 1.0).otherwise(1.01)).alias("askPrice"), text(F.col("quantity")).alias("askQty"),
    )


@query("a15_premium_snapshot", with_views("ticks", more={"p": f"""
    SELECT *, {SYMBOL_SQL} AS symbol, CAST(CASE WHEN event_id % 13 = 0 THEN 0 ELSE price * 1.01::DOUBLE END AS DECIMAL(20,4))::DOUBLE AS mark FROM ticks"""}) + """
SELECT symbol, count(*) AS entries, count_if(mark <= 0 OR price <= 0 OR symbol LIKE 'sym%') AS excluded,
  round(avg(CASE WHEN NOT (mark <= 0 OR price <= 0 OR symbol LIKE 'sym%') THEN (mark - price) / price * 10000 END), 3) AS mean_basis_bps
FROM p WHERE symbol LIKE '%USDT' GROUP BY ALL""")
def a15(t):
    rows = payloads.premium_rows(with_symbols(t), "USDT", ["event_id"]).filter(~F.col("malformed"))
    return rounded(
        rows.groupBy("symbol").agg(
            F.count("*").alias("entries"), F.count_if("excluded").alias("excluded"),
            F.avg(F.when(~F.col("excluded"), F.col("basis_bps"))).alias("mean_basis_bps"),
        ), 3,
    )


@query("a16_best_quote_snapshot", with_views("ticks", more={"p": f"""
    SELECT *, {SYMBOL_SQL} AS symbol, CASE WHEN event_id % 13 = 0 THEN 0 ELSE price END AS bid,
      CAST(price * CASE WHEN event_id % 17 = 0 THEN 1.0::DOUBLE ELSE 1.01::DOUBLE END AS DECIMAL(20,4))::DOUBLE AS ask FROM ticks""",
    "x": "SELECT *, bid <= 0 OR quantity <= 0 OR ask <= 0 OR bid >= ask OR symbol LIKE 'sym%' AS out FROM p"}) + """
SELECT symbol, count(*) AS entries, count_if(out) AS excluded,
  round(avg(CASE WHEN NOT out THEN (ask - bid) / ((ask + bid) / 2) * 10000 END), 3) AS mean_spread_bps
FROM x WHERE symbol LIKE '%USDT' GROUP BY ALL""")
def a16(t):
    rows = payloads.ticker_rows(with_symbols(t), "USDT", ["event_id"]).filter(~F.col("malformed"))
    return rounded(
        rows.groupBy("symbol").agg(
            F.count("*").alias("entries"), F.count_if("excluded").alias("excluded"),
            F.avg(F.when(~F.col("excluded"), F.col("spread_bps"))).alias("mean_spread_bps"),
        ), 3,
    )


@query("h09_symbol_filter", with_views("ticks", more={"p": f"SELECT {SYMBOL_SQL} AS symbol FROM ticks"}) + """
SELECT symbol, symbol LIKE '%USDT' AS kept, regexp_full_match(symbol, '[A-Z0-9]+') AS usable, count(*) AS entries FROM p GROUP BY ALL""")
def h09(t):
    rows = with_symbols(t)
    return rows.groupBy(
        "symbol", payloads.symbol_kept(F.col("symbol"), "USDT").alias("kept"),
        payloads.symbol_usable(F.col("symbol")).alias("usable"),
    ).agg(F.count("*").alias("entries"))


@query("b24_strict_extraction", with_views("ticks") + """
SELECT instrument_id, count_if(event_id % 19 = 0) AS refused, count_if(event_id % 19 <> 0) AS parsed FROM ticks GROUP BY ALL""")
def b24(t):
    raw = F.when(F.col("event_id") % 19 == 0, F.concat(F.col("price").cast("string"), F.lit("x"))).otherwise(
        F.col("price").cast("string")
    )
    rows = t.ticks.select("instrument_id", raw.alias("raw")).withColumn("value", F.col("raw").try_cast("decimal(20,8)"))
    return rows.groupBy("instrument_id").agg(
        F.count_if(payloads.rejected(F.col("value"), F.col("raw"))).alias("refused"), F.count("value").alias("parsed")
    )


@query("a17_partitioned_sink", with_views("legs_type") + """
SELECT venue, instrument_id, count(*) AS rows, CAST(sum(quote_volume) AS DECIMAL(28,2))::DOUBLE AS quote_volume FROM legs_type GROUP BY ALL""")
def a17(t):
    path = scratch_path(t.spark, "sink")
    bars = t.legs().withColumn("source_payload_hash", F.sha2("contract_id", 256))
    columns = [c.strip().split(" ")[0] for c in panel.BAR_SCHEMA.split(",")]
    panel.publish_bars(bars.select(*columns), path, partitions=("venue",))
    back = t.spark.read.schema(panel.BAR_SCHEMA).parquet(path)
    return back.groupBy("venue", "instrument_id").agg(
        F.count("*").alias("rows"), F.sum(F.col("quote_volume").cast("decimal(28,2)")).cast("double").alias("quote_volume")
    )


@query("a18_panel_dataset_with_quality", with_views("bars_brand") + """
SELECT instrument_id, count(*) AS rows, min(day) AS first_day, max(day) AS last_day,
  max(day) - min(day) + 1 - count(*) AS missing_days FROM bars_brand GROUP BY ALL""")
def a18(t):
    return quality.quality_rollup(t.spark.read.schema(panel.BAR_SCHEMA).parquet(published(t)))


@query("a19_append_only_records", with_views("chain") + """
SELECT CASE WHEN event_id % 2 = 1 THEN 'fresh' WHEN event_id % 6 = 0 THEN 'conflict' END AS outcome, count(*) AS records
FROM chain WHERE event_id % 2 = 1 OR event_id % 6 = 0 GROUP BY ALL""")
def a19(t):
    records = t.chain.select("event_id", "kind", "payload", "content_hash")
    known = records.filter(F.col("event_id") % 2 == 0)
    altered = records.withColumn(
        "payload", F.when(F.col("event_id") % 6 == 0, F.lit("altered")).otherwise(F.col("payload"))
    )
    fresh, conflicts = panel.append_records(known, altered, "event_id")
    outcome = lambda df, name: df.select(F.lit(name).alias("outcome"))
    return outcome(fresh, "fresh").unionByName(outcome(conflicts, "conflict")).groupBy("outcome").agg(
        F.count("*").alias("records")
    )


@query("a20_file_integrity_audit", with_views("chain") + """
SELECT reason, count(*) AS files FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'missing' WHEN event_id % 7 = 0 THEN 'unlisted'
  WHEN event_id % 29 = 0 THEN 'mismatched' END AS reason FROM chain) WHERE reason IS NOT NULL GROUP BY ALL""")
def a20(t):
    from tidepanel.catalog.tables import chain_hash

    rows = t.chain
    actual = rows.filter(F.col("event_id") % 5 != 0).select("event_id", chain_hash().alias("hash"))
    manifest = rows.filter((F.col("event_id") % 7 != 0) | (F.col("event_id") % 5 == 0)).select(
        "event_id", F.col("content_hash").alias("hash")
    )
    return quality.integrity_reasons(actual, manifest, ["event_id"]).groupBy("reason").agg(F.count("*").alias("files"))


@query("a21_history_page_merge", with_views("bars_brand") + """
SELECT instrument_id, open_time_ns FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY open_time_ns DESC) AS rk
  FROM bars_brand WHERE day % 10 <> 0) WHERE rk <= 200""")
def a21(t):
    candles = payloads.array_candles(
        candle_pages(t), "payload", interval_ns=DAY_NS, availability_lag_ns=1, keep=["instrument_id"]
    ).filter(~F.col("malformed"))
    overlapping = candles.unionByName(candles.filter(F.col("open_time_ns") % 3 == 0))
    return panel.latest_confirmed(overlapping, ["instrument_id"], 200).select("instrument_id", "open_time_ns")


@query("f03_latest_confirmed_bars", with_views("legs_brand") + """
SELECT venue, instrument_id, open_time_ns FROM (SELECT *, row_number() OVER (PARTITION BY venue, instrument_id
  ORDER BY open_time_ns DESC) AS rk FROM legs_brand WHERE day % 4 <> 0) WHERE rk <= 100""")
def f03(t):
    bars = t.legs("p_brand").withColumn("confirmed", F.col("day") % 4 != 0)
    return panel.latest_confirmed(bars, ["venue", "instrument_id"], 100).select("venue", "instrument_id", "open_time_ns")


@query("a22_two_market_load", with_views("legs_daily_brand") + f"""
SELECT venue || ':' || instrument_id || ':' || min(open_time_ns) OVER (PARTITION BY venue, instrument_id) AS contract_id,
  close_time_ns, round(close, 8) AS close FROM legs_daily_brand QUALIFY available_time_ns < {BOUNDARY}""")
def a22(t):
    columns = [c.strip().split(" ")[0] for c in panel.BAR_SCHEMA.split(",")]
    legs = t.legs("p_brand").withColumn("source_payload_hash", F.lit("")).select(*columns)
    paths = {}
    for market in ("perp", "spot"):
        paths[market] = scratch_path(t.spark, market)
        panel.publish_bars(legs.filter(F.col("venue") == market), paths[market])
    out = panel.load_leg_bars(t.spark, paths["perp"], paths["spot"], available_before_ns=BOUNDARY)
    return out.select("contract_id", "close_time_ns", F.round("close", 8).alias("close"))


@query("a23_source_kinds_to_one_schema", with_views("bars_brand") + """
SELECT instrument_id, open_time_ns, CASE WHEN day % 3 = 0 THEN 0 WHEN day % 3 = 1 THEN 1 ELSE 2 END AS source_rank FROM bars_brand""")
def a23(t):
    bars = t.bars("p_brand").select("instrument_id", "open_time_ns", "day", "close", "trade_count")
    monthly = bars.filter("day % 3 = 0").drop("trade_count")
    tail = bars.filter("day % 3 <= 1")
    rest = bars
    out = panel.merge_sources([monthly, tail, rest], ["instrument_id", "open_time_ns"])
    return out.select("instrument_id", "open_time_ns", "source_rank")


@query("a24_single_day_tail_check", with_views("bars_brand") + """
SELECT instrument_id, expected_day, count(*) AS rows, min(day) AS first_day, max(day) AS last_day
FROM (SELECT *, day // 2 * 2 AS expected_day FROM bars_brand) GROUP BY ALL HAVING count(*) <> 1 OR min(day) <> expected_day""")
def a24(t):
    tail = t.bars("p_brand").withColumn("expected_day", int_div(F.col("day"), 2) * 2)
    return panel.single_day_violations(tail, ["instrument_id"], "day", "expected_day")
