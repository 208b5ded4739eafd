"""Venue payloads to typed rows: candles, settlements, trades, depth, snapshots.

Every number is extracted from a declared string or integer type; text that
does not parse leaves a NULL next to a non-NULL input and rejects the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.timefns import normalise_epoch_ns

PRICE = "decimal(20,8)"
AMOUNT = "decimal(28,8)"
SYMBOL_PATTERN = "^[A-Z0-9]+$"


def _number(text: Column, kind: str) -> Column:
    return text.try_cast(kind)


def rejected(parsed: Column, raw: Column) -> Column:
    """A value that was present but did not parse."""
    return parsed.isNull() & raw.isNotNull()


def unparsed(*names: str) -> Column:
    """Whether a field that every row of its kind carries is missing or did not parse."""
    bad = F.lit(False)
    for name in names:
        bad = bad | F.col(name).isNull()
    return bad


def array_candles(
    pages: DataFrame, payload: str, *, interval_ns: int, availability_lag_ns: int, keep: list[str]
) -> DataFrame:
    """Nine-field string arrays under ``{"code": "0", "data": [...]}``.

    Field order: open ms, open, high, low, close, contracts, base volume, quote
    volume, confirm flag. An error code or a row of another width is malformed.
    """
    parsed = F.from_json(payload, "struct<code string, data array<array<string>>>")
    rows = pages.withColumn("_p", parsed).select(
        *keep, (F.col("_p.code") == "0").alias("_accepted"), F.explode_outer("_p.data").alias("_r")
    )
    field = lambda i: F.get("_r", F.lit(i))
    opened = _number(field(0), "bigint") * F.lit(1_000_000)
    out = rows.select(
        *keep,
        opened.alias("open_time_ns"),
        (opened + F.lit(interval_ns - 1)).alias("close_time_ns"),
        (opened + F.lit(interval_ns - 1 + availability_lag_ns)).alias("available_time_ns"),
        *[_number(field(i), PRICE).alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)],
        _number(field(6), AMOUNT).alias("base_volume"),
        _number(field(7), AMOUNT).alias("quote_volume"),
        F.lit(None).cast("bigint").alias("trade_count"),
        (field(8) == "1").alias("confirmed"),
        F.sha2(F.to_json("_r"), 256).alias("source_payload_hash"),
        (~F.coalesce("_accepted", F.lit(False)) | (F.size("_r") != 9)).alias("_bad"),
    )
    return _with_malformed(out)


def kline_candles(
    pages: DataFrame, payload: str, *, interval_ns: int, availability_lag_ns: int,
    confirmed_through_ns: Column | None, keep: list[str],
) -> DataFrame:
    """Twelve-field arrays mixing integers and decimal strings.

    A bar is confirmed when its close is not past `confirmed_through_ns`.
    """
    rows = pages.select(*keep, F.explode_outer(F.from_json(payload, "array<array<string>>")).alias("_r"),
                        (F.lit(None).cast("bigint") if confirmed_through_ns is None else confirmed_through_ns).alias("_through"))
    field = lambda i: F.get("_r", F.lit(i))
    closed = _number(field(6), "bigint") * F.lit(1_000_000)
    out = rows.select(
        *keep,
        (_number(field(0), "bigint") * F.lit(1_000_000)).alias("open_time_ns"),
        closed.alias("close_time_ns"),
        (closed + F.lit(availability_lag_ns)).alias("available_time_ns"),
        *[_number(field(i), PRICE).alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)],
        _number(field(5), AMOUNT).alias("base_volume"),
        _number(field(7), AMOUNT).alias("quote_volume"),
        _number(field(8), "bigint").alias("trade_count"),
        F.coalesce(closed <= F.col("_through"), F.lit(True)).alias("confirmed"),
        F.sha2(F.to_json("_r"), 256).alias("source_payload_hash"),
        (F.size("_r") != 12).alias("_bad"),
    )
    return _with_malformed(out)


def _with_malformed(rows: DataFrame) -> DataFrame:
    absent = unparsed("open_time_ns", "open", "high", "low", "close", "base_volume", "quote_volume")
    return rows.withColumn("malformed", F.coalesce("_bad", F.lit(True)) | absent).drop("_bad")


def kline_csv(lines: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """Dump rows as CSV text: header skipped, nine columns needed, mixed-era epochs."""
    fields = F.split(F.col(line), ",")
    opened, closed = normalise_epoch_ns(F.get("_f", F.lit(0)).try_cast("bigint")), normalise_epoch_ns(
        F.get("_f", F.lit(6)).try_cast("bigint")
    )
    at = lambda i, kind: _number(F.get("_f", F.lit(i)), kind)
    return (
        lines.withColumn("_f", fields)
        .filter(~F.get("_f", F.lit(0)).startswith("open_time"))
        .select(
            *keep, opened.alias("open_time_ns"), closed.alias("close_time_ns"),
            (closed + F.lit(1)).alias("available_time_ns"),
            *[at(i, PRICE).alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)],
            at(5, AMOUNT).alias("base_volume"), at(7, AMOUNT).alias("quote_volume"),
            at(8, "bigint").alias("trade_count"), (F.size("_f") < 9).alias("_bad"),
        ).transform(_with_malformed).withColumn("malformed", F.col("malformed") | unparsed("close_time_ns", "trade_count"))
    )


def funding_csv(lines: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """Settlement dump rows: epoch ms, interval hours, rate."""
    at = lambda i, kind: _number(F.get("_f", F.lit(i)), kind)
    return (
        lines.withColumn("_f", F.split(F.col(line), ","))
        .filter(~F.get("_f", F.lit(0)).startswith("calc_time"))
        .select(
            *keep, (at(0, "bigint") * F.lit(1_000_000)).alias("calc_time_ns"),
            at(1, "bigint").alias("funding_interval_hours"), at(2, "decimal(20,10)").alias("rate"),
        ).withColumn("malformed", unparsed("calc_time_ns", "funding_interval_hours", "rate"))
    )


def funding_pages(pages: DataFrame, payload: str, *, row_limit: int, keep: list[str]) -> DataFrame:
    """Settlement history pages clipped to ``[start_ms, end_ms]`` of the page.

    A page at the row limit may be truncated and is flagged, and so is a
    repeated settlement time; neither is silently repaired.
    """
    items = F.from_json(payload, "array<struct<fundingTime bigint, fundingRate string>>")
    rows = pages.withColumn("_i", items).select(
        *keep, "start_ms", "end_ms", (F.size("_i") >= row_limit).alias("truncated"),
        (F.size("_i") != F.size(F.array_distinct(F.transform("_i", lambda i: i["fundingTime"])))).alias("repeated"),
        F.explode("_i").alias("_r"),
    )
    return rows.filter(F.col("_r.fundingTime").between(F.col("start_ms"), F.col("end_ms"))).select(
        *keep, (F.col("_r.fundingTime") * F.lit(1_000_000)).alias("calc_time_ns"),
        _number(F.col("_r.fundingRate"), "decimal(20,10)").alias("rate"), "truncated", "repeated",
    )


def trades(lines: DataFrame, line: str, *, availability_lag_ns: int, downloaded_at_ns: int) -> DataFrame:
    """Trade JSON lines with string fields and an explicit taker side.

    The hash is that of the whole line, so copies that differ in any field are
    versions. `malformed` marks a line with a field missing or not parsed.
    """
    item = F.from_json(line, "struct<instId string, tradeId string, px string, sz string, side string, ts string>")
    stamp = _number(F.col("_t.ts"), "bigint") * F.lit(1_000_000)
    return lines.withColumn("_t", item).select(
        F.col("_t.instId").alias("instrument_id"), F.col("_t.tradeId").alias("trade_id"),
        stamp.alias("event_time_ns"), (stamp + F.lit(availability_lag_ns)).alias("available_time_ns"),
        F.lit(downloaded_at_ns).alias("received_time_ns"), _number(F.col("_t.px"), PRICE).alias("price"),
        _number(F.col("_t.sz"), AMOUNT).alias("quantity"), F.col("_t.side").alias("side"),
        F.sha2(F.col(line), 256).alias("source_payload_hash"),
    ).withColumn("malformed", unparsed("instrument_id", "trade_id", "event_time_ns", "price", "quantity")
                 | ~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False)))


def aggregate_trades(lines: DataFrame, line: str, *, availability_lag_ns: int, keep: list[str]) -> DataFrame:
    """Aggregate-trade JSON lines; the buyer-is-maker flag gives the taker side. Hash and `malformed` as for trades."""
    item = F.from_json(line, "struct<a bigint, p string, q string, T bigint, m boolean>")
    stamp = F.col("_t.T") * F.lit(1_000_000)
    return lines.withColumn("_t", item).select(
        *keep, F.col("_t.a").alias("sequence"), stamp.alias("event_time_ns"),
        (stamp + F.lit(availability_lag_ns)).alias("available_time_ns"),
        _number(F.col("_t.p"), PRICE).alias("price"), _number(F.col("_t.q"), AMOUNT).alias("quantity"),
        F.when(F.col("_t.m"), "sell").when(~F.col("_t.m"), "buy").alias("side"),
        F.sha2(F.col(line), 256).alias("source_payload_hash"),
    ).withColumn("malformed", unparsed("sequence", "event_time_ns", "price", "quantity", "side"))


_LEVELS = "array<array<string>>"


def _levels(raw: Column) -> Column:
    """Two-string level arrays to (price, quantity) structs."""
    return F.transform(
        raw,
        lambda l: F.struct(
            F.get(l, F.lit(0)).try_cast("double").alias("price"), F.get(l, F.lit(1)).try_cast("double").alias("quantity")
        ),
    )


def _bad_levels(raw: Column) -> Column:
    """Whether a side is missing, or a level of it is not two numbers, the first positive and the second not negative."""
    price = lambda l: F.get(l, F.lit(0)).try_cast("double")
    quantity = lambda l: F.get(l, F.lit(1)).try_cast("double")
    broken = F.exists(raw, lambda l: ~F.coalesce((price(l) > 0) & (quantity(l) >= 0), F.lit(False)))
    return F.coalesce(broken, F.lit(True))


def channel_depth(messages: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Snapshot / update messages with sequence and previous sequence.

    A snapshot must carry previous sequence -1 and a message exactly one item.
    """
    shape = (
        "struct<arg struct<channel string, instId string>, action string, data array<struct<"
        f"seqId bigint, prevSeqId bigint, ts string, bids {_LEVELS}, asks {_LEVELS}>>>"
    )
    item = F.get("_m.data", F.lit(0))
    snapshot = F.col("_m.action") == "snapshot"
    valid = (
        (F.col("_m.arg.channel") == "books") & F.col("_m.action").isin("snapshot", "update")
        & (F.size("_m.data") == 1) & (~snapshot | (item["prevSeqId"] == -1))
    )
    return messages.withColumn("_m", F.from_json(payload, shape)).select(
        *keep, F.col("_m.arg.instId").alias("instrument_id"), F.col("_m.action").alias("action"),
        item["seqId"].alias("sequence"), F.when(~snapshot, item["prevSeqId"]).alias("previous_sequence"),
        (item["ts"].try_cast("bigint") * F.lit(1_000_000)).alias("event_time_ns"),
        _levels(item["bids"]).alias("bids"), _levels(item["asks"]).alias("asks"),
        (F.coalesce(~valid, F.lit(True)) | item["seqId"].isNull() | item["ts"].try_cast("bigint").isNull()
         | _bad_levels(item["bids"]) | _bad_levels(item["asks"])).alias("malformed"),
    )


def rest_depth(messages: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """REST depth snapshots: update id, event time, levels of both sides."""
    shape = f"struct<lastUpdateId bigint, T bigint, bids {_LEVELS}, asks {_LEVELS}>"
    return messages.withColumn("_m", F.from_json(payload, shape)).select(
        *keep, F.col("_m.lastUpdateId").alias("sequence"), F.lit(None).cast("bigint").alias("previous_sequence"),
        (F.col("_m.T") * F.lit(1_000_000)).alias("event_time_ns"), _levels(F.col("_m.bids")).alias("bids"),
        _levels(F.col("_m.asks")).alias("asks"),
        (F.col("_m.lastUpdateId").isNull() | F.col("_m.T").isNull() | _bad_levels(F.col("_m.bids"))
         | _bad_levels(F.col("_m.asks"))).alias("malformed"),
    )


def diff_depth(messages: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Depth diffs: first and final update id, link to the previous final id.

    The two ids are keys that differ only in case, which a struct field cannot.
    """
    shape = f"struct<s string, pu bigint, T bigint, b {_LEVELS}, a {_LEVELS}>"
    at = lambda path: F.get_json_object(payload, path)
    first, final = at("$.U").try_cast("bigint"), at("$.u").try_cast("bigint")
    valid = (at("$.e") == "depthUpdate") & (first <= final) & F.col("_m.pu").isNotNull()
    return messages.withColumn("_m", F.from_json(payload, shape)).select(
        *keep, F.col("_m.s").alias("instrument_id"), final.alias("sequence"),
        F.col("_m.pu").alias("previous_sequence"), (F.col("_m.T") * F.lit(1_000_000)).alias("event_time_ns"),
        _levels(F.col("_m.b")).alias("bids"), _levels(F.col("_m.a")).alias("asks"),
        (F.coalesce(~valid, F.lit(True)) | F.col("_m.T").isNull() | _bad_levels(F.col("_m.b"))
         | _bad_levels(F.col("_m.a"))).alias("malformed"),
    )


def symbol_kept(symbol: Column, quote: str) -> Column:
    """Quoted in the wanted asset; anything else is out of scope, not excluded."""
    return symbol.endswith(quote)


def symbol_usable(symbol: Column) -> Column:
    return symbol.rlike(SYMBOL_PATTERN)


def premium_rows(entries: DataFrame, quote: str, keep: list[str]) -> DataFrame:
    """All-symbol premium entries with an `excluded` flag where nothing is measured.

    Entries quoted in another asset are dropped. `malformed` marks an entry
    whose fields do not parse, which refuses the whole payload it came in.
    """
    mark, index, rate = (_number(F.col(c), PRICE) for c in ("markPrice", "indexPrice", "lastFundingRate"))
    rows = entries.filter(symbol_kept(F.col("symbol"), quote)).select(
        *keep, "symbol", mark.alias("mark_price"), index.alias("index_price"), rate.alias("last_funding_rate"),
        F.col("nextFundingTime").alias("next_funding_ms"),
    )
    nothing = (
        ~symbol_usable(F.col("symbol")) | (F.col("mark_price") <= 0) | (F.col("index_price") <= 0)
        | (F.col("next_funding_ms") <= 0)
    )
    absent = (
        F.col("mark_price").isNull() | F.col("index_price").isNull() | F.col("last_funding_rate").isNull()
        | F.col("next_funding_ms").isNull()
    )
    m, i = F.col("mark_price").cast("double"), F.col("index_price").cast("double")
    return rows.withColumns(
        {
            "malformed": absent & symbol_usable(F.col("symbol")),
            "excluded": F.coalesce(nothing, F.lit(False)),
            "basis_bps": F.bround(F.try_divide(m - i, i) * 10_000.0, 6),
        }
    )


def ticker_rows(entries: DataFrame, quote: str, keep: list[str]) -> DataFrame:
    """All-symbol best bid / ask entries under the same exclusion rule."""
    cols = ("bidPrice", "bidQty", "askPrice", "askQty")
    names = ("bid_price", "bid_qty", "ask_price", "ask_qty")
    rows = entries.filter(symbol_kept(F.col("symbol"), quote)).select(
        *keep, "symbol", *[_number(F.col(c), PRICE).cast("double").alias(n) for c, n in zip(cols, names, strict=True)]
    )
    b, a = F.col("bid_price"), F.col("ask_price")
    spread = F.bround(F.try_divide(a - b, (a + b) / 2) * 10_000.0, 6)
    nothing = (
        ~symbol_usable(F.col("symbol")) | (F.least(*names) <= 0) | (b >= a)
    )
    absent = b.isNull() | a.isNull() | F.col("bid_qty").isNull() | F.col("ask_qty").isNull()
    return rows.withColumn("spread_bps", spread).withColumns(
        {
            "malformed": absent & symbol_usable(F.col("symbol")),
            "excluded": F.coalesce(nothing | (F.col("spread_bps") <= 0), F.lit(False)),
        }
    )


