"""Streaming queries over a landing folder written from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.registry import query, rounded
from tidepanel.catalog.sqlviews import with_views
from tidepanel.functions.timefns import ns_to_timestamp
from tidepanel.operators import skewsafe
from tidepanel.streaming import monitors

DELAY = "1 hour"


def source(t, rows, label):
    path, _ = monitors.landing(t.spark, rows, label)
    return monitors.read_landing(t.spark, path, rows.schema)


def stamped(t):
    return t.ticks.withColumn("event_time", ns_to_timestamp(F.col("event_time_ns")))


def windows_sql(step: str, width: str) -> str:
    return f"""
SELECT instrument_id, epoch(s) AS start, epoch(s + INTERVAL {width}) AS "end", count(*) AS rounds, sum(quantity) AS quantity,
  s + INTERVAL {width} <= (SELECT max(make_timestamp(event_time_ns // 1000)) - INTERVAL 1 HOUR FROM ticks) AS is_closed
FROM (SELECT *, make_timestamp(event_time_ns // 1000) AS ts FROM ticks) t
JOIN (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-03-01', INTERVAL {step})) AS s) w ON ts >= s AND ts < s + INTERVAL {width} GROUP BY ALL"""


def windows(t, label, width, slide=None):
    out = monitors.latest(monitors.windowed_means(source(t, stamped(t), label), window=width, slide=slide), label)
    return monitors.with_closed(out, DELAY).select(
        "instrument_id", F.unix_timestamp("start").cast("double").alias("start"), F.unix_timestamp("end").cast("double").alias("end"),
        "rounds", "quantity", "is_closed",
    )


@query("k02_tumbling_window_stream", with_views("ticks") + windows_sql("1 DAY", "1 DAY"))
def k02(t):
    return windows(t, "tumbling", "1 day")


@query("k02b_sliding_window_stream", with_views("ticks") + windows_sql("6 HOUR", "1 DAY"))
def k02b(t):
    return windows(t, "sliding", "1 day", "6 hours")


@query("k01_append_only_stream", with_views("chain") + "SELECT chain_id, sequence, content_hash FROM chain")
def k01(t):
    rows = t.chain.select("chain_id", "sequence", "content_hash")
    return monitors.drain(source(t, rows, "segments"), "segments")


@query("k08_stream_dedupe", with_views("ticks") + "SELECT event_id, instrument_id FROM ticks")
def k08(t):
    rows = stamped(t).select("event_id", "instrument_id", "event_time")
    doubled = rows.unionByName(rows.filter("event_id % 3 = 0"))
    return monitors.drain(monitors.deduplicated(source(t, doubled, "dedupe"), ["event_id"], DELAY), "dedupe").select("event_id", "instrument_id")


@query("k08b_stream_left_out", with_views("ticks") + """
SELECT event_id, 'conflict' AS reason FROM ticks WHERE event_id % 9 = 0""")
def k08b(t):
    rows = stamped(t).select("event_id", "instrument_id", "event_time")
    altered = rows.filter("event_id % 9 = 0").withColumns({"instrument_id": F.lit("altered"), "event_time": F.col("event_time") + F.expr("INTERVAL 1 MINUTE")})
    path, _ = monitors.landing(t.spark, rows, "versions")
    altered.write.mode("append").parquet(path)
    landed = t.spark.read.schema(rows.schema).parquet(path)
    stream = monitors.read_landing(t.spark, path, rows.schema)
    kept = monitors.drain(monitors.deduplicated(stream, ["event_id"], DELAY), "versions")
    # Which version comes first is the stream's affair; the other one is told.
    return monitors.left_out(landed, kept, ["event_id"], ["instrument_id"]).select("event_id", "reason")


@query("k06_misplaced_records", with_views("ticks") + "SELECT event_id FROM ticks WHERE event_id % 12 = 0")
def k06(t):
    day = F.date_format("event_time", "yyyy-MM-dd")
    rows = stamped(t).select("event_id", "event_time", F.when(F.col("event_id") % 12 == 0, "1999-01-01").otherwise(day).alias("day"))
    return monitors.drain(monitors.misplaced(source(t, rows, "misplaced")), "misplaced").select("event_id")


@query("k07_liveness", with_views("ticks") + """
SELECT instrument_id, round((1706659200000000000 - max(event_time_ns)) / 1e9, 3) AS newest_age_s, count(*) AS records FROM ticks GROUP BY ALL""")
def k07(t):
    return rounded(monitors.liveness(t.ticks, 1_706_659_200_000_000_000), 3)


def book_updates(t):
    """Book updates per user: snapshots now and then, gaps, and some crossing bids."""
    e = F.col("event_id")
    price = F.floor(F.col("price")) % 50
    side = F.when(e % 2 == 0, "bid").otherwise("ask")
    rows = t.ticks.select(
        F.col("user_id").cast("string").alias("instrument_id"), "event_id", side.alias("side"),
        F.when(e % 97 == 0, 500.0).when(side == "bid", price + 1.0).otherwise(price + 51.0).alias("price"),
        F.when(e % 10 == 3, 0.0).otherwise(F.col("quantity")).alias("quantity"),
    )
    bucket = skewsafe.even_bucket(t.read("events"), "event_id")
    numbered = skewsafe.with_ordinal(rows, ["instrument_id"], ["event_id"], bucket, "sequence")
    kept = numbered.filter("sequence % 17 <> 0").withColumn("kind", F.when(F.col("sequence") % 8 == 1, "snapshot").otherwise("delta"))
    # A segment is everything from one snapshot up to the next.
    opening = F.when(F.col("kind") == "snapshot", F.col("sequence"))
    placed = skewsafe.carry(kept, ["instrument_id"], ["event_id"], bucket, opening, "segment").fillna(0, ["segment"])
    return placed.select("instrument_id", "segment", "sequence", "kind", "side", "price", "quantity")


@query("k03_order_book_reconstruction")
def k03(t):
    return monitors.reconstruct_books(book_updates(t))


@query("k03b_order_book_stream")
def k03b(t):
    return monitors.drain(monitors.stream_books(source(t, book_updates(t), "books")), "books")
