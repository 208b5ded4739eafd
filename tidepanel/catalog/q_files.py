"""Dumps, line files and datasets as real files: written, read back, refused and audited."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.q_sources import csv_lines, decimal_text, trade_lines
from tidepanel.catalog.registry import query
from tidepanel.catalog.sqlviews import SECOND, with_views
from tidepanel.functions.timefns import int_div
from tidepanel.operators import quality
from tidepanel.session import discard, scratch_path, staged
from tidepanel.sources import panel, payloads

KLINE_HEADER, FUNDING_HEADER = "open_time", "calc_time"


def kline_archives(t) -> str:
    """One archive per instrument and thousand days; the close of every 50th day is no number, every 77th line is cut short."""
    bars = t.bars("p_brand")
    line = F.element_at(F.split("line", ","), 1)
    day = int_div(F.when(F.length(line) > 14, line.try_cast("bigint") / 1000).otherwise(line.try_cast("bigint")).cast("bigint"), 86_400_000)
    lines = csv_lines(t).filter(~F.col("line").startswith(KLINE_HEADER)).withColumn("position", day)
    broken = F.when(F.col("position") % 50 == 0, F.regexp_replace("line", r"^(\d+,[^,]+,[^,]+,[^,]+),", "$1,x")).when(
        F.col("position") % 77 == 0, F.substring_index("line", ",", 7)).otherwise(F.col("line"))
    path = scratch_path(bars.sparkSession, "kline-zips")
    archive = F.concat_ws("-", F.regexp_replace("instrument_id", "[^A-Za-z0-9]", "_"), int_div(F.col("position"), 1000).cast("string"))
    panel.write_archives(lines.select(archive.alias("archive"), "position", broken.alias("line")), path, header="open_time,open,high,low,close,volume")
    return path


def kline_rows(t):
    lines = panel.zipped_lines(t.spark, kline_archives(t), KLINE_HEADER)
    return payloads.kline_csv(lines, "line", ["archive"])


ARCHIVE_SQL = "regexp_replace(instrument_id, '[^A-Za-z0-9]', '_', 'g') || '-' || (day // 1000)"


@query("a06b_zipped_kline_dump", with_views("bars_brand") + f"""
SELECT {ARCHIVE_SQL} AS archive, open_time_ns, close_time_ns - 1000000 AS close_time_ns, round(close, 8) AS close, trade_count
FROM bars_brand WHERE day % 50 <> 0 AND day % 77 <> 0""")
def a06b(t):
    rows = kline_rows(t).filter(~F.col("malformed"))
    return rows.select("archive", "open_time_ns", "close_time_ns", F.round(F.col("close").cast("double"), 8).alias("close"), "trade_count")


@query("a06c_zipped_kline_rejects", with_views("bars_brand") + f"""
SELECT {ARCHIVE_SQL} AS archive, count(*) AS refused, min(open_time_ns) AS first_ns FROM bars_brand WHERE day % 50 = 0 OR day % 77 = 0 GROUP BY ALL""")
def a06c(t):
    return kline_rows(t).filter("malformed").groupBy("archive").agg(F.count("*").alias("refused"), F.min("open_time_ns").alias("first_ns"))


def funding_rows(t):
    """Archives without a header, as older dumps are; every 31st day's rates are no numbers."""
    events = t.funding("p_brand").withColumn("day", int_div(F.col("calc_time_ns"), 86_400_000_000_000))
    line = F.concat_ws(",", int_div(F.col("calc_time_ns"), 1_000_000).cast("string"), F.lit("8"),
                       F.when(F.col("day") % 31 == 0, F.lit("n/a")).otherwise(F.col("rate").cast("string")))
    archive = F.concat_ws("-", F.regexp_replace("instrument_id", "[^A-Za-z0-9]", "_"), int_div(F.col("day"), 1000).cast("string"))
    path = scratch_path(t.spark, "funding-zips")
    panel.write_archives(events.select(archive.alias("archive"), F.col("calc_time_ns").alias("position"), line.alias("line")), path)
    return payloads.funding_csv(panel.zipped_lines(t.spark, path, FUNDING_HEADER), "line", ["archive"])


FUNDING_SQL = "SELECT *, calc_time_ns // 86400000000000 AS day FROM funding_brand"


@query("a07b_zipped_funding_dump", with_views("funding_brand", more={"f": FUNDING_SQL}) + f"""
SELECT {ARCHIVE_SQL} AS archive, calc_time_ns, CAST(rate AS DOUBLE) AS rate FROM f WHERE day % 31 <> 0""")
def a07b(t):
    return funding_rows(t).filter(~F.col("malformed")).select("archive", "calc_time_ns", F.col("rate").cast("double").alias("rate"))


@query("a07c_zipped_funding_rejects", with_views("funding_brand", more={"f": FUNDING_SQL}) + f"""
SELECT {ARCHIVE_SQL} AS archive, count(*) AS refused FROM f WHERE day % 31 = 0 GROUP BY ALL""")
def a07c(t):
    return funding_rows(t).filter("malformed").groupBy("archive").agg(F.count("*").alias("refused"))


TRADE_SCHEMA = "instId string, tradeId string, px string, sz string, side string, ts string"


def trade_files(t):
    """Trade lines as files; every 59th line is cut off in the middle."""
    path = scratch_path(t.spark, "trades-jsonl")
    number = F.get_json_object("value", "$.tradeId").cast("bigint")
    whole = trade_lines(t).select(F.col("line").alias("value"))
    whole.select(F.when(number % 59 == 0, F.expr("substring(value, 1, 40)")).otherwise(F.col("value")).alias("value")).write.text(path)
    return panel.json_lines(t.spark, path, TRADE_SCHEMA)


@query("a10c_trade_file", with_views("ticks") + f"""
SELECT instrument_id, CAST(event_id AS VARCHAR) AS trade_id, event_time_ns // 1000000 * 1000000 + {SECOND} AS available_time_ns, round(price, 4) AS price, side
FROM ticks WHERE event_id % 59 <> 0 AND event_id % 41 <> 0 AND event_id % 43 <> 0""")
def a10c(t):
    rows, _ = trade_files(t)
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))
    parsed = payloads.trades(lines, "line", availability_lag_ns=SECOND, downloaded_at_ns=0).filter(~F.col("malformed"))
    keys = ["instrument_id", "trade_id"]
    kept, _ = quality.admit(parsed, keys, [c for c in parsed.columns if c not in keys])
    return kept.select(*keys, "available_time_ns", F.round(F.col("price").cast("double"), 4).alias("price"), "side")


@query("a10d_trade_file_rejects", with_views("ticks") + """
SELECT instrument_id, count(*) * 2 AS lines FROM ticks WHERE event_id % 59 = 0 GROUP BY ALL""")
def a10d(t):
    _, refused = trade_files(t)
    return refused.groupBy(F.regexp_extract("line", '"instId":"([^"]+)"', 1).alias("instrument_id")).agg(F.count("*").alias("lines"))


AGGREGATE_SCHEMA = "a bigint, p string, q string, T bigint, m boolean"


def aggregate_files(t):
    """Aggregate trades as files; every 61st line has text where the number of the trade belongs."""
    e = F.col("event_id")
    number = F.when(e % 61 == 0, F.lit('"?"')).otherwise(e.cast("string"))
    line = F.concat(F.lit('{"a":'), number, F.lit(',"p":"'), decimal_text("price"), F.lit('","q":"'), decimal_text("quantity"), F.lit('","T":'),
                    int_div(F.col("event_time_ns"), 1_000_000).cast("string"), F.lit(',"m":'), (e % 3 == 0).cast("string"), F.lit("}"))
    path = scratch_path(t.spark, "aggregates-jsonl")
    t.ticks.select(line.alias("value")).write.text(path)
    return panel.json_lines(t.spark, path, AGGREGATE_SCHEMA)


@query("a11c_aggregate_trade_file", with_views("ticks") + """
SELECT event_id AS sequence, event_time_ns // 1000000 * 1000000 AS event_time_ns, CASE WHEN event_id % 3 = 0 THEN 'sell' ELSE 'buy' END AS side
FROM ticks WHERE event_id % 61 <> 0""")
def a11c(t):
    rows, _ = aggregate_files(t)
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))
    parsed = payloads.aggregate_trades(lines, "line", availability_lag_ns=SECOND, keep=[])
    return parsed.filter(~F.col("malformed")).select("sequence", "event_time_ns", "side")


@query("a11d_aggregate_trade_file_rejects", with_views("ticks") + """
SELECT count(*) AS lines, min(event_time_ns // 1000000) AS first_ms FROM ticks WHERE event_id % 61 = 0""")
def a11d(t):
    _, refused = aggregate_files(t)
    return refused.agg(F.count("*").alias("lines"), F.min(F.get_json_object("line", "$.T").cast("bigint")).alias("first_ms"))


def by_partition(rows):
    return rows.select(F.url_decode(F.regexp_extract("file", r"instrument_id=([^/]+)/", 1)).alias("instrument_id"), "reason")


@query("a20b_audited_dataset", with_views("bars_brand", more={"r": "SELECT instrument_id, row_number() OVER (ORDER BY instrument_id) AS n FROM (SELECT DISTINCT instrument_id FROM bars_brand)"}) + """
SELECT instrument_id, CASE WHEN n % 5 = 0 THEN 'mismatched' ELSE 'missing' END AS reason FROM r WHERE n % 5 = 0 OR n % 7 = 1
UNION ALL SELECT 'late', 'unlisted'""")
def a20b(t):
    """A published dataset after some files were changed, some lost and one added behind the manifest's back."""
    from pyspark.sql import Window as W

    spark, path = t.spark, scratch_path(t.spark, "audited")
    bars = t.bars("p_brand").withColumn("instrument_id", F.col("instrument_id")).select("instrument_id", "open_time_ns", "close")
    manifest = panel.publish_with_manifest(bars, path, ["instrument_id"])
    # A manifest has a row for each file; this one is numbered by instrument, of which there are few.
    numbered = manifest.withColumn("n", F.row_number().over(W.orderBy("file"))).filter("n % 5 = 0 OR n % 7 = 1").collect()
    for r in numbered:
        place = f"{path}/{r.file}"
        if r.n % 5 == 0:
            changed = spark.read.parquet(place).withColumn("close", F.col("close") + 1)
            replaced = scratch_path(spark, "changed")
            changed.coalesce(1).write.parquet(replaced)
            panel.move_into(spark, replaced, place)
        else:
            discard(spark, place)
    bars.limit(1).drop("instrument_id").coalesce(1).write.parquet(f"{path}/instrument_id=late")
    return by_partition(panel.audit(spark, path))


@query("a19b_append_log", with_views("chain") + """
SELECT kind AS family, count(*) AS records, 0 AS conflicts FROM chain GROUP BY ALL
UNION ALL SELECT 'conflict:' || kind, 0, count(*) FROM chain WHERE event_id % 6 = 0 GROUP BY ALL""")
def a19b(t):
    """A log that grows in three appends; the second repeats known records, some of them with other content, the third is all known."""
    path = scratch_path(t.spark, "log")
    records = staged(t.chain.select("event_id", "kind", F.when(F.col("event_id") % 4 != 0, F.col("payload")).alias("payload"), "content_hash"), "records")
    panel.append_to_log(t.spark, path, records.filter("event_id % 2 = 0"), "event_id")
    altered = records.withColumn("content_hash", F.when(F.col("event_id") % 6 == 0, F.lit("altered")).otherwise(F.col("content_hash")))
    conflicts = panel.append_to_log(t.spark, path, altered, "event_id")
    panel.append_to_log(t.spark, path, records, "event_id")
    listed = t.spark.read.parquet(path).groupBy(F.col("kind").alias("family")).agg(F.count("*").cast("int").alias("records"), F.lit(0).alias("conflicts"))
    refused = conflicts.groupBy(F.concat(F.lit("conflict:"), "kind").alias("family")).agg(F.lit(0).alias("records"), F.count("*").cast("int").alias("conflicts"))
    return listed.unionByName(refused)
