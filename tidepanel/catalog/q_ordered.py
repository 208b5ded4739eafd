"""Stateful streams over landing folders that fill file by file, with restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.catalog.registry import query
from tidepanel.catalog.sqlviews import HOUR, with_views
from tidepanel.functions.timefns import ns_to_timestamp
from tidepanel.operators import skewsafe
from tidepanel.session import scratch_path, staged
from tidepanel.streaming import monitors, ordered

SLICES = 6


def land(rows: DataFrame, part, order, path: str, key: str, files: int = 1) -> None:
    """Write `rows` slice by slice, in the given order, behind what is there.

    A key's rows of a slice are in one file, so that they are met in order however files share a trigger.
    """
    for i in order:
        rows.filter(part == i).repartition(files, key).write.mode("append").parquet(path)


def files_of(t) -> int:
    """Files of a slice, so that a task's share of the landing stays the same as the table grows."""
    return -(-t.read("events").count() // (SLICES * 250_000))


def shards_of(t) -> int:
    return t.pieces("events", 4_000)


def stream_of(rows: DataFrame, path: str, files: int = 1) -> DataFrame:
    return monitors.read_landing(rows.sparkSession, path, rows.schema, files_per_trigger=files)


def sliced(column: str, frame: DataFrame, slices: int = SLICES):
    """Number of the even slice of `column`'s range that a row is in."""
    span = frame.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    low, high = span.select("a").scalar(), span.select("b").scalar()
    return F.least(F.floor((F.col(column) - low) * slices / (high - low + 1)), F.lit(slices - 1))


def depth_messages(t) -> DataFrame:
    """A snapshot every eighth message of a user and deltas of two levels a side between them; every 17th is lost, some bids cross."""
    e, price = F.col("event_id"), F.floor(F.col("price")) % 50
    rows = t.ticks.select(F.col("user_id").cast("string").alias("instrument_id"), "event_id", "event_time_ns", "quantity", price.cast("double").alias("p"))
    bucket = skewsafe.even_bucket(t.ticks, "event_time_ns")
    numbered = skewsafe.with_ordinal(rows, ["instrument_id"], ["event_time_ns", "event_id"], bucket, "sequence")
    level = lambda px, qty: F.struct(px.cast("double").alias("price"), qty.cast("double").alias("quantity"))
    snapshot = F.col("sequence") % 8 == 1
    emptied = F.when(e % 10 == 3, F.lit(0.0)).otherwise(F.col("quantity"))
    bids = F.array(level(F.when(e % 97 == 0, F.lit(500.0)).otherwise(F.col("p") + 1), emptied), level(F.lit(0.5), F.lit(1.0)))
    asks = F.array(level(F.col("p") + 60, emptied), level(F.lit(200.0), F.lit(1.0)))
    return numbered.filter("sequence % 17 <> 0").select(
        "instrument_id", ns_to_timestamp(F.col("event_time_ns")).alias("event_time"), "event_time_ns",
        F.when(snapshot, "snapshot").otherwise("update").alias("action"), "sequence",
        F.when(~snapshot, F.col("sequence") - 1).alias("previous_sequence"), bids.alias("bids"), asks.alias("asks"),
    )


BOOK_SQL = {
    "seq": """
    SELECT CAST(user_id AS VARCHAR) AS instrument_id, event_id, quantity, CAST(floor(price) % 50 AS DOUBLE) AS p,
      row_number() OVER (PARTITION BY user_id ORDER BY event_time_ns, event_id) AS sequence FROM ticks""",
    "got": """
    SELECT *, sequence % 8 = 1 AS snap, max(CASE WHEN sequence % 8 = 1 THEN sequence END) OVER (PARTITION BY instrument_id ORDER BY sequence) AS segment,
      CASE WHEN event_id % 10 = 3 THEN 0 ELSE quantity END AS q, CASE WHEN event_id % 97 = 0 THEN 500 ELSE p + 1 END AS b
    FROM seq WHERE sequence % 17 <> 0""",
    "broken": """
    SELECT *, (event_id % 97 = 0 AND q > 0) OR (NOT snap AND lag(sequence) OVER w IS DISTINCT FROM sequence - 1) AS breaks
    FROM got WINDOW w AS (PARTITION BY instrument_id ORDER BY sequence)""",
    "stated": """
    SELECT *, segment IS NULL OR bool_or(breaks) OVER (PARTITION BY instrument_id, segment ORDER BY sequence) AS bad FROM broken""",
    "lv": """
    SELECT instrument_id, segment, sequence, 'b' AS side, b AS price, q FROM stated UNION ALL SELECT instrument_id, segment, sequence, 'b', 0.5, 1 FROM stated
    UNION ALL SELECT instrument_id, segment, sequence, 'a', p + 60, q FROM stated UNION ALL SELECT instrument_id, segment, sequence, 'a', 200, 1 FROM stated""",
    "cur": """
    SELECT s.instrument_id, s.sequence, l.side, l.price, arg_max(l.q, l.sequence) AS q FROM stated s
    JOIN lv l ON l.instrument_id = s.instrument_id AND l.segment = s.segment AND l.sequence <= s.sequence WHERE NOT s.bad GROUP BY ALL""",
    "tops": """
    SELECT instrument_id, sequence, max(CASE WHEN side = 'b' THEN price END) AS best_bid, min(CASE WHEN side = 'a' THEN price END) AS best_ask
    FROM cur WHERE q > 0 GROUP BY ALL""",
}
BOOK_ROWS = """SELECT instrument_id, sequence, CASE WHEN bad THEN 'invalid' ELSE 'valid' END AS status, CAST(best_bid AS DOUBLE) AS best_bid,
  CAST(best_ask AS DOUBLE) AS best_ask FROM stated LEFT JOIN tops USING (instrument_id, sequence)"""


@query("k03c_ordered_order_books", with_views("ticks", more=BOOK_SQL) + BOOK_ROWS)
def k03c(t):
    """Slices come in swapped pairs, one a trigger; the watermark puts messages back in order."""
    rows, files = staged(depth_messages(t), "depth"), files_of(t)
    path = scratch_path(t.spark, "depth-landing")
    land(rows, sliced("event_time_ns", rows), [1, 0, 3, 2, 5, 4], path, "instrument_id", files)
    # A heartbeat after the last message lets the watermark pass all of them.
    later = F.max("event_time") + F.expr("INTERVAL 60 DAYS")
    beat = rows.agg(later.alias("event_time"), F.max("event_time_ns").alias("event_time_ns")).select(
        F.lit("heartbeat").alias("instrument_id"), "event_time", "event_time_ns", F.lit("update").alias("action"), F.lit(0).cast("bigint").alias("sequence"),
        F.lit(None).cast("bigint").alias("previous_sequence"), F.array().cast(rows.schema["bids"].dataType).alias("bids"),
        F.array().cast(rows.schema["asks"].dataType).alias("asks"))
    beat.select(*rows.columns).write.mode("append").parquet(path)
    books = monitors.drain(ordered.ordered_books(stream_of(rows, path, files), "12 days", shards_of(t)), "books")
    return books.filter("instrument_id <> 'heartbeat'")


@query("k03d_replayed_order_books", with_views("ticks", more=BOOK_SQL) + BOOK_ROWS)
def k03d(t):
    rows = depth_messages(t)
    bucket = skewsafe.even_bucket(rows, "event_time_ns")
    opening = F.when(F.col("action") == "snapshot", F.col("sequence"))
    placed = skewsafe.carry(rows, ["instrument_id"], ["event_time_ns", "sequence"], bucket, opening, "segment").fillna(0, ["segment"])
    return ordered.replayed_books(placed.select("instrument_id", "segment", "sequence", "action", "previous_sequence", "bids", "asks"))


CHAIN_SQL = {
    "snaps": """
    SELECT chain_id, sequence, string_agg(kind || '=' || payload, ',' ORDER BY kind) AS snapshot FROM (
      SELECT a.chain_id, a.sequence, b.kind, arg_max(b.payload, b.sequence) AS payload FROM numbered a
      JOIN numbered b ON b.chain_id = a.chain_id AND b.sequence <= a.sequence WHERE a.sequence % 5 = 0 GROUP BY ALL) GROUP BY ALL""",
    "links": """
    SELECT n.chain_id, n.sequence, n.event_id, n.kind, n.payload, s.snapshot FROM numbered n LEFT JOIN snaps s USING (chain_id, sequence)""",
    "grown": """
    SELECT *, repeat('0', 64) AS previous_hash, sha256(concat_ws('|', chain_id, sequence, kind, payload, coalesce(snapshot, ''), repeat('0', 64))) AS content_hash
    FROM links WHERE sequence = 1
    UNION ALL
    SELECT l.*, g.content_hash, sha256(concat_ws('|', l.chain_id, l.sequence, l.kind, l.payload, coalesce(l.snapshot, ''), g.content_hash))
    FROM grown g JOIN links l ON l.chain_id = g.chain_id AND l.sequence = g.sequence + 1""",
}


def chain_records(t) -> DataFrame:
    return t.chain.select("chain_id", "event_id", "kind", "payload")


def grow_chain(t, records: DataFrame, path: str, out: str) -> DataFrame:
    """Run the chain over what has landed since its checkpoint was last written."""
    return monitors.drain_to(ordered.chained(stream_of(records, path, files_of(t)), shards_of(t)), out)


@query("k01b_chained_stream", with_views("numbered", more=CHAIN_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT chain_id, sequence, event_id, kind, payload, snapshot, previous_hash, content_hash FROM grown""")
def k01b(t):
    """Two runs from one checkpoint: the second goes on with the chains of the first."""
    records, files = staged(chain_records(t), "records"), files_of(t)
    part = sliced("event_id", records)
    path, out = scratch_path(t.spark, "records-landing"), scratch_path(t.spark, "chained")
    land(records, part, [0, 1, 2], path, "chain_id", files)
    grow_chain(t, records, path, out)
    land(records, part, [3, 4, 5], path, "chain_id", files)
    return grow_chain(t, records, path, out)


ARRIVED_SQL = {
    "sent": f"""
    SELECT chain_id, event_id, event_id AS arrival, sequence, received_time_ns - CASE WHEN event_id % 23 = 0 THEN {1000 * HOUR} ELSE 0 END AS received_ns,
      event_id % 12 = 0 AS elsewhere FROM broken_chain""",
    "again": "SELECT chain_id, event_id, event_id + 1000000000 AS arrival, sequence, received_ns, elsewhere FROM sent WHERE event_id % 19 = 0",
    "before": """
    SELECT *, lag(sequence) OVER w AS seq0, lag(received_ns) OVER w AS ns0 FROM sent WINDOW w AS (PARTITION BY chain_id ORDER BY arrival)""",
}


@query("k06b_stream_contiguity", with_views("broken_chain", more=ARRIVED_SQL) + """
SELECT chain_id, event_id, sequence, 'misplaced' AS reason FROM (SELECT * FROM sent UNION ALL SELECT * FROM again) WHERE elsewhere
UNION ALL SELECT chain_id, event_id, sequence, 'late' FROM again
UNION ALL SELECT chain_id, event_id, sequence, 'broken_run' FROM before WHERE sequence <> seq0 + 1
UNION ALL SELECT chain_id, event_id, sequence, 'clock_step' FROM before WHERE received_ns < ns0""")
def k06b(t):
    """Records with gaps, clock steps and wrong day folders, one slice a trigger; some come a second time in the last files."""
    stepped = F.col("received_time_ns") - F.when(F.col("event_id") % 23 == 0, F.lit(1000 * HOUR)).otherwise(F.lit(0))
    day = lambda ns: F.date_format(ns_to_timestamp(ns), "yyyy-MM-dd")
    sent = t.broken_chain.select(
        "chain_id", "event_id", F.col("event_id").alias("arrival"), "sequence", stepped.alias("received_ns"), day(stepped).alias("received_day"),
        F.when(F.col("event_id") % 12 == 0, "1999-01-01").otherwise(day(stepped)).alias("day"))
    sent, files = staged(sent, "sent"), files_of(t)
    again = sent.filter("event_id % 19 = 0").withColumn("arrival", F.col("arrival") + 1_000_000_000)
    path = scratch_path(t.spark, "arrivals-landing")
    land(sent, sliced("arrival", sent), range(SLICES), path, "chain_id", files)
    again.repartition(files, "chain_id").write.mode("append").parquet(path)
    return monitors.drain(ordered.discontinuities(stream_of(sent, path, files), shards_of(t)), "discontinuities")
