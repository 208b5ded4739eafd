"""Streams over append-only measurement records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepanel.session import scratch_path

BOOK_TOPS = "instrument_id string, sequence bigint, status string, best_bid double, best_ask double"
BOOK_UPDATES = ["instrument_id", "segment", "sequence", "kind", "side", "price", "quantity"]
SHARDS, BLOCK = 256, 8192


def landing(spark: SparkSession, rows: DataFrame, label: str) -> tuple[str, str]:
    """Write rows as a landing folder a file stream can read; returns path and schema."""
    path = scratch_path(spark, f"{label}-landing")
    rows.write.parquet(path)
    return path, rows.schema.simpleString()


def read_landing(spark: SparkSession, path: str, schema, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and read back what it wrote.

    Output and checkpoint live in the shared folder, so a restart resumes.
    """
    return drain_to(stream, scratch_path(stream.sparkSession, label), mode)


def drain_to(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """As `drain`, under a given path: a second run goes on from the checkpoint of the first."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint")
    query = writer.trigger(availableNow=True).format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def latest(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream whose result is complete after every batch, and read the last one.

    Each batch replaces a folder of its own, so a batch that is run again after
    a failure leaves the same rows.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    last: list[int] = []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch-{batch}")
        last[:] = [batch]

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-checkpoint")
    writer.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch-{last[0]}")


def windowed_means(stream: DataFrame, *, window: str, slide: str | None) -> DataFrame:
    """Event-time window means per instrument, open windows and late records included.

    For `latest`: the state is one row per window and instrument, bounded by the
    calendar, so no watermark has to discard a record.
    """
    span = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    return (
        stream.groupBy(span.alias("w"), "instrument_id")
        .agg(F.count("*").alias("rounds"), F.sum("quantity").alias("quantity"), F.max("price").alias("high"),
             F.max("event_time").alias("newest"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "instrument_id", "rounds", "quantity", "high", "newest")
    )


def with_closed(windows: DataFrame, delay: str) -> DataFrame:
    """`is_closed`: whether the newest record, less the delay, is past the window."""
    newest = windows.agg(F.max("newest").alias("n"))
    return windows.withColumn("is_closed", F.col("end") <= newest.select(F.col("n") - F.expr(f"INTERVAL {delay}")).scalar())


def deduplicated(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First copy of each key within the watermark."""
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(keys)


def left_out(landed: DataFrame, kept: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """What a deduplicated stream did not pass on, with the reason.

    `late`: a key that the watermark discarded altogether; `conflict`: another
    version of a key that was kept. Identical copies are no loss.
    """
    versions = landed.select(*keys, *content).distinct()
    held = kept.select(*keys, F.struct(*content).alias("_kept"))
    return versions.join(held, keys, "left").filter(~F.struct(*content).eqNullSafe(F.col("_kept"))).select(
        *keys, *content, F.when(F.col("_kept").isNull(), "late").otherwise("conflict").alias("reason")
    )


def misplaced(stream: DataFrame) -> DataFrame:
    """Records whose day folder is not the day they were received on."""
    return stream.filter(F.date_format("event_time", "yyyy-MM-dd") != F.col("day"))


def liveness(rows: DataFrame, now_ns) -> DataFrame:
    """Age of the newest record per key; negative when a clock ran ahead."""
    return rows.groupBy("instrument_id").agg(
        ((F.lit(now_ns) - F.max("event_time_ns")) / F.lit(1e9)).alias("newest_age_s"), F.count("*").alias("records")
    )


def replay_book(updates: Iterator[tuple], bids: dict, asks: dict, last: int | None, valid: bool):
    """Apply ordered updates to one book; yields each state and ends with the carry.

    A delta must follow its predecessor without a gap and must not cross the
    book; otherwise the book is invalid until the next snapshot.
    """
    for sequence, kind, side, price, quantity in updates:
        book = bids if side == "bid" else asks
        if kind == "snapshot":
            bids.clear()
            asks.clear()
            book[price] = quantity
            valid = True
        elif not valid or last is None or sequence != last + 1:
            bids.clear()
            asks.clear()
            valid = False
        elif quantity == 0:
            book.pop(price, None)
        else:
            book[price] = quantity
        if valid and bids and asks and max(bids) >= min(asks):
            bids.clear()
            asks.clear()
            valid = False
        last = sequence
        yield sequence, valid, (max(bids) if bids else None), (min(asks) if asks else None)


def reconstruct_books(updates: DataFrame) -> DataFrame:
    """Book state after every update, per snapshot segment.

    A snapshot resets everything before it, so segments are independent and a
    busy instrument spreads over them. Rows arrive partitioned by segment and in
    order, and each task streams through them one batch at a time. Expects
    ``segment``: the sequence of the latest snapshot at or before the row.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, bids, asks, last, valid = None, {}, {}, None, False
        for frame in batches:
            out = []
            for instrument, segment, *update in frame[BOOK_UPDATES].itertuples(index=False, name=None):
                if (instrument, segment) != current:
                    current, bids, asks, last, valid = (instrument, segment), {}, {}, None, False
                for last, valid, bid, ask in replay_book([tuple(update)], bids, asks, last, valid):
                    out.append((instrument, last, "valid" if valid else "invalid", bid, ask))
            yield pd.DataFrame(out, columns=["instrument_id", "sequence", "status", "best_bid", "best_ask"])

    placed = updates.repartition("instrument_id", "segment")
    return placed.sortWithinPartitions("instrument_id", "segment", "sequence").mapInPandas(run, BOOK_TOPS)


class BookProcessor(StatefulProcessor):
    """Order books kept per key; the rows of a trigger are applied to their book in sequence order.

    All books of a key are one value: a key costs one read and one write of state a
    trigger, however many books and levels it has. Rows without `instrument_id` and
    `segment` are of one book, named by the key.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.books = handle.getValueState("books", "books string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        updates: dict[tuple, list[tuple]] = {}
        for frame in rows:
            frame = frame.assign(**{c: v for c, v in (("instrument_id", key[0]), ("segment", 0)) if c not in frame})
            for instrument, segment, *update in frame[BOOK_UPDATES].itertuples(index=False, name=None):
                updates.setdefault((instrument, segment), []).append(update)
        (text,) = self.books.get() or ("[]",)
        books = {(instrument, segment): book for instrument, segment, *book in json.loads(text)}
        out = []
        for (instrument, segment), part in updates.items():
            last, valid, *levels = books.get((instrument, segment), (None, False, [], []))
            bids, asks = ({price: quantity for price, quantity in side} for side in levels)
            for last, valid, bid, ask in replay_book(sorted(part, key=lambda u: u[0]), bids, asks, last, valid):
                out.append((instrument, last, "valid" if valid else "invalid", bid, ask))
            books[instrument, segment] = last, valid, list(bids.items()), list(asks.items())
        self.books.update((json.dumps([(*of, *book) for of, book in books.items()]),))
        yield pd.DataFrame(out, columns=["instrument_id", "sequence", "status", "best_bid", "best_ask"])

    def close(self) -> None:
        pass


def stream_books(updates: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """Order books maintained over a stream with RocksDB-backed keyed state.

    A snapshot resets the book, so segments are independent. State is keyed by a
    shard of instruments and a block of segments, those that open within `block`
    sequences: calls to the state store cost far more than the rows, and number as
    the shards and blocks. A busy instrument spreads over its blocks, and a trigger
    reads and writes no other blocks than those of its rows. A checkpoint has to be
    read with the `shards` and `block` it was written with.
    """
    updates.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    shard = F.pmod(F.xxhash64("instrument_id"), F.lit(shards)).cast("int")
    keyed = updates.select(shard.alias("shard"), F.floor(F.col("segment") / block).alias("block"), *BOOK_UPDATES)
    return keyed.groupBy("shard", "block").transformWithStateInPandas(
        statefulProcessor=BookProcessor(), outputStructType=BOOK_TOPS, outputMode="Append", timeMode="None"
    )
