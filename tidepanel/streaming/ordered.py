"""Streams whose records must be taken in order, with state that outlives a micro-batch.

State holds one entry per key in RocksDB: a cursor, a bounded book, and the records
that wait for the watermark. A restart from the checkpoint goes on where it was.

Keys are dealt over shards by their hash, and a shard's entries are read and written
together: calls to the state store and timers cost far more than the rows, and
number as the shards, not as the keys. A checkpoint has to be read with the number
of shards it was written with.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SNAPSHOT_EVERY = 5
FIRST_LINK = "0" * 64
SHARDS = 64


def keyed(stream: DataFrame, key: str, shards: int, processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    return stream.withColumn("shard", shard).groupBy("shard").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode
    )


# Order books

BOOK_TOPS = "instrument_id string, sequence bigint, status string, best_bid double, best_ask double"


class Book:
    """A book that is valid from a snapshot on, until a gap or a cross."""

    def __init__(self, text: str | None = None) -> None:
        state = json.loads(text) if text else {"last": None, "bids": [], "asks": []}
        self.last: int | None = state["last"]
        self.bids, self.asks = ({p: q for p, q in state[side]} for side in ("bids", "asks"))

    def dump(self) -> str:
        return json.dumps({"last": self.last, "bids": list(self.bids.items()), "asks": list(self.asks.items())})

    def apply(self, action: str, sequence: int, previous: int | None, bids: list, asks: list) -> tuple[str, float | None, float | None]:
        """Status and best prices after a message; an invalid book is empty and keeps no sequence."""
        if action == "snapshot":
            self.bids, self.asks = {}, {}
        elif self.last is None or previous != self.last:
            return self._invalid()
        for book, levels in ((self.bids, bids), (self.asks, asks)):
            for price, quantity in levels:
                if quantity > 0:
                    book[price] = quantity
                else:
                    book.pop(price, None)
        if self.bids and self.asks and max(self.bids) >= min(self.asks):
            return self._invalid()
        self.last = sequence
        return "valid", max(self.bids, default=None), min(self.asks, default=None)

    def _invalid(self) -> tuple[str, None, None]:
        self.last, self.bids, self.asks = None, {}, {}
        return "invalid", None, None


class OrderedBooks(StatefulProcessor):
    """Books in event time: a message waits until the watermark has passed it and is then applied in sequence.

    One timer per shard stands at its earliest waiting message. A message that comes
    after its successors were applied is told as `late` and changes nothing. What waits
    is one text a trigger: a row of state for each message would cost more than its book.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "messages string")
        self.books = handle.getListState("books", "instrument_id string, applied bigint, book string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        applied = {instrument: sequence for instrument, sequence, _ in self.books.get()}
        late, fresh = [], []
        for frame in rows:
            for r in frame[["instrument_id", "event_ms", "sequence", "message"]].itertuples(index=False, name=None):
                if r[2] <= applied.get(r[0], -1):
                    late.append((r[0], r[2], "late", None, None))
                else:
                    fresh.append(r)
        if fresh:
            self.waiting.appendValue((json.dumps(fresh),))
            self._arm(min(f[1] for f in fresh))
        yield pd.DataFrame(late, columns=["instrument_id", "sequence", "status", "best_bid", "best_ask"])

    def _arm(self, at: int) -> None:
        armed = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        if not armed or at < min(armed):
            for t in armed:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        due, rest = {}, []
        for (text,) in self.waiting.get():
            for w in json.loads(text):
                if w[1] <= mark:
                    due.setdefault(w[0], []).append(w)
                else:
                    rest.append(w)
        state = {instrument: (applied, text) for instrument, applied, text in self.books.get()}
        out = []
        for instrument, messages in due.items():
            applied, text = state.get(instrument, (-1, None))
            book = Book(text)
            for _, _, sequence, message in sorted(messages, key=lambda w: w[2]):
                if sequence <= applied:  # a second copy of a message that has been applied
                    out.append((instrument, sequence, "late", None, None))
                    continue
                m = json.loads(message)
                sides = ([(float(x["price"]), float(x["quantity"])) for x in m[side]] for side in ("bids", "asks"))
                out.append((instrument, sequence, *book.apply(m["action"], sequence, m.get("previous_sequence"), *sides)))
                applied = sequence
            state[instrument] = applied, book.dump()
        self.books.put([(instrument, *entry) for instrument, entry in state.items()])
        if rest:
            self.waiting.put([(json.dumps(rest),)])
            self.handle.registerTimer(min(w[1] for w in rest))
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["instrument_id", "sequence", "status", "best_bid", "best_ask"])

    def close(self) -> None:
        pass


def ordered_books(messages: DataFrame, delay: str, shards: int = SHARDS) -> DataFrame:
    """Book state after every message of a stream whose files may come up to `delay` out of order.

    `messages` has instrument_id, event_time, action, sequence, previous_sequence,
    and bids and asks as arrays of (price, quantity). What the watermark has not
    passed yet waits in state; a heartbeat of any other instrument moves it on.
    """
    text = F.to_json(F.struct("action", "previous_sequence", "bids", "asks"))
    rows = messages.withWatermark("event_time", delay).select(
        "instrument_id", "event_time", F.unix_millis("event_time").alias("event_ms"), "sequence", text.alias("message"))
    return keyed(rows, "instrument_id", shards, OrderedBooks(), BOOK_TOPS, "EventTime")


def replayed_books(messages: DataFrame) -> DataFrame:
    """The same over a table. Expects ``segment``, the sequence of the latest snapshot at or before the row.

    A snapshot resets everything before it, so segments are independent and a busy
    instrument spreads over them; each task streams through its rows in order.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, book = None, Book()
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                if (r.instrument_id, r.segment) != current:
                    current, book = (r.instrument_id, r.segment), Book()
                levels = [[(x["price"], x["quantity"]) for x in side] for side in (r.bids, r.asks)]
                previous = None if pd.isna(r.previous_sequence) else int(r.previous_sequence)
                out.append((r.instrument_id, r.sequence, *book.apply(r.action, int(r.sequence), previous, *levels)))
            yield pd.DataFrame(out, columns=["instrument_id", "sequence", "status", "best_bid", "best_ask"])

    placed = messages.repartition("instrument_id", "segment").sortWithinPartitions("instrument_id", "segment", "sequence")
    return placed.mapInPandas(run, BOOK_TOPS)


# Chained records

# Chains are text: next to a null, pandas would make numbers of them that lose digits.
CHAINED = ("chain_id string, sequence bigint, event_id bigint, kind string, payload string, snapshot string, previous_hash string, "
           "content_hash string")


def record_hash(chain: int | str | None, sequence: int, kind: str, payload: str, snapshot: str | None, previous: str) -> str:
    return hashlib.sha256("|".join((str(chain), str(sequence), kind, payload, snapshot or "", previous)).encode()).hexdigest()


class Chain(StatefulProcessor):
    """Appends the records of a key to its chain: each names its predecessor's hash, and every fifth holds a full snapshot.

    State is the head of each chain and the latest payload of each kind.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getListState("heads", "chain_id string, sequence bigint, hash string, latest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("event_id")
        heads = {chain: (sequence, link, json.loads(latest)) for chain, sequence, link, latest in self.heads.get()}
        out = []
        for chain, event, kind, payload in frame[["chain_id", "event_id", "kind", "payload"]].itertuples(index=False, name=None):
            sequence, link, latest = heads.get(chain) or (0, FIRST_LINK, {})
            sequence += 1
            latest[kind] = payload
            snapshot = ",".join(f"{k}={v}" for k, v in sorted(latest.items())) if sequence % SNAPSHOT_EVERY == 0 else None
            content = record_hash(chain, sequence, kind, payload, snapshot, link)
            out.append((chain, sequence, event, kind, payload, snapshot, link, content))
            heads[chain] = sequence, content, latest
        self.heads.put([(chain, sequence, link, json.dumps(latest)) for chain, (sequence, link, latest) in heads.items()])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHAINED.split(", ")])

    def close(self) -> None:
        pass


def chained(stream: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Records (chain_id, event_id, kind, payload) as they are appended to their chains, in the order of event_id within a micro-batch."""
    rows = stream.select(F.col("chain_id").cast("string").alias("chain_id"), "event_id", "kind", "payload")
    return keyed(rows, "chain_id", shards, Chain(), CHAINED).withColumn("chain_id", F.col("chain_id").cast("bigint"))


# Contiguity

CHECKED = "chain_id string, event_id bigint, sequence bigint, reason string"


class Contiguity(StatefulProcessor):
    """Compares each record with its predecessor on arrival, over micro-batches.

    `late`: at or before the newest sequence, which changes nothing else;
    `broken_run`: does not follow it; `clock_step`: received before it;
    `misplaced`: filed under another day than it was received on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", "chain_id string, sequence bigint, received_ns bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("arrival")
        newest = {chain: (sequence, received) for chain, sequence, received in self.newest.get()}
        out = []
        for r in frame.itertuples(index=False):
            tell = lambda reason, r=r: out.append((r.chain_id, r.event_id, r.sequence, reason))
            sequence, received = newest.get(r.chain_id) or (None, None)
            if r.day != r.received_day:
                tell("misplaced")
            if sequence is not None and r.sequence <= sequence:
                tell("late")
                continue
            if sequence is not None and r.sequence != sequence + 1:
                tell("broken_run")
            if received is not None and r.received_ns < received:
                tell("clock_step")
            newest[r.chain_id] = int(r.sequence), int(r.received_ns)
        self.newest.put([(chain, *entry) for chain, entry in newest.items()])
        yield pd.DataFrame(out, columns=["chain_id", "event_id", "sequence", "reason"])

    def close(self) -> None:
        pass


def discontinuities(stream: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every reason a record of (chain_id, event_id, arrival, sequence, received_ns, received_day, day) gives, by record."""
    rows = stream.withColumn("chain_id", F.col("chain_id").cast("string"))
    return keyed(rows, "chain_id", shards, Contiguity(), CHECKED).withColumn("chain_id", F.col("chain_id").cast("bigint"))
