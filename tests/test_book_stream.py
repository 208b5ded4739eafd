"""Books of many instruments and segments under one key of state, and over several triggers."""

import pandas as pd

from tidepanel.catalog.q_streams import book_updates
from tidepanel.catalog.tables import Tables
from tidepanel.streaming import monitors

SMALL = "/root/testdata/sf0.001"


class CountedValue:
    """A value state, and its handle, that counts reads and writes."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_all_books_of_a_key_cost_one_read_and_one_write_a_trigger():
    books = [(None if n == 0 else f"i{n}", segment) for n in range(20) for segment in (1, 9)]
    rows = [
        (*of, of[1] + i, "snapshot" if i == 0 else "delta", "bid" if i % 3 else "ask", 10.0 * (i % 3 == 0) + i / 8, float(i % 4))
        for i in range(8) if i != 6 for of in books
    ]
    state, got = CountedValue(), []
    for part in (rows[:90][::-1], rows[90:200], rows[200:]):
        processor = monitors.BookProcessor()
        processor.init(state)
        frames = (pd.DataFrame(part[i:i + 40], columns=monitors.BOOK_UPDATES) for i in range(0, len(part), 40))
        got += [r for out in processor.handleInputRows((3, 0), frames, None) for r in out.itertuples(index=False, name=None)]
    assert state.calls == 6
    plain = lambda rows: sorted((str(i), s, v, 0 if b != b else b or 0, 0 if a != a else a or 0) for i, s, v, b, a in rows)
    want = []
    for of in books:
        part = [r[2:] for r in rows if r[:2] == of]
        want += [(of[0], s, "valid" if v else "invalid", b, a) for s, v, b, a in monitors.replay_book(iter(part), {}, {}, None, False)]
    assert plain(got) == plain(want)
    assert {r[2] for r in want} == {"valid", "invalid"}


def test_books_go_on_over_triggers_and_the_store_has_a_row_for_each_shard_and_block(spark):
    updates = book_updates(Tables(spark, SMALL))
    schema = updates.schema
    rows = updates.collect()
    batch = sorted((r.instrument_id, r.sequence, r.status, r.best_bid or 0, r.best_ask or 0) for r in monitors.reconstruct_books(updates).collect())
    cut = sorted(r.sequence for r in rows)[len(rows) // 2]
    path, _ = monitors.landing(spark, spark.createDataFrame([r for r in rows if r.sequence <= cut], schema).coalesce(1), "books-halves")
    spark.createDataFrame([r for r in rows if r.sequence > cut], schema).coalesce(1).write.mode("append").parquet(path)
    stream = monitors.stream_books(monitors.read_landing(spark, path, schema, files_per_trigger=1), shards=2, block=64)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    query = query.format("parquet").option("path", f"{path}-out").start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{path}-out").collect()
    assert sorted((r.instrument_id, r.sequence, r.status, r.best_bid or 0, r.best_ask or 0) for r in out) == batch
    triggers = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(triggers) == 2
    blocks = {r.segment // 64 for r in rows}
    assert triggers[-1]["stateOperators"][0]["numRowsTotal"] <= 2 * len(blocks) < len({(r.instrument_id, r.segment) for r in rows})
