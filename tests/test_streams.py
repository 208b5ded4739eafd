"""The batch replay and the stateful stream must tell the same story."""

import pandas as pd

from tidepanel.catalog.registry import QUERIES
from tidepanel.streaming import monitors
import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def test_stream_and_batch_books_agree(spark):
    __spark_entry__.queries()
    batch = QUERIES["k03_order_book_reconstruction"](spark, SMALL)
    stream = QUERIES["k03b_order_book_stream"](spark, SMALL)
    rows = lambda df: sorted((r.instrument_id, r.sequence, r.status, r.best_bid or 0, r.best_ask or 0) for r in df.collect())
    got = rows(batch)
    assert got == rows(stream) and {s for _, _, s, _, _ in got} == {"valid", "invalid"}


class CountedValue:
    """A value state that counts what is asked of it; a handle that has no other kind."""

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


def test_a_key_costs_one_read_and_one_write_a_trigger():
    updates = [(s, "snapshot" if s == 1 else "delta", "bid" if s % 3 else "ask", 10.0 * (s % 3 == 0) + s / 8, float(s % 7)) for s in (*range(1, 30), 31, 32)]
    state, got = CountedValue(), []
    for part in (updates[:9][::-1], updates[9:20], updates[20:]):
        book = monitors.BookProcessor()
        book.init(state)
        frame = pd.DataFrame(part, columns=["sequence", "kind", "side", "price", "quantity"])
        got += [r for out in book.handleInputRows(("A",), iter([frame]), None) for r in out.itertuples(index=False, name=None)]
    assert state.calls == 6
    want = [(s, "valid" if v else "invalid", b or 0, a or 0) for s, v, b, a in monitors.replay_book(iter(updates), {}, {}, None, False)]
    assert [(s, v, 0 if b != b else b or 0, 0 if a != a else a or 0) for _, s, v, b, a in got] == want
    assert {v for _, v, _, _ in want} == {"valid", "invalid"}
