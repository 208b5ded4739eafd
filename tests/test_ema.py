"""The moving average against the plain recursion, across chunks, contracts and column names."""

import math

import pytest

from tidepanel.operators import windows


def test_recursion_over_many_chunks(spark):
    sizes = {"a": 1, "b": 128, "c": 129, "d": 700}
    rows = [(k, i * 10, 100.0 + 40 * math.sin(i * 0.7) + (1e6 if i == 300 else 0), "x") for k, n in sizes.items() for i in range(n)]
    bars = spark.createDataFrame(rows[::-1], "contract_id string, close_time_ns long, close double, extra string")
    spans = (1, 2, 12, 26)
    got = windows.ema(bars, spans)
    assert got.columns == [*bars.columns, *(f"ema_{w}" for w in spans)]
    found = {(r.contract_id, r.close_time_ns): r for r in got.collect()}
    assert len(found) == len(rows)
    for w in spans:
        before = {}
        for k, t, x, _ in rows:
            a = 2 / (w + 1)
            before[k] = a * x + (1 - a) * before.get(k, x)
            assert found[k, t][f"ema_{w}"] == pytest.approx(before[k], rel=1e-12), (w, k, t)


def test_empty(spark):
    assert windows.ema(spark.createDataFrame([], "contract_id string, close_time_ns long, close double"), (3,)).collect() == []
