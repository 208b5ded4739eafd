"""Top-k against brute force."""

import math
import random

from tidepanel.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in good:
        if i % 100 == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, a in asks.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def ask(spark, rows, k=10, parts=3):
    vectors = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int").repartition(parts))
    return sorted(tuple(r) for r in topk.search(vectors, vectors.where("vec_id % 100 = 0"), k).collect())


def test_random_vectors_with_ties_and_copies(spark):
    draw = random.Random(1)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(6)], 0) for i in range(400)]
    rows += [(400 + i, rows[7][1], 0) for i in range(40)] + [(900, rows[7][1], 0), (900, rows[3][1], 0), (5, rows[5][1], 0)]
    assert ask(spark, rows) == brute(rows, 10)
    assert ask(spark, rows, k=3, parts=40) == brute(rows, 3)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 4 * 4)
    draw = random.Random(2)
    rows = [(100 * i, [draw.uniform(-1, 1) for _ in range(4)], 0) for i in range(15)] + [(i, [draw.uniform(-1, 1) for _ in range(4)], 0) for i in range(1, 50)]
    assert ask(spark, rows) == brute(rows, 10)


def test_nulls_dimensions_and_few_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (5, [3.0], 0),
            (6, [-1.0, 0.5], 0), (-100, [0.25, 0.25], 0), (200, [1.0], 0), (300, [], 0), (7, [1e9, 1e9], 0), (8, [-1e9, 1e8], 0)]
    assert ask(spark, rows) == brute(rows, 10)
    assert ask(spark, []) == [] and ask(spark, [(1, [1.0], 0)]) == []


def test_scores_up_to_the_long_range(spark):
    import pytest

    draw = random.Random(3)
    wide = [float(1 << 20), -float(1 << 20), float(3 << 19), 1.0, -0.5, float(1 << 10)]
    rows = [(i, [draw.choice(wide) for _ in range(4)], 0) for i in range(300)] + [(400, [float(1 << 20)] * 4, 0), (301, [float(1 << 20)] * 4, 0)]
    assert max(abs(s) for *_, s in brute(rows, 10)) >= 1 << 62
    assert ask(spark, rows) == brute(rows, 10)
    assert ask(spark, [(0, [float(1 << 20)], 0), (1, [float(1 << 20)], 0)]) == [(0, 1, 1, 1 << 60)]
    with pytest.raises(Exception, match="range of a long"):
        ask(spark, [(0, [1e9] * 4, 0), (1, [1e9] * 4, 0)])
