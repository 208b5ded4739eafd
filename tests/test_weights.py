"""Closed forms against the loops they replace."""

import random

from pyspark.sql import functions as F

from tidepanel.operators import pooling, stats, weights


def naive_fill(values, cap):
    """Clip, freeze and rescale until nothing is over the cap."""
    current, frozen = dict(values), set()
    while True:
        over = [k for k, v in current.items() if k not in frozen and abs(v) > cap]
        if not over:
            return current
        frozen.update(over)
        if len(frozen) * cap >= 1:
            return {k: (1 if v >= 0 else -1) / len(current) for k, v in current.items()}
        rest = sum(abs(v) for k, v in current.items() if k not in frozen)
        scale = (1 - len(frozen) * cap) / rest
        current = {
            k: (cap if v >= 0 else -cap) if k in frozen else v * scale for k, v in current.items()
        }


def test_water_fill_matches_the_loop(spark):
    rng = random.Random(3)
    books = {}
    for d in range(120):
        n = rng.randrange(1, 11)
        raw = {f"c{i}": rng.choice([-1, 1]) * rng.random() ** 4 for i in range(n)}
        gross = sum(abs(v) for v in raw.values())
        books[d] = {k: v / gross for k, v in raw.items()}
    rows = [(d, "m", k, v) for d, book in books.items() for k, v in book.items()]
    df = spark.createDataFrame(rows, "decision_ns bigint, member string, contract_id string, weight double")
    n = F.count("*").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("decision_ns"))
    got = {(r.decision_ns, r.contract_id): r.weight for r in weights.water_fill(df, 2.0 / n).collect()}
    for d, book in books.items():
        for k, v in naive_fill(book, 2 / len(book)).items():
            assert abs(got[(d, k)] - v) < 1e-9


def test_quintiles_take_both_ends_and_need_two_legs(spark):
    df = spark.createDataFrame(
        [(1, "m", c, float(i)) for i, c in enumerate("abcdefghij")] + [(2, "m", "a", 1.0)],
        "decision_ns bigint, member string, contract_id string, score double",
    )
    got = {(r.decision_ns, r.contract_id): r.weight for r in weights.quintile_weights(df, weights.WeightRules()).collect()}
    assert got == {(1, "a"): -0.25, (1, "b"): -0.25, (1, "i"): 0.25, (1, "j"): 0.25}


def test_benjamini_hochberg(spark):
    p = {"a": 0.01, "b": 0.04, "c": 0.03, "d": 0.5}
    df = spark.createDataFrame([("f", k, v) for k, v in p.items()], "family string, name string, p_value double")
    got = {r.name: r.q_value for r in stats.benjamini_hochberg(df, ["family"], "name").collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {"a": 0.04, "c": round(0.16 / 3, 9), "b": round(0.16 / 3, 9), "d": 0.5}


def test_held_nothing_rolls_forward_then_back(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for fold in range(40):
        pending, kept = 0.0, []
        for ordinal in range(1, rng.randrange(2, 9)):
            held, value = rng.random() < 0.4, float(rng.randrange(-50, 50))
            rows.append(("m", "base", fold, ordinal, ordinal, held, value, 1.0, 1.0, 0.0))
            if held:
                pending += value
            else:
                kept.append(value + pending)
                pending = 0.0
        if kept:
            kept[-1] += pending
        want[fold] = kept
    df = spark.createDataFrame(
        rows, "member string, scenario string, fold_index bigint, ordinal bigint, decision_ns bigint, held_nothing boolean, "
        "net_return double, turnover double, gross_exposure double, net_exposure double",
    )
    got = pooling.pool_episodes(df).orderBy("fold_index", "decision_ns").collect()
    for fold, values in want.items():
        assert [r.net_return for r in got if r.fold_index == fold] == values


def test_bootstrap_means_read_circular_blocks(spark):
    import hashlib

    values = [float(v) for v in (3, -1, 4, 1, -5, 9, 2)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, t bigint, net_return double")
    got = {r.repetition: r["mean"] for r in stats.bootstrap_means(df, ["s"], "t", block=3, repetitions=20, seed=4).collect()}
    for rep in range(20):
        sample = []
        for block in range(3):
            start = int(hashlib.md5(f"4:{rep}:{block}".encode()).hexdigest()[:12], 16) % 7
            sample += [values[(start + o) % 7] for o in range(3)]
        assert abs(got[rep] - sum(sample[:7]) / 7) < 1e-12
