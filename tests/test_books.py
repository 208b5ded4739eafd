"""Sequential books against a plain state machine."""

import random
from statistics import NormalDist

import numpy as np
import pytest

from tidepanel.catalog.tables import Tables
from tidepanel.functions.timefns import WEEK_NS
from tidepanel.operators import carry, stats


def machine(weeks, ranked, facts, slots, hold, exits):
    held, out = {}, []
    for w, skipped in weeks:
        if skipped:
            held = {}
            continue
        for p in list(held):
            fact = facts.get((w, p))
            if w - held[p] >= hold or fact is None or (exits and not fact[1]):
                del held[p]
        for p in ranked.get(w, []):
            paying = facts.get((w, p), (None, False))[1]
            if len(held) < slots and p not in held and (paying or not exits):
                held[p] = w
        out += [(w, p) for p in held]
        held = {p: f for p, f in held.items() if not facts.get((w, p), (False,))[0]}
    return sorted(out)


@pytest.mark.parametrize("exits", [False, True])
def test_slot_book_matches_the_state_machine(spark, exits):
    rng = random.Random(11)
    weeks = [(w, rng.random() < 0.1) for w in range(1, 25)]
    pairs = "ABCDE"
    facts = {(w, p): (rng.random() < 0.1, rng.random() < 0.7) for w, _ in weeks for p in pairs if rng.random() < 0.9}
    ranked = {w: rng.sample([p for p in pairs if (w, p) in facts], k=min(3, sum((w, p) in facts for p in pairs))) for w, _ in weeks}
    calendar = spark.createDataFrame(
        [(0, w * WEEK_NS, s, False) for w, s in weeks], "fold_index bigint, decision_ns bigint, skipped boolean, is_warm_up boolean"
    )
    offers = spark.createDataFrame(
        [(0, "m", w * WEEK_NS, p, i) for w, ps in ranked.items() for i, p in enumerate(ps)],
        "fold_index bigint, member string, decision_ns bigint, pair_id string, rank int",
    )
    known = spark.createDataFrame(
        [(w * WEEK_NS, p, *v) for (w, p), v in facts.items()],
        "decision_ns bigint, pair_id string, closes_forced boolean, paid_last_week boolean",
    )
    got = carry.slot_book(offers, calendar, known, slots=2, hold_weeks=4, exit_on_negative=exits).collect()
    want = machine(weeks, ranked, facts, 2, 4, exits)
    assert sorted((r.decision_ns // WEEK_NS, r.pair_id) for r in got) == want


def test_deflated_sharpe(spark):
    rng = np.random.default_rng(8)
    series = {f"m{i}": rng.normal(0.01 * i, 0.05, 60) for i in range(3)}
    df = spark.createDataFrame(
        [("f", m, float(v)) for m, vs in series.items() for v in vs], "family string, member string, net_return double"
    )
    got = {r.member: r.deflated_sharpe for r in stats.deflated_sharpe(df, ["family"], "member").collect()}
    sharpes = {m: v.mean() / v.std(ddof=1) for m, v in series.items()}
    normal, n, gamma = NormalDist(), 3, stats.EULER_MASCHERONI
    top = np.std(list(sharpes.values()), ddof=1) * (
        (1 - gamma) * normal.inv_cdf(1 - 1 / n) + gamma * normal.inv_cdf(1 - 1 / (n * np.e))
    )
    for m, v in series.items():
        z = (v - v.mean()) / v.std()
        s = sharpes[m]
        scale = 1 - (z**3).mean() * s + ((z**4).mean() - 1) / 4 * s * s
        assert got[m] == pytest.approx(normal.cdf((s - top) * np.sqrt(len(v) - 1) / np.sqrt(scale)))


def test_books_are_dealt_by_the_rows_of_the_table(spark, monkeypatch):
    """A task's share of the levels must not grow with the table."""
    tables = Tables(spark, "/root/testdata/sf0.01")
    assert tables.pieces("lineitem", 1_000) == -(-tables.read("lineitem").count() // 1_000)
    assert tables.pieces("region") == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(Tables, "pieces", lambda self, name: 23)
    assert tables.book_levels.rdd.getNumPartitions() == 23
