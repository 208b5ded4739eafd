"""The model: base scores by brute force, seating odds by enumeration, shares that add up, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidepanel.llm import hpylm


def plain_tokens(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (text or "").split()] + [None]


def plain_base(rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    count = Counter(t for d, text, *_ in rows if not held(d) for t in plain_tokens(text))
    space = sum(count.values()) + 0.1 * (len(count) + 1)
    out = []
    for d, text, *_ in rows:
        mine = plain_tokens(text)
        out.append((d, held(d), len(mine), sum(count[t] > 0 for t in mine), sum(count.values()), sum(math.log10((count[t] + 0.1) / space) for t in mine)))
    return out


def test_table_matches_brute_force_and_gains_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(hpylm.score(docs).collect())
    want = sorted(plain_base([(d.doc_id, d.text) for d in docs.collect()]))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert [r.base_score for r in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tables_follow_their_distribution():
    c, a, d = 5, 0.7, 0.4

    def weights(sizes, left):  # seats customers one by one
        if not left:
            yield len(sizes), 1.0
            return
        for t, w in weights([*sizes, 1], left - 1):
            yield t, w * a
        for i, s in enumerate(sizes):
            for t, w in weights([*sizes[:i], s + 1, *sizes[i + 1:]], left - 1):
                yield t, w * (s - d)

    exact = Counter()
    for t, w in weights([], c):
        exact[t] += w
    whole = sum(exact.values())
    seats, rng = hpylm.Seats(d), np.random.default_rng(1)
    drawn = Counter(seats.draw(np.full(200_000, c), np.full(200_000, a), rng).tolist())
    for t in range(1, c + 1):
        assert drawn[t] / 200_000 == pytest.approx(exact[t] / whole, abs=0.005)
    many = seats.draw(np.array([1, 64, 65, 100_000]), np.full(4, 2.0), rng)
    assert many[0] == 1 and (many >= 1).all() and many[3] > many[1] - 30


def small(spark):
    text = " ".join("a b c a b d e a b".split() * 40)
    rows = [(i, text) for i in range(1, 30)] + [(30, "q r s"), (31, "b never"), (32, "a q q"), (33, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_every_word_is_a_context_and_shares_add_up(spark):
    rows, docs = small(spark)
    counts, _ = hpylm.written(hpylm.pairs(docs), "pairs")
    model = hpylm.fit(counts)
    trained = [plain_tokens(t) for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    want = Counter(p for t in trained for p in zip([None, *t], t, strict=False))
    contexts, words = model.contexts.collect(), [w for w in model.words.collect() if w.c]
    assert sorted(c.customers for c in contexts) == sorted(Counter(p[0] for p in want.elements()).values())
    assert counts.where("n > 0").count() == len(want)
    lead = {(r.w, r.ctx): r.lead for r in model.blocks.collect()}
    assert len(model.roots) == hpylm.SWEEPS - hpylm.BURN
    for u in contexts:
        total = sum(lead.get((w.w, u.ctx), 0.0) for w in words) / (u.customers + hpylm.THETA)
        for i, root in enumerate(model.roots):
            share = sum((w[f"guests_{i}"] - root.d * w[f"tops_{i}"] + root.fresh) / (root.guests + hpylm.THETA) for w in words)
            assert share + root.fresh / (root.guests + hpylm.THETA) == pytest.approx(1)
            total += (hpylm.THETA + model.d * u[f"tables_{i}"]) / (u.customers + hpylm.THETA) / len(model.roots)
        assert total == pytest.approx(1)


@pytest.mark.parametrize("hot", [1, 20])
def test_scores_are_those_of_the_tables_wherever_a_pair_is_looked_up(spark, monkeypatch, hot):
    monkeypatch.setattr(hpylm, "HOT", hot)
    rows, docs = small(spark)
    counts, _ = hpylm.written(hpylm.pairs(docs), "pairs")
    model = hpylm.fit(counts)
    blocks = {(r.w, r.ctx): r.lead for r in model.blocks.collect()}
    contexts, words = {r.ctx: r for r in model.contexts.collect()}, {r.w: r for r in model.words.collect()}
    code = lambda t: int(np.uint64(hpylm._HASHES[t.encode()]).view(np.int64)) if t else int(hpylm.END.view(np.int64))

    def log10(w, ctx):
        u, x = contexts.get(ctx), words[w]
        guests = (u.customers if u else 0) + hpylm.THETA
        rest = [(hpylm.THETA + model.d * (u[f"tables_{i}"] if u else 0)) / guests * (x[f"guests_{i}"] - r.d * x[f"tops_{i}"] + r.fresh) / (r.guests + hpylm.THETA)
                for i, r in enumerate(model.roots)]
        return math.log10(blocks[w, ctx] / guests + sum(rest) / len(rest))

    want = {}
    for d, text in rows:
        ids = [code(t) for t in plain_tokens(text)]
        want[d] = sum(log10(w, ctx) for w, ctx in zip(ids, [code(None), *ids], strict=False))
    got = {r.doc_id: r.score for r in hpylm.score(docs).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_more_sweeps_move_held_out_scores_little(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts, _ = hpylm.written(hpylm.pairs(docs), "pairs")
    counts = counts.where("n < m OR n > 0")
    logs = []
    for turns, burn in ((hpylm.SWEEPS, hpylm.BURN), (10, 5)):
        row = hpylm.fit(counts, turns, burn).scored().join(counts.select("k", "n"), "k").selectExpr("sum((m - n) * score) AS s", "sum(m - n) AS t").first()
        logs.append(row.s / row.t)
    assert logs[0] == pytest.approx(logs[1], abs=0.01)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "A b b", 0), (1, "A b b", 0), (None, None, 0), (2, "", 0), (3, "zz " * 30000, 0), (19, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, w int")
    got = sorted(map(tuple, hpylm.score(docs).collect()), key=str)
    want = sorted(plain_base(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert hpylm.score(docs.limit(0)).collect() == []
    alone = hpylm.score(docs.where("doc_id IS NULL")).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.score) for r in alone] == [(True, 0, 0, 0.0)]


@pytest.mark.parametrize("d, a", [(0.5, 5), (0.8, 5), (0.5, 0.5), (0.8, 0.5), (0.3, 40)])
def test_large_blocks_follow_the_same_law(d, a):
    seats, rng, most = hpylm.Seats(d), np.random.default_rng(7), 5000
    row, t = np.full(most + 1, -np.inf), np.arange(most + 1)
    row[1] = 0.0
    for c in range(1, most + 1):
        if c in (65, 256, 1024, 1025, 5000):
            weight = np.exp((w := row + t * math.log(a)) - w.max())
            mean = (weight * t).sum() / weight.sum()
            spread = math.sqrt((weight * (t - mean) ** 2).sum() / weight.sum())
            drawn = seats.draw(np.full(20_000, c), np.full(20_000, float(a)), rng)
            assert drawn.mean() == pytest.approx(mean, rel=0.01, abs=4 * spread / math.sqrt(20_000)), c
            assert drawn.std() == pytest.approx(spread, rel=0.04), c
        with np.errstate(divide="ignore", invalid="ignore"):
            grown = np.logaddexp(row[:-1], row[1:] + np.log(np.maximum(c - d * t[1:], 1e-300)))
        row[1:] = np.where(t[1:] <= c + 1, grown, -np.inf)


@pytest.mark.parametrize("every", [1, 2, 100])
def test_single_pairs_of_broadcast_words_have_no_row(spark, every):
    _, docs = small(spark)
    counts = hpylm.pairs(docs).collect()
    hot = np.sort(np.array(list({r.w for r in counts}), np.int64))[::every]
    rows = hpylm.tallies(docs, hot).collect()
    broadcast = set(hot.tolist())
    want = {(r.w, r.ctx): (r.n, r.m) for r in counts if not {r.w, r.ctx} <= broadcast or r.n > 1 or r.m > r.n == 1}
    assert {(r.w, r.ctx): (r.n, r.m) for r in rows if r.kind != hpylm.WORD} == want and len(want) < len(counts) + every
    assert sum(r.kind == hpylm.BOTH for r in rows) == sum(set(p) <= broadcast for p in want)
    words = Counter()
    for r in counts:
        words[r.w] += r.n
    assert {r.w: r.n for r in rows if r.kind == hpylm.WORD} == words
