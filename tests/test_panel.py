"""Windows, accounting and books on hand-computed rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.timefns import DAY_NS, WEEK_NS
from tidepanel.operators import accounting, microstructure, models, vectors, windows
from tidepanel.streaming.monitors import replay_book


def bars(spark, closes, contract="A"):
    rows = [(contract, d * DAY_NS, (d + 1) * DAY_NS, float(c)) for d, c in closes.items()]
    return spark.createDataFrame(rows, "contract_id string, open_time_ns bigint, close_time_ns bigint, close double")


def test_a_hole_empties_the_window(spark):
    closes = {d: 100 + d % 4 for d in range(20) if d != 9}
    out = {r.close_time_ns // DAY_NS - 1: r for r in windows.annualised_volatility(bars(spark, closes), 4).collect()}
    assert out[8].volatility is not None and out[10].volatility is None and out[13].volatility is None
    logs = np.diff(np.log([closes[d] for d in range(10, 15)]))
    assert out[14].volatility == pytest.approx(np.std(logs, ddof=1) * np.sqrt(365))


def test_later_bars_change_nothing(spark):
    closes = {d: 100 + (d * 7) % 11 for d in range(30)}
    score = lambda c: {
        r.close_time_ns: r.score for r in windows.trend_score(
            bars(spark, c), spec=windows.IndicatorWindows((2, 3, 5), ((2, 3), (3, 5)), (2, 3, 5), (1, 3, 6), (3, 6))
        ).collect()
    }
    full, cut = score(closes), score({d: c for d, c in closes.items() if d < 20})
    assert all(full[k] == v for k, v in cut.items()) and any(v is not None for v in cut.values())


def test_twelve_votes():
    assert len(windows.IndicatorWindows().names) == 12 and windows.IndicatorWindows().span_days == 121


def test_two_contract_episode(spark):
    weights = spark.createDataFrame(
        [("m", 0, "A", 0.5), ("m", 0, "B", -0.5), ("m", WEEK_NS, "A", 1.0)],
        "member string, decision_ns bigint, contract_id string, weight double",
    )
    prices = spark.createDataFrame(
        [("A", 0, 100.0, 110.0, 105.0), ("B", 0, 100.0, None, 95.0), ("A", WEEK_NS, 110.0, 110.0, 110.0)],
        "contract_id string, decision_ns bigint, entry_close double, exit_close double, last_inside double",
    )
    calendar = spark.createDataFrame([(0, 1, False), (WEEK_NS, 2, False)], "decision_ns bigint, ordinal bigint, skipped boolean")
    cost = accounting.CostTable("base", 10.0, 5.0, 10.0)
    lines = accounting.evaluate_book(weights, prices, calendar, [cost])
    first, second = accounting.episodes(lines, ["member"]).orderBy("decision_ns").collect()
    assert first.gross_return == pytest.approx(0.05 + 0.025) and first.turnover == 1.0
    assert first.turnover_cost == pytest.approx(0.002) and first.forced_close_cost == pytest.approx(0.001)
    drift = 0.5 * 1.1 / 1.075
    assert second.turnover == pytest.approx(1.0 - drift)
    assert first.net_return == pytest.approx(0.075 - 0.002 - 0.001)


def test_books_fill_the_last_level_partly_and_name_their_defect(spark):
    columns = "book_id long, instrument_id string, market string, tier int, received_time_ns long, side string, level int, price double, quantity double"
    book = lambda i, bids, asks: [
        (i, "a", "perp", 1, 0, side, n + 1, p, 1.0) for side, prices in (("bid", bids), ("ask", asks)) for n, p in enumerate(prices)]
    rows = [*book(1, [99.0, 98.0], [100.0, 110.0]), *book(2, [98.0, 99.0], [100.0]), *book(3, [101.0], [100.0]), *book(4, [], [100.0]),
            *book(5, [99.0], [100.0, 0.0])]
    levels = spark.createDataFrame(rows, columns)
    fills = {r.notional: r.vwap for r in microstructure.fill_prices(levels, (100.0, 155.0, 500.0)).filter("book_id = 1 AND side = 'ask'").collect()}
    assert fills[100.0] == 100.0 and fills[155.0] == pytest.approx(155 / 1.5) and 500.0 not in fills
    reasons = {r.book_id: r.reason for r in microstructure.validate_books(levels).collect()}
    assert reasons == {1: None, 2: "BIDS_UNSORTED", 3: "BOOK_CROSSED", 4: "BOOK_EMPTY", 5: "ASKS_NOT_POSITIVE"}
    seen = {r.notional: r.slippage_bps for r in microstructure.depth_observations(levels, (100.0, 500.0)).collect()}
    assert set(seen) == {100.0, 500.0} and seen[500.0] is None and seen[100.0] > 0


def test_book_needs_a_snapshot_after_a_gap():
    updates = [
        (1, "snapshot", "bid", 10.0, 1.0), (2, "delta", "ask", 11.0, 1.0), (4, "delta", "bid", 10.5, 1.0),
        (5, "delta", "bid", 10.5, 1.0), (6, "snapshot", "ask", 12.0, 1.0), (7, "delta", "bid", 12.0, 1.0),
    ]
    states = list(replay_book(updates, {}, {}, None, False))
    assert [v for _, v, _, _ in states] == [True, True, False, False, True, False]
    assert states[1][2:] == (10.0, 11.0)


def test_sign_flip_removes_every_vector(spark):
    calendar = spark.createDataFrame(
        [(0, k * WEEK_NS, False, False, 0) for k in range(1, 5)],
        "fold_index bigint, decision_ns bigint, skipped boolean, is_warm_up boolean, era int",
    )
    formed = spark.createDataFrame(
        [(0, "m", "A", k * WEEK_NS, 0.5) for k in (1, 2, 4)],
        "fold_index bigint, member string, contract_id string, formed_ns bigint, weight double",
    )
    paid = spark.createDataFrame(
        [("A", 1 * WEEK_NS, -0.1), ("A", 2 * WEEK_NS, -0.1), ("A", 3 * WEEK_NS, 0.1), ("A", 4 * WEEK_NS, -0.1)],
        "contract_id string, decision_ns bigint, trailing_1w double",
    )
    got = {r.decision_ns // WEEK_NS: r.weight for r in vectors.sign_flip_book(formed, calendar, paid, {"m": 4}).collect()}
    assert got == {1: 0.125, 2: 0.25, 4: 0.125}


def test_ridge_matches_the_normal_equations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    y = x @ np.array([0.3, -0.2, 0.1, 0.0]) + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], [*models.FEATURES, "forward_return"])
    fit = models.fit_ridge(df, alpha=2.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 2.0 * np.eye(4), z.T @ (y - y.mean()))
    assert np.allclose(fit.coefficients, want) and fit.intercept == pytest.approx(y.mean())


def test_logistic_and_stumps_match_plain_loops(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 4)).round(2)
    y = x[:, 0] * 0.5 + rng.normal(size=150) * 0.2
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], [*models.FEATURES, "forward_return"])
    z, label = (x - x.mean(0)) / x.std(0), (y > 0).astype(float)
    beta, bias = np.zeros(4), 0.0
    for _ in range(4):
        error = 1 / (1 + np.exp(-(z @ beta + bias))) - label
        bias, beta = bias - 0.5 * error.mean(), beta - 0.5 * ((error[:, None] * z).mean(0) + 0.01 * beta)
    fit = models.fit_logistic(df, l2=0.01, iterations=4, rate=0.5)
    assert np.allclose(fit.coefficients, beta) and fit.intercept == pytest.approx(bias)

    base, stumps = models.fit_stumps(df, rounds=1, rate=0.1, minimum_leaf=10, limit=8)
    best = None
    for j, name in enumerate(models.FEATURES):
        v = np.sort(x[:, j])
        mids = [(v[i] + v[i + 1]) / 2 for i in range(9, 140) if v[i] < v[i + 1]]
        mids = [mids[i * (len(mids) - 1) // 7] for i in range(8)] if len(mids) > 8 else mids
        for cut in mids:
            left, right = (y - y.mean())[x[:, j] <= cut], (y - y.mean())[x[:, j] > cut]
            gain = left.sum() ** 2 / len(left) + right.sum() ** 2 / len(right)
            if best is None or gain > best[0]:
                best = (gain, name, cut)
    assert base == pytest.approx(y.mean()) and (stumps[0].feature, stumps[0].threshold) == (best[1], pytest.approx(best[2]))
