"""SQL building blocks of the panel queries: universe, weights, episodes."""

from __future__ import annotations

from tidepanel.catalog import settings as S
from tidepanel.catalog.sqlviews import DAY, WEEK


def universe(bars: str = "bars_type", rules=S.UNIVERSE) -> dict[str, str]:
    reach = (rules.liquidity_window_days - 1) * DAY
    return {
        "screened": f"""
    SELECT close_time_ns AS decision_ns, contract_id, instrument_id, med AS median_quote_volume FROM (
      SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY close_time_ns) AS history,
        count(*) OVER w AS present, median(quote_volume) OVER w AS med
      FROM {bars} WINDOW w AS (PARTITION BY contract_id ORDER BY close_time_ns
        RANGE BETWEEN {reach} PRECEDING AND CURRENT ROW))
    WHERE day % 7 = 3 AND history >= {rules.minimum_history_days}
      AND present = {rules.liquidity_window_days} AND med >= {rules.minimum_median_quote_volume}""",
        "universe": f"""
    SELECT decision_ns, contract_id, instrument_id, median_quote_volume, liquidity_rank,
      CASE WHEN liquidity_rank <= {rules.tier_one_rank_limit} THEN 1 ELSE 2 END AS tier FROM (
      SELECT *, row_number() OVER (PARTITION BY decision_ns ORDER BY median_quote_volume DESC, contract_id)
          AS liquidity_rank, count(*) OVER (PARTITION BY decision_ns) AS eligible FROM screened)
    WHERE eligible >= {rules.minimum_contracts} AND liquidity_rank <= {rules.maximum_contracts}""",
    }


def trailing(days: int, bars: str = "bars_type") -> str:
    return f"""
    SELECT b.contract_id, b.close_time_ns, CASE WHEN p.close > 0 THEN b.close / p.close - 1 END AS ret
    FROM {bars} b LEFT JOIN {bars} p ON p.contract_id = b.contract_id
      AND p.close_time_ns = b.close_time_ns - {days * DAY}"""


def volatility(window: int, bars: str = "bars_type") -> dict[str, str]:
    return {
        "log_returns": f"""
    SELECT b.contract_id, b.close_time_ns, ln(b.close / p.close) AS lr
    FROM {bars} b LEFT JOIN {bars} p ON p.contract_id = b.contract_id
      AND p.close_time_ns = b.close_time_ns - {DAY} AND p.close > 0 AND b.close > 0""",
        "volatility": f"""
    SELECT contract_id, close_time_ns, CASE WHEN count(lr) OVER w = {window}
      THEN stddev_samp(lr) OVER w * sqrt(365) END AS sigma
    FROM log_returns WINDOW w AS (PARTITION BY contract_id ORDER BY close_time_ns
      RANGE BETWEEN {(window - 1) * DAY} PRECEDING AND CURRENT ROW)""",
    }


def quintile(source: str, *, reverse: str = "false", rules=S.WEIGHTS, group: str = "decision_ns, member") -> str:
    """`source` has group columns, contract_id, score."""
    leg = f"{rules.leg_gross} / q"
    return f"""
    SELECT {group}, contract_id, CASE WHEN rk <= q THEN -{leg} ELSE {leg} END
        * CASE WHEN {reverse} THEN -1 ELSE 1 END AS weight FROM (
      SELECT *, greatest({rules.minimum_quintile_size}, n // 5) AS q FROM (
        SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score, contract_id) AS rk,
          count(*) OVER (PARTITION BY {group}) AS n FROM {source} WHERE score IS NOT NULL))
    WHERE n >= 2 * q AND (rk <= q OR rk > n - q)"""


def inverse_vol(source: str, *, rules=S.WEIGHTS, group: str = "decision_ns, member") -> dict[str, str]:
    """`source` has group columns, contract_id, sgn, sigma. Adds `capped` at the end."""
    part = f"PARTITION BY {group}"
    return {
        "raw_ts": f"""
    SELECT {group}, contract_id, sgn / greatest(sigma, {rules.volatility_floor}) AS raw
    FROM {source} WHERE sgn <> 0 AND sigma IS NOT NULL""",
        "unit_ts": f"""
    SELECT *, raw / sum(abs(raw)) OVER ({part}) AS w, count(*) OVER ({part}) AS n FROM raw_ts""",
        "filled_ts": f"""
    SELECT *, {rules.time_series_cap_numerator} / n AS cap,
      row_number() OVER ({part} ORDER BY abs(w) DESC, contract_id) AS pos,
      sum(abs(w)) OVER ({part} ORDER BY abs(w) DESC, contract_id
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM unit_ts""",
        "frozen_ts": f"""
    SELECT *, coalesce(min(CASE WHEN abs(w) * (1 - (pos - 1) * cap) / rest <= cap THEN pos - 1 END)
      OVER ({part}), n) AS k FROM filled_ts""",
        "capped": f"""
    SELECT {group}, contract_id, CASE WHEN k = 0 THEN w WHEN k * cap >= 1 THEN sign(w) / n
      WHEN pos <= k THEN sign(w) * cap ELSE w * (1 - k * cap) / tail END AS weight
    FROM (SELECT *, max(CASE WHEN pos = k + 1 THEN rest END) OVER ({part}) AS tail FROM frozen_ts)""",
    }


def random_score(seed: int, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST(('0x' || substr(md5({text}), 1, 12))::BIGINT AS DOUBLE) / {16**12}.0::DOUBLE"


def controls(rules=S.PANEL) -> dict[str, str]:
    return {
        "drawn": f"""
    SELECT decision_ns, 'random_ranks' AS member, contract_id,
      {random_score(rules.random_seed, 'decision_ns', 'contract_id')} AS score FROM universe""",
        "passive": """
    SELECT decision_ns, 'passive_long_ew' AS member, contract_id,
      1.0::DOUBLE / count(*) OVER (PARTITION BY decision_ns) AS weight FROM universe""",
        "random_ranks": quintile("drawn"),
    }


def momentum(members=S.MEMBERS, rules=S.PANEL, bars: str = "bars_type") -> dict[str, str]:
    """Up to and including `weights` for the momentum members and controls."""
    out = dict(universe(bars, rules.universe))
    out.update(volatility(rules.volatility_window_days, bars))
    for days in sorted({m.lookback_days for m in members}):
        out[f"trailing_{days}"] = trailing(days, bars)
    scored = " UNION ALL ".join(
        f"SELECT u.decision_ns, '{m.name}' AS member, '{m.kind}' AS kind, {str(m.reverse).lower()} AS rev, "
        f"u.contract_id, t.ret AS score, v.sigma, sign(t.ret) AS sgn FROM universe u "
        f"JOIN trailing_{m.lookback_days} t ON t.contract_id = u.contract_id AND t.close_time_ns = u.decision_ns "
        f"JOIN volatility v ON v.contract_id = u.contract_id AND v.close_time_ns = u.decision_ns"
        for m in members
    )
    out["scored"] = scored
    out["scored_xs"] = "SELECT * FROM scored WHERE kind = 'cross_sectional'"
    out["scored_ts"] = "SELECT * FROM scored WHERE kind = 'time_series'"
    out["xs"] = quintile("scored_xs", reverse="rev")
    out.update(inverse_vol("scored_ts", rules=rules.weights))
    out.update(controls(rules))
    out["weights"] = " UNION ALL ".join(
        f"SELECT decision_ns, member, contract_id, weight FROM {t}"
        for t in ("xs", "capped", "passive", "random_ranks")
    )
    return out


def prices(bars: str = "bars_type", days: int = 7) -> str:
    return f"""
    SELECT b.contract_id, b.close_time_ns AS decision_ns, b.close AS entry_close, x.close AS exit_close,
      (SELECT arg_max(i.close, i.close_time_ns) FROM {bars} i WHERE i.contract_id = b.contract_id
        AND i.close_time_ns > b.close_time_ns AND i.close_time_ns < b.close_time_ns + {days * DAY}) AS last_inside
    FROM {bars} b LEFT JOIN {bars} x ON x.contract_id = b.contract_id
      AND x.close_time_ns = b.close_time_ns + {days * DAY} WHERE b.day % 7 = 3"""


def scenario_rows(scenarios=S.SCENARIOS) -> str:
    rows = ", ".join(
        f"('{s.scenario}', {s.fee_bps}::DOUBLE, {s.slippage_tier1_bps}::DOUBLE, {s.slippage_tier2_bps}::DOUBLE, "
        f"{s.receipt_multiplier}::DOUBLE, {s.payment_multiplier}::DOUBLE, {s.forced_multiplier}::DOUBLE, "
        f"{'NULL' if s.spot_fee_bps is None else s.spot_fee_bps}::DOUBLE)"
        for s in scenarios
    )
    return (
        f"SELECT * FROM (VALUES {rows}) v(scenario, fee, slip1, slip2, receipt_m, payment_m, forced_m, spot_fee)"
    )


def episodes(
    *, bars: str = "bars_type", folds: bool = False, tiers: str = "universe", settlements: str | None = None,
    scenarios=S.SCENARIOS, holding_days: int = 7,
) -> dict[str, str]:
    """From `weights` and `calendar(decision_ns, ordinal, skipped[, fold_index])` to `lines` and `episodes`.

    `weights` must carry fold_index when `folds` is set.
    """
    f = "fold_index, " if folds else ""
    on = "AND c.fold_index = w.fold_index" if folds else ""
    part = f"PARTITION BY {f}member, decision_ns"
    paid = (
        f"LEFT JOIN {settlements} s ON s.contract_id = j.contract_id AND s.decision_ns = j.decision_ns + {WEEK}"
        if settlements else ""
    )
    pos, neg = ("coalesce(s.positive, 0)::DOUBLE", "coalesce(s.negative, 0)::DOUBLE") if settlements else ("0::DOUBLE", "0::DOUBLE")
    side = """(CASE WHEN j.contract_id LIKE 'spot:%' AND spot_fee IS NOT NULL THEN spot_fee ELSE fee END
        + CASE WHEN coalesce(t.tier, 2) = 1 THEN slip1 ELSE slip2 END) / 10000"""
    return {
        "prices": prices(bars, holding_days),
        "held": f"""
    SELECT {('w.fold_index, ' if folds else '')}w.member, w.decision_ns, c.ordinal, w.contract_id, w.weight,
      coalesce(exit_close, last_inside, entry_close) / entry_close - 1 AS ret, exit_close IS NULL AS forced
    FROM weights w JOIN prices p ON p.contract_id = w.contract_id AND p.decision_ns = w.decision_ns
    JOIN calendar c ON c.decision_ns = w.decision_ns {on}""",
        "drifted": f"""
    SELECT *, CASE WHEN forced OR 1 + g = 0 THEN 0 ELSE weight * (1 + ret) / (1 + g) END AS drift
    FROM (SELECT *, sum(weight * ret) OVER ({part}) AS g FROM held)""",
        "carried": f"""
    SELECT {('c.fold_index, ' if folds else '')}w.member, c.decision_ns, w.contract_id, w.drift
    FROM drifted w JOIN calendar c ON c.ordinal = w.ordinal + 1 AND NOT c.skipped {on}""",
        "joined": f"""
    SELECT {f}member, decision_ns, contract_id, coalesce(h.weight, 0) AS weight,
      coalesce(p.drift, 0) AS previous, coalesce(h.ret, 0) AS ret, coalesce(h.forced, false) AS forced
    FROM drifted h FULL JOIN carried p USING ({f}member, decision_ns, contract_id)""",
        "scenarios": scenario_rows(scenarios),
        "lines": f"""
    SELECT *, gross - turnover_cost - funding_cost - forced_close_cost AS net FROM (
      SELECT {('j.fold_index, ' if folds else '')}j.member, j.decision_ns, j.contract_id, scenario, j.weight,
        j.previous, j.forced, j.weight * j.ret AS gross, abs(j.weight - j.previous) AS turnover,
        abs(j.weight - j.previous) * {side} AS turnover_cost,
        j.weight * CASE WHEN j.weight > 0 THEN {pos} * payment_m + {neg} * receipt_m
          ELSE {neg} * payment_m + {pos} * receipt_m END AS funding_cost,
        CASE WHEN j.forced THEN abs(j.weight) * {side} * forced_m ELSE 0 END AS forced_close_cost
      FROM joined j LEFT JOIN {tiers} t ON t.decision_ns = j.decision_ns AND t.contract_id = j.contract_id
      {paid} CROSS JOIN scenarios)""",
        "summed": f"""
    SELECT {f}member, decision_ns, scenario, sum(gross) AS gross_return, sum(turnover) AS turnover,
      sum(turnover_cost) AS turnover_cost, sum(funding_cost) AS funding_cost,
      sum(forced_close_cost) AS forced_close_cost, sum(net) AS net_return,
      sum(abs(weight)) AS gross_exposure, sum(weight) AS net_exposure,
      count_if(forced) AS forced_close_count, count_if(weight <> 0) AS positions
    FROM lines GROUP BY ALL""",
    }


AMOUNTS = (
    "gross_return", "turnover", "turnover_cost", "funding_cost", "forced_close_cost", "net_return",
    "gross_exposure", "net_exposure",
)


def grid(members: list[str], *, folds: bool = False, scenarios=S.SCENARIOS) -> dict[str, str]:
    """`grid_episodes`: a row for every member and scenario at every live decision."""
    f = "fold_index, " if folds else ""
    names = ", ".join(f"('{m}')" for m in members)
    cases = ", ".join(f"('{s.scenario}')" for s in scenarios)
    amounts = ", ".join(f"coalesce(e.{a}, 0) AS {a}" for a in AMOUNTS)
    return {
        "grid_episodes": f"""
    SELECT {f}decision_ns, c.ordinal, member, scenario, {amounts},
      coalesce(e.forced_close_count, 0) AS forced_close_count, coalesce(e.positions, 0) AS positions
    FROM calendar c CROSS JOIN (VALUES {names}) m(member) CROSS JOIN (VALUES {cases}) k(scenario)
    LEFT JOIN summed e USING ({f}decision_ns, member, scenario) WHERE NOT c.skipped"""
    }


def plain_calendar() -> dict[str, str]:
    return {
        "calendar": """
    SELECT decision_ns, row_number() OVER (ORDER BY decision_ns) AS ordinal,
      decision_ns NOT IN (SELECT decision_ns FROM universe) AS skipped FROM decisions"""
    }


def bounds(geometry=S.GEOMETRY, samples: str = "decisions") -> dict[str, str]:
    return {
        "bounds": f"""
    SELECT first_ns, last_ns, spacing_ns, holdout_start_ns,
      CASE WHEN room >= 0 THEN room // {geometry.step_ns} + 1 ELSE 0 END AS fold_count
    FROM (SELECT *, last_ns - {geometry.holdout_ns} + spacing_ns AS holdout_start_ns,
        last_ns - {geometry.holdout_ns} + spacing_ns - first_ns - {geometry.length_ns} AS room
      FROM (SELECT min(decision_ns) AS first_ns, max(decision_ns) AS last_ns,
        max(decision_ns) - (SELECT max(decision_ns) FROM {samples}
          WHERE decision_ns < (SELECT max(decision_ns) FROM {samples})) AS spacing_ns FROM {samples}))"""
    }


def folds(geometry=S.GEOMETRY, samples: str = "decisions") -> dict[str, str]:
    """`bounds`, `folds`, and the per-fold test `fold_days(fold_index, decision_ns, ordinal)`."""
    columns = ", ".join(
        f"first_ns + fold_index * {geometry.step_ns} + {start} AS {name}_start_ns, "
        f"first_ns + fold_index * {geometry.step_ns} + {start + duration} AS {name}_end_ns"
        for name, (start, duration) in geometry.offsets().items()
    )
    return {
        **bounds(geometry, samples),
        "folds": f"""
    SELECT fold_index, {columns} FROM (SELECT first_ns, unnest(range(fold_count)) AS fold_index FROM bounds)""",
        "fold_days": f"""
    SELECT fold_index, decision_ns, row_number() OVER (PARTITION BY fold_index ORDER BY decision_ns) AS ordinal
    FROM folds JOIN {samples} ON decision_ns >= test_start_ns AND decision_ns < test_end_ns
      AND decision_ns + {WEEK} < test_end_ns""",
    }


def fold_calendar() -> dict[str, str]:
    return {
        **folds(),
        "calendar": """
    SELECT fold_index, decision_ns, ordinal, decision_ns NOT IN (SELECT decision_ns FROM universe) AS skipped
    FROM fold_days""",
    }
