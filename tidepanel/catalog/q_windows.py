"""Per-contract windows, cross-sectional ranks and weights (E, F and C3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog import panelsql as P
from tidepanel.catalog import settings as S
from tidepanel.catalog.registry import query, rounded
from tidepanel.catalog.sqlviews import DAY, with_views
from tidepanel.operators import universe, weights, windows
from tidepanel.plans import momentum


@query("e03_universe", with_views("bars_type", more=P.universe()) + """
SELECT decision_ns, contract_id, median_quote_volume, liquidity_rank, tier FROM universe""")
def e03(t):
    return universe.select_universe(t.bars(), S.UNIVERSE).drop("instrument_id")


@query("f01_top_n_by_liquidity", with_views("bars_brand", more=P.universe("bars_brand", S.BRAND_UNIVERSE)) + """
SELECT decision_ns, contract_id, liquidity_rank, tier FROM universe""")
def f01(t):
    return universe.select_universe(t.bars("p_brand"), S.BRAND_UNIVERSE).select(
        "decision_ns", "contract_id", "liquidity_rank", "tier"
    )


@query("c03_trailing_return", with_views("bars_brand", more={"r": P.trailing(7, "bars_brand")}) + """
SELECT contract_id, close_time_ns, round(ret, 9) AS trailing_return FROM r WHERE ret IS NOT NULL""")
def c03(t):
    out = windows.trailing_return(t.bars("p_brand"), 7).filter(F.col("trailing_return").isNotNull())
    return rounded(out.select("contract_id", "close_time_ns", "trailing_return"), 9)


@query("e04_annualised_volatility", with_views("bars_type", more=P.volatility(5)) + """
SELECT contract_id, close_time_ns, round(sigma, 9) AS volatility FROM volatility""")
def e04(t):
    out = windows.annualised_volatility(t.bars(), 5)
    return rounded(out.select("contract_id", "close_time_ns", "volatility"), 9)


RUN_SQL = f"""
    SELECT *, row_number() OVER (PARTITION BY contract_id, isl ORDER BY close_time_ns) AS run_length
    FROM (SELECT *, close_time_ns - {DAY} * row_number() OVER (PARTITION BY contract_id ORDER BY close_time_ns)
      AS isl FROM bars_type)"""


@query("e05_contiguous_run", with_views("bars_type", more={"r": RUN_SQL}) + """
SELECT contract_id, close_time_ns, run_length FROM r""")
def e05(t):
    return windows.contiguous_run(t.bars()).select("contract_id", "close_time_ns", "run_length")


@query("e06_sma", with_views("bars_type", more={"r": RUN_SQL}) + """
SELECT contract_id, close_time_ns, round(CASE WHEN run_length >= 5 THEN avg(close) OVER (PARTITION BY contract_id
  ORDER BY close_time_ns ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 6) AS sma_5 FROM r""")
def e06(t):
    out = windows.sma(windows.contiguous_run(t.bars()), 5, "sma_5")
    return rounded(out.select("contract_id", "close_time_ns", "sma_5"), 6)


EMA_SQL = """
    SELECT contract_id, close_time_ns, close, rn, close AS ema_{w} FROM ordered WHERE rn = 1
    UNION ALL SELECT o.contract_id, o.close_time_ns, o.close, o.rn,
      2.0::DOUBLE / {n} * o.close + (1 - 2.0::DOUBLE / {n}) * e.ema_{w}
    FROM ema_{w} e JOIN ordered o ON o.contract_id = e.contract_id AND o.rn = e.rn + 1"""


def ema_ctes(*spans: int) -> dict[str, str]:
    out = {"ordered": """
    SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY close_time_ns) AS rn FROM bars_type"""}
    for w in spans:
        out[f"ema_{w}"] = EMA_SQL.format(w=w, n=w + 1)
    return out


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("e07_ema", recursive(with_views("bars_type", more=ema_ctes(12))) + """
SELECT contract_id, close_time_ns, round(ema_12, 6) AS ema_12 FROM ema_12""")
def e07(t):
    return rounded(windows.ema(t.bars(), (12,)).select("contract_id", "close_time_ns", "ema_12"), 6)


def votes_sql(spec) -> dict[str, str]:
    w = "PARTITION BY contract_id ORDER BY close_time_ns"
    rows = lambda n: f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    cols = []
    for n in spec.sma:
        cols.append(f"CASE WHEN run_length >= {n} THEN sign(close - avg(close) OVER {rows(n)}) END AS ma_{n}")
    for a, b in spec.crosses:
        cols.append(
            f"CASE WHEN run_length >= {b} THEN sign(avg(close) OVER {rows(a)} - avg(close) OVER {rows(b)}) END "
            f"AS ma_cross_{a}_{b}")
    for n in spec.breakout:
        cols.append(
            f"CASE WHEN run_length >= {n} THEN (close = max(close) OVER {rows(n)})::INT "
            f"- (close = min(close) OVER {rows(n)})::INT END AS breakout_{n}")
    for n in spec.roc:
        cols.append(f"CASE WHEN run_length > {n} THEN sign(close - lag(close, {n}) OVER ({w})) END AS roc_{n}")
    a, b = spec.macd
    cols.append(f"CASE WHEN run_length >= {spec.span_days} THEN sign(ema_{a} - ema_{b}) END AS macd_{a}_{b}")
    return {
        **ema_ctes(a, b),
        "runs": RUN_SQL,
        "votes": f"""
    SELECT contract_id, close_time_ns, close, {', '.join(cols)}
    FROM runs JOIN (SELECT contract_id, close_time_ns, ema_{a} FROM ema_{a}) USING (contract_id, close_time_ns)
    JOIN (SELECT contract_id, close_time_ns, ema_{b} FROM ema_{b}) USING (contract_id, close_time_ns)""",
        "trend": f"""
    SELECT contract_id, close_time_ns, ({' + '.join(spec.names)}) / {len(spec.names)}.0::DOUBLE AS score FROM votes""",
    }


_SHORT = S.SHORT_INDICATORS


@query("e08_indicator_votes", recursive(with_views("bars_type", more=votes_sql(_SHORT))) + f"""
SELECT contract_id, close_time_ns, {', '.join(f'CAST({n} AS INT) AS {n}' for n in _SHORT.names)} FROM votes""")
def e08(t):
    return windows.indicator_votes(t.bars(), _SHORT).select("contract_id", "close_time_ns", *_SHORT.names)


@query("e09_trend_score", recursive(with_views("bars_type", more=votes_sql(S.INDICATORS))) + """
SELECT contract_id, close_time_ns, round(score, 9) AS score FROM trend""")
def e09(t):
    out = windows.trend_score(t.bars(), spec=S.INDICATORS)
    return rounded(out.select("contract_id", "close_time_ns", "score"), 9)


SCORED_7D = {
    **P.universe(), "trailing_7": P.trailing(7),
    "s": """
    SELECT u.decision_ns, 'm' AS member, u.contract_id, t.ret AS score FROM universe u JOIN trailing_7 t
      ON t.contract_id = u.contract_id AND t.close_time_ns = u.decision_ns""",
    "xs": P.quintile("s"),
}


def _scored(t, lookback: int = 7):
    eligible = momentum.eligible_features(t.bars(), S.PANEL, [lookback])
    return eligible.withColumn("member", F.lit("m")).withColumn("score", F.col(f"return_{lookback}d"))


@query("e10_quintile_weights", with_views("bars_type", more=SCORED_7D) + """
SELECT decision_ns, contract_id, round(weight, 9) AS weight FROM xs""")
def e10(t):
    out = weights.quintile_weights(_scored(t), S.WEIGHTS)
    return rounded(out.select("decision_ns", "contract_id", "weight"), 9)


TS_7D = {
    **P.universe(), "trailing_7": P.trailing(7), **P.volatility(5),
    "s": """
    SELECT u.decision_ns, 'm' AS member, u.contract_id, sign(t.ret) AS sgn, v.sigma FROM universe u
    JOIN trailing_7 t ON t.contract_id = u.contract_id AND t.close_time_ns = u.decision_ns
    JOIN volatility v ON v.contract_id = u.contract_id AND v.close_time_ns = u.decision_ns""",
    **P.inverse_vol("s"),
}


@query("e11_inverse_volatility_weights", with_views("bars_type", more=TS_7D) + """
SELECT decision_ns, contract_id, round(w, 9) AS weight FROM unit_ts""")
def e11(t):
    signed = _scored(t).filter(F.col("score").isNotNull()).withColumn("sign", F.signum("score"))
    raw = signed.filter((F.col("sign") != 0) & F.col("volatility").isNotNull()).withColumn(
        "weight", F.col("sign") / F.greatest("volatility", F.lit(S.WEIGHTS.volatility_floor))
    )
    return rounded(weights.normalise(raw).select("decision_ns", "contract_id", "weight"), 9)


@query("e12_water_fill", with_views("bars_type", more=TS_7D) + """
SELECT decision_ns, contract_id, round(weight, 9) AS weight FROM capped""")
def e12(t):
    signed = _scored(t).filter(F.col("score").isNotNull()).withColumn("sign", F.signum("score"))
    out = weights.inverse_volatility_weights(signed, S.WEIGHTS)
    return rounded(out.select("decision_ns", "contract_id", "weight"), 9)


TREND_TS = {
    **P.universe(), **P.volatility(5), **votes_sql(_SHORT),
    "s": """
    SELECT u.decision_ns, 'm' AS member, u.contract_id, v.sigma,
      CASE WHEN t.score >= 0.25 THEN 1 WHEN t.score <= -0.25 THEN -1 ELSE 0 END AS sgn FROM universe u
    JOIN trend t ON t.contract_id = u.contract_id AND t.close_time_ns = u.decision_ns AND t.score IS NOT NULL
    JOIN volatility v ON v.contract_id = u.contract_id AND v.close_time_ns = u.decision_ns""",
    **P.inverse_vol("s"),
}


@query("e13_score_threshold_weights", recursive(with_views("bars_type", more=TREND_TS)) + """
SELECT decision_ns, contract_id, round(weight, 9) AS weight FROM capped""")
def e13(t):
    bars = t.bars()
    scores = windows.trend_score(bars, "score", _SHORT).select(
        "contract_id", F.col("close_time_ns").alias("decision_ns"), "score"
    )
    eligible = momentum.eligible_features(bars, S.PANEL, []).join(scores, ["contract_id", "decision_ns"])
    signed = eligible.filter(F.col("score").isNotNull()).withColumns(
        {"member": F.lit("m"), "sign": weights.dead_band_sign(F.col("score"), 0.25)}
    )
    out = weights.inverse_volatility_weights(signed, S.WEIGHTS)
    return rounded(out.select("decision_ns", "contract_id", "weight"), 9)


@query("b06_dead_band_sign", recursive(with_views("bars_type", more=votes_sql(_SHORT))) + """
SELECT contract_id, close_time_ns, CASE WHEN score >= 0.25 THEN 1 WHEN score <= -0.25 THEN -1 ELSE 0 END AS signal
FROM trend WHERE score IS NOT NULL""")
def b06(t):
    out = windows.trend_score(t.bars(), "score", _SHORT).filter(F.col("score").isNotNull())
    return out.select("contract_id", "close_time_ns", weights.dead_band_sign(F.col("score"), 0.25).alias("signal"))


@query("f02_seeded_random_order", with_views("bars_type", more={**P.universe(), "d": f"""
    SELECT decision_ns, contract_id, {P.random_score(17, 'decision_ns', 'contract_id')} AS score FROM universe"""}) + """
SELECT decision_ns, contract_id, row_number() OVER (PARTITION BY decision_ns ORDER BY score, contract_id) AS draw
FROM d""")
def f02(t):
    from pyspark.sql import Window as W

    picked = universe.select_universe(t.bars(), S.UNIVERSE)
    score = weights.seeded_score(17, F.col("decision_ns"), F.col("contract_id"))
    order = W.partitionBy("decision_ns").orderBy(score, "contract_id")
    return picked.select("decision_ns", "contract_id", F.row_number().over(order).alias("draw"))


@query("p02_momentum_weights", with_views("bars_type", more=P.momentum()) + """
SELECT decision_ns, member, contract_id, round(weight, 9) AS weight FROM weights""")
def p02(t):
    lookbacks = sorted({m.lookback_days for m in S.MEMBERS})
    eligible = momentum.eligible_features(t.bars(), S.PANEL, lookbacks)
    return rounded(momentum.momentum_weights(eligible, S.PANEL, S.MEMBERS), 9)
