"""Momentum members and controls on a weekly panel, and their priced episodes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import accounting, funding, universe, weights, windows
from tidepanel.session import staged

CONTROLS = ("no_trade", "passive_long_ew", "random_ranks")


@dataclass(frozen=True)
class MomentumMember:
    name: str
    kind: str  # "cross_sectional" or "time_series"
    lookback_days: int
    reverse: bool = False


@dataclass(frozen=True)
class PanelRules:
    universe: universe.UniverseRules
    weights: weights.WeightRules
    volatility_window_days: int
    holding_days: int = 7
    random_seed: int = 17


def panel_features(bars: DataFrame, rules: PanelRules, lookbacks: Sequence[int]) -> DataFrame:
    """Every per-contract column a decision needs, from one sort of the panel."""
    out = bars.select("contract_id", "instrument_id", "open_time_ns", "close_time_ns", "close", "quote_volume")
    for days in lookbacks:
        out = windows.trailing_return(out, days, f"return_{days}d")
    out = windows.annualised_volatility(out, rules.volatility_window_days)
    return windows.holding_prices(out, rules.holding_days).withColumn(
        "decision_ns", F.col("close_time_ns")
    )


def control_weights(eligible: DataFrame, rules: PanelRules) -> DataFrame:
    """The passive and random controls; `no_trade` holds nothing and has no rows."""
    passive = weights.equal_weights(eligible.select("decision_ns", "contract_id")).select(
        "decision_ns", F.lit("passive_long_ew").alias("member"), "contract_id", "weight"
    )
    drawn = eligible.select(
        "decision_ns",
        F.lit("random_ranks").alias("member"),
        "contract_id",
        weights.seeded_score(rules.random_seed, F.col("decision_ns"), F.col("contract_id")).alias("score"),
    )
    return passive.unionByName(weights.quintile_weights(drawn, rules.weights))


def momentum_weights(
    eligible: DataFrame, rules: PanelRules, members: Sequence[MomentumMember]
) -> DataFrame:
    """Weights of all members in one pass: members are rows, not separate jobs.

    `eligible` carries the ``return_<n>d`` columns and ``volatility``.
    """
    def stacked(kind: str) -> DataFrame | None:
        chosen = [m for m in members if m.kind == kind]
        if not chosen:
            return None
        options = F.array(
            *[
                F.struct(
                    F.lit(m.name).alias("member"),
                    F.col(f"return_{m.lookback_days}d").alias("score"),
                )
                for m in chosen
            ]
        )
        return eligible.withColumn("_m", F.explode(options)).select(
            "decision_ns", "contract_id", "volatility", "_m.*"
        )

    parts = [control_weights(eligible, rules)]
    cross = stacked("cross_sectional")
    if cross is not None:
        flipped = F.col("member").isin(*[m.name for m in members if m.reverse])
        parts.append(weights.quintile_weights(cross, rules.weights, reverse=flipped))
    series = stacked("time_series")
    if series is not None:
        parts.append(
            weights.inverse_volatility_weights(
                series.filter(F.col("score").isNotNull()).withColumn("sign", F.signum("score")), rules.weights
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def eligible_features(bars: DataFrame, rules: PanelRules, lookbacks: Sequence[int]) -> DataFrame:
    """The universe of each decision with its members' inputs and holding prices."""
    picked = universe.select_universe(bars, rules.universe)
    features = panel_features(bars, rules, lookbacks).drop(
        "instrument_id", "open_time_ns", "close_time_ns", "close", "quote_volume"
    )
    return picked.join(features, ["contract_id", "decision_ns"])


def momentum_episodes(
    bars: DataFrame, calendar: DataFrame, rules: PanelRules, members: Sequence[MomentumMember],
    scenarios: Sequence[accounting.CostTable], events: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Episode rows and the contract lines beneath them.

    `calendar` holds decision_ns and ordinal, with fold_index when the job runs
    every fold at once; the skip flag is added here from the universe. `events`
    are funding events by instrument.
    """
    lookbacks = sorted({m.lookback_days for m in members})
    bars, calendar = staged(bars, "bars"), staged(calendar, "calendar")
    eligible = staged(eligible_features(bars, rules, lookbacks), "eligible")
    book = [c for c in ("fold_index",) if c in calendar.columns] + ["member"]
    status = universe.universe_status(calendar.select("decision_ns").distinct(), eligible)
    placed = calendar.join(status.select("decision_ns", "skipped"), "decision_ns")
    vectors = momentum_weights(eligible, rules, members)
    if "fold_index" in calendar.columns:
        vectors = vectors.join(calendar.select("fold_index", "decision_ns"), "decision_ns")
    prices = windows.holding_prices(bars, rules.holding_days).select(
        "contract_id", F.col("close_time_ns").alias("decision_ns"), "entry_close", "exit_close", "last_inside"
    )
    settlements = None
    if events is not None:
        settlements = funding.for_contracts(funding.weekly_settlements(events), bars)
    # Both results read the lines; made again, they would read all funding events again.
    lines = staged(accounting.evaluate_book(
        vectors, prices, placed, scenarios, book=book, tiers=eligible, settlements=settlements
    ), "lines")
    names = [m.name for m in members] + list(CONTROLS)
    rows = accounting.complete_grid(accounting.episodes(lines, book), placed, names, scenarios)
    held = F.col("member").isin(*[m.name for m in members]) & (F.col("positions") == 0)
    return rows.withColumn("held_nothing", held), lines
