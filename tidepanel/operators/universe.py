"""Contract identity, the decision calendar and point-in-time universes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.timefns import DAY_NS, is_weekly_bar


@dataclass(frozen=True)
class UniverseRules:
    minimum_history_days: int
    liquidity_window_days: int
    minimum_median_quote_volume: float
    maximum_contracts: int
    minimum_contracts: int
    tier_one_rank_limit: int


def attach_contract_id(bars: DataFrame) -> DataFrame:
    """Identity is `instrument:first_open`, not the ticker.

    The first open is taken over the whole dataset, so call this before any
    availability filter. One row per instrument comes out of the aggregate;
    Catalyst broadcasts it when its measured size allows.
    """
    first = bars.groupBy("instrument_id").agg(F.min("open_time_ns").alias("_first_open"))
    return bars.join(first, "instrument_id").withColumn(
        "contract_id", F.concat_ws(":", "instrument_id", F.col("_first_open").cast("string"))
    ).drop("_first_open")


def rebalance_calendar(bars: DataFrame) -> DataFrame:
    """Distinct weekly decision closes observed anywhere in the panel."""
    return (
        bars.filter(is_weekly_bar(F.col("open_time_ns")))
        .select(F.col("close_time_ns").alias("decision_ns"))
        .distinct()
    )


def screen_contracts(bars: DataFrame, rules: UniverseRules, decisions: DataFrame | None = None) -> DataFrame:
    """Contracts passing history, presence, completeness and liquidity at a decision.

    History is a bar count; liquidity is a median over a calendar window that
    must be complete. A contract's rows are bounded by the calendar, so the
    per-contract window stays small however many ticks fed the bars.
    """
    w = W.partitionBy("contract_id").orderBy("close_time_ns")
    span = w.rangeBetween(-(rules.liquidity_window_days - 1) * DAY_NS, 0)
    scored = bars.select(
        "contract_id",
        "instrument_id",
        F.col("close_time_ns").alias("decision_ns"),
        is_weekly_bar(F.col("open_time_ns")).alias("_weekly"),
        F.row_number().over(w).alias("_history"),
        F.count("*").over(span).alias("_present"),
        F.percentile("quote_volume", F.lit(0.5)).over(span).alias("median_quote_volume"),
    )
    if decisions is None:
        scored = scored.filter("_weekly")
    else:
        scored = scored.join(decisions.select("decision_ns"), "decision_ns", "left_semi")
    return scored.filter(
        (F.col("_history") >= rules.minimum_history_days)
        & (F.col("_present") == rules.liquidity_window_days)
        & (F.col("median_quote_volume") >= rules.minimum_median_quote_volume)
    ).select("decision_ns", "contract_id", "instrument_id", "median_quote_volume")


def rank_universe(screened: DataFrame, rules: UniverseRules) -> DataFrame:
    """Liquidity rank, cap, tier and the minimum-size gate of each decision."""
    by_decision = W.partitionBy("decision_ns")
    ranked = by_decision.orderBy(F.desc("median_quote_volume"), "contract_id")
    return (
        screened.withColumn("liquidity_rank", F.row_number().over(ranked))
        .withColumn("_eligible", F.count("*").over(by_decision))
        .filter(
            (F.col("_eligible") >= rules.minimum_contracts)
            & (F.col("liquidity_rank") <= rules.maximum_contracts)
        )
        .withColumn(
            "tier", F.when(F.col("liquidity_rank") <= rules.tier_one_rank_limit, 1).otherwise(2)
        )
        .drop("_eligible")
    )


def select_universe(bars: DataFrame, rules: UniverseRules, decisions: DataFrame | None = None) -> DataFrame:
    return rank_universe(screen_contracts(bars, rules, decisions), rules)


def universe_status(decisions: DataFrame, universe: DataFrame) -> DataFrame:
    """Per decision: how many contracts were selected, and whether it is skipped."""
    sizes = universe.groupBy("decision_ns").agg(F.count("*").alias("contracts"))
    return (
        decisions.join(sizes, "decision_ns", "left")
        .withColumn("contracts", F.coalesce("contracts", F.lit(0)).cast("long"))
        .withColumn("skipped", F.col("contracts") == 0)
    )
