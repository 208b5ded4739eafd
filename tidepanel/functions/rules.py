"""Ordered rules and sizing limits applied to order intents, and small labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.operators.decisions import first_reason


@dataclass(frozen=True)
class RiskLimits:
    """Account limits (fixed values) an intent is checked against."""

    maximum_planned_loss: float = 0.25
    maximum_instrument_exposure: float = 25.0
    maximum_gross_exposure: float = 50.0
    maximum_daily_loss: float = 1.0
    maximum_weekly_loss: float = 2.5
    maximum_drawdown: float = 5.0
    hard_cumulative_loss: float = 10.0
    maximum_positions: int = 2


def entry_rejection(limits: RiskLimits) -> Column:
    """The first rule an intent breaks, in a fixed order; NULL when none.

    Expects the intent, state and health columns on one row.
    """
    c = F.col
    return first_reason(
        [
            (c("hard_kill_switch"), "HARD_KILL_SWITCH"),
            (c("cumulative_loss") >= limits.hard_cumulative_loss, "CUMULATIVE_LOSS_LIMIT"),
            (c("daily_loss") >= limits.maximum_daily_loss, "DAILY_LOSS_LIMIT"),
            (c("weekly_loss") >= limits.maximum_weekly_loss, "WEEKLY_LOSS_LIMIT"),
            (c("high_water_mark") - c("equity") >= limits.maximum_drawdown, "DRAWDOWN_LIMIT"),
            (c("unknown_order"), "UNKNOWN_ORDER_OUTCOME"),
            (~c("audit_sink_healthy"), "AUDIT_SINK_UNHEALTHY"),
            (~c("account_synchronized"), "ACCOUNT_NOT_SYNCHRONIZED"),
            (~c("market_data_healthy") | ~c("book_valid"), "MARKET_DATA_UNHEALTHY"),
            (~c("rules_valid"), "INVALID_VENUE_RULES"),
            (c("now_ns") < c("cooldown_until_ns"), "COOLDOWN_ACTIVE"),
            (c("now_ns") > c("expires_at_ns"), "INTENT_EXPIRED"),
            (~c("lineage_complete"), "LINEAGE_INCOMPLETE"),
            (~c("forecast_eligible"), "FORECAST_INELIGIBLE"),
            (~c("has_exit"), "EXIT_UNDEFINED"),
            (c("expected_net_return_adverse") <= 0, "ADVERSE_EV_NON_POSITIVE"),
            (F.array_contains("open_order_intents", c("instrument_id")), "OPEN_ORDER_INTENT_LIMIT"),
        ]
    )


def capped_size(limits: RiskLimits) -> Column:
    """The smallest of four limits, floored to the venue step; zero when none is left."""
    requested = F.col("requested_notional")
    safe = F.least(
        requested,
        F.lit(limits.maximum_instrument_exposure) - F.abs("instrument_exposure"),
        F.lit(limits.maximum_gross_exposure) - F.col("gross_exposure"),
        requested * F.lit(limits.maximum_planned_loss) / F.col("planned_loss"),
    )
    return F.floor(F.greatest(safe, F.lit(0.0)) / F.col("step")) * F.col("step")


def sizing_reason(limits: RiskLimits, size: Column) -> Column:
    """Why a size was refused or reduced; NULL when it stands as requested."""
    return first_reason(
        [
            ((F.col("minimum_notional") <= 0) | (F.col("step") <= 0), "INVALID_VENUE_RULES"),
            (
                (F.col("instrument_exposure") == 0) & (F.col("open_positions") >= limits.maximum_positions),
                "POSITION_COUNT_LIMIT",
            ),
            (size < F.col("minimum_notional"), "VENUE_MINIMUM_EXCEEDS_SAFE_SIZE"),
            (size < F.col("requested_notional"), "SIZE_REDUCED"),
        ]
    )


def outcome_label(trailing: Column, band: Column | float) -> Column:
    """+1 above the cost band, -1 below zero, 0 inside; NULL when nothing was measured."""
    edge = band if isinstance(band, Column) else F.lit(band)
    return F.when(trailing.isNull(), F.lit(None).cast("int")).when(trailing > edge, 1).when(trailing < 0, -1).otherwise(0)


def horizon_bars(value: Column) -> Column:
    """The declared prediction horizon, one bar when none is declared."""
    return F.coalesce(value, F.lit(1))


def whole_bps(value: Column) -> Column:
    return F.ceil(value)


def quantised(value: Column, digits: int) -> Column:
    """Half-even rounding at the recorded precision."""
    return F.bround(value, digits)


def safe_share(part: Column, whole: Column, digits: int) -> Column:
    """`part / whole` at a fixed precision, zero when there is nothing to share."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(part / F.nullif(whole, F.lit(0)), digits))


def covers_day(tail_day: Column, months: Column, day: Column, month: Column) -> Column:
    """Whether a tail date, or failing that a month list, reaches a decision day."""
    return F.when(tail_day.isNotNull(), tail_day >= day).otherwise(F.array_contains(months, month))
