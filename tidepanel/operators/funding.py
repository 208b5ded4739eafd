"""Periodic payments attached to contracts: trailing sums and holding sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.timefns import WEEK_NS, int_div, week_end_ns


def interval_sum(
    events: DataFrame, queries: DataFrame, *, keys: Sequence[str], span_ns: int, event_ns: str,
    query_ns: str, value: str, name: str,
) -> DataFrame:
    """Sum of `value` in ``(query - span, query]``; NULL when no event falls inside.

    Events are bucketed by the span, so a query meets exactly two buckets and
    the range join becomes an equi-join with a residual filter. Events of one
    instant are summed before the join, which keeps duplicates of a hot key off
    the wire, and the bucket in the join key spreads that key over tasks.
    """
    compact = (
        events.groupBy(*keys, event_ns)
        .agg(F.sum(value).alias("_v"))
        .withColumn("_b", int_div(F.col(event_ns), span_ns))
        .withColumnRenamed(event_ns, "_t")
    )
    probe = queries.select(*keys, query_ns).distinct().withColumn(
        "_b",
        F.explode(F.array(int_div(F.col(query_ns), span_ns) - 1, int_div(F.col(query_ns), span_ns))),
    )
    inside = (F.col("_t") > F.col(query_ns) - F.lit(span_ns)) & (F.col("_t") <= F.col(query_ns))
    summed = (
        probe.join(compact, [*keys, "_b"])
        .filter(inside)
        .groupBy(*keys, query_ns)
        .agg(F.sum("_v").alias(name))
    )
    return queries.join(summed, [*keys, query_ns], "left")


def weekly_settlements(events: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Events folded into the weekly decision that closes their week.

    One row per instrument and week: total, and the positive and negative parts
    kept apart because costs scale payments and receipts differently.
    """
    rate = F.col("rate")
    zero = F.lit(0).cast("decimal(38,10)")
    return (
        events.withColumn("decision_ns", week_end_ns(F.col("calc_time_ns")))
        .groupBy(key, "decision_ns")
        .agg(
            F.sum(rate).alias("settled"),
            F.sum(F.when(rate > 0, rate).otherwise(zero)).alias("positive"),
            F.sum(F.when(rate < 0, rate).otherwise(zero)).alias("negative"),
        )
    )


def for_contracts(settlements: DataFrame, bars: DataFrame) -> DataFrame:
    """Instrument-level settlements under their contract id; unknown instruments drop.

    Called after the weekly fold, so the join moves weeks and not raw events.
    """
    ids = bars.select("instrument_id", "contract_id").distinct()
    return settlements.join(ids, "instrument_id").drop("instrument_id")


def trailing_weekly(weekly: DataFrame, at: DataFrame, weeks: Sequence[int]) -> DataFrame:
    """Trailing sums over the last n weekly settlements, for several n at once.

    `at` names the (contract, decision) pairs to answer for. They are unioned
    into the settlements as empty rows, so each answer is one range frame over
    the contract's weeks and no join is needed.
    """
    keys = at.select("contract_id", "decision_ns").distinct().select(
        "contract_id", "decision_ns", F.lit(None).cast("decimal(38,10)").alias("settled"),
        F.lit(True).alias("_asked"),
    )
    stacked = weekly.select(
        "contract_id", "decision_ns", F.col("settled").cast("decimal(38,10)").alias("settled"),
        F.lit(False).alias("_asked"),
    ).unionByName(keys)
    w = W.partitionBy("contract_id").orderBy("decision_ns")
    sums = {
        f"trailing_{n}w": F.sum("settled").over(w.rangeBetween(-(n - 1) * WEEK_NS, 0)).cast("double")
        for n in weeks
    }
    return stacked.withColumns(sums).filter("_asked").drop("settled", "_asked")


def score_extras(weekly: DataFrame, eligible: DataFrame, weeks: Sequence[int]) -> DataFrame:
    """Per decision and lookback: eligible contracts with and without a settlement in the window, and their mean score.

    A contract that was never scored is not averaged in; without any score the mean is zero.
    """
    options = F.array(*[F.struct(F.lit(n).alias("lookback_weeks"), F.col(f"trailing_{n}w").alias("score")) for n in weeks])
    scored = trailing_weekly(weekly, eligible, weeks).select("decision_ns", F.explode(options).alias("_m")).select("decision_ns", "_m.*")
    return scored.groupBy("decision_ns", "lookback_weeks").agg(
        F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("unscored"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))
