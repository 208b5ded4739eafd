"""Cross-sectional and time-series portfolio weights, one group per decision."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BY_DECISION = ("decision_ns", "member")


@dataclass(frozen=True)
class WeightRules:
    minimum_quintile_size: int = 1
    leg_gross: float = 0.5
    volatility_floor: float = 0.1
    time_series_cap_numerator: float = 2.0


def quintile_weights(
    scored: DataFrame, rules: WeightRules, *, reverse: bool | Column = False,
    group: Sequence[str] = BY_DECISION,
) -> DataFrame:
    """Short the lowest fifth, long the highest; both legs carry equal gross.

    Needs ``score`` non-NULL. A decision too thin for two legs yields no rows.
    """
    cell = W.partitionBy(*group)
    quintile = F.greatest(
        F.lit(rules.minimum_quintile_size), F.floor(F.col("_n") / F.lit(5)).cast("int")
    )
    sign = F.when(reverse if isinstance(reverse, Column) else F.lit(reverse), -1.0).otherwise(1.0)
    leg = F.lit(rules.leg_gross) / F.col("_q")
    return (
        scored.filter(F.col("score").isNotNull())
        .withColumn("_rank", F.row_number().over(cell.orderBy("score", "contract_id")))
        .withColumn("_n", F.count("*").over(cell))
        .withColumn("_q", quintile)
        .filter(F.col("_n") >= 2 * F.col("_q"))
        .withColumn(
            "weight",
            F.when(F.col("_rank") <= F.col("_q"), -leg * sign).when(
                F.col("_rank") > F.col("_n") - F.col("_q"), leg * sign
            ),
        )
        .filter(F.col("weight").isNotNull())
        .select(*group, "contract_id", "weight")
    )


def normalise(df: DataFrame, weight: str = "weight", group: Sequence[str] = BY_DECISION) -> DataFrame:
    """Scale a group's weights to unit gross; a zero-gross group is left alone."""
    gross = F.sum(F.abs(weight)).over(W.partitionBy(*group))
    return df.withColumn(weight, F.when(gross > 0, F.col(weight) / gross).otherwise(F.col(weight)))


def water_fill(df: DataFrame, cap: Column, group: Sequence[str] = BY_DECISION) -> DataFrame:
    """Clip unit-gross weights at `cap`, spreading the excess over the rest.

    Clipping an entry only raises the scale of the others, so the fixpoint
    freezes the largest k weights for the smallest k that leaves entry k+1
    within the cap. Once k caps fill the book, every weight is 1/n.
    """
    cell = W.partitionBy(*group)
    descending = cell.orderBy(F.desc(F.abs("weight")), "contract_id")
    # Suffix sums, read as a running sum from the smallest weight up.
    ascending = cell.orderBy(F.abs("weight"), F.desc("contract_id")).rowsBetween(
        W.unboundedPreceding, 0
    )
    above = F.col("_position") - 1
    settled = F.abs("weight") * (1 - above * F.col("_cap")) / F.col("_rest") <= F.col("_cap")
    frozen = F.coalesce(F.min(F.when(settled, above)).over(cell), F.col("_n"))
    sign = F.when(F.col("weight") >= 0, 1.0).otherwise(-1.0)
    return (
        df.withColumn("_cap", cap)
        .withColumn("_n", F.count("*").over(cell))
        .withColumn("_rest", F.sum(F.abs("weight")).over(ascending))
        .withColumn("_position", F.row_number().over(descending))
        .withColumn("_k", frozen)
        .withColumn(
            "_tail", F.max(F.when(F.col("_position") == F.col("_k") + 1, F.col("_rest"))).over(cell)
        )
        .withColumn(
            "weight",
            F.when(F.col("_k") == 0, F.col("weight"))
            .when(F.col("_k") * F.col("_cap") >= 1, sign / F.col("_n"))
            .when(F.col("_position") <= F.col("_k"), sign * F.col("_cap"))
            .otherwise(F.col("weight") * (1 - F.col("_k") * F.col("_cap")) / F.col("_tail")),
        )
        .drop("_cap", "_n", "_rest", "_position", "_k", "_tail")
    )


def inverse_volatility_weights(
    signed: DataFrame, rules: WeightRules, group: Sequence[str] = BY_DECISION
) -> DataFrame:
    """`sign / max(volatility, floor)`, unit gross, water-filled at numerator / n.

    Rows with a zero sign or no volatility carry no position.
    """
    raw = (
        signed.filter((F.col("sign") != 0) & F.col("volatility").isNotNull())
        .withColumn(
            "weight", F.col("sign") / F.greatest(F.col("volatility"), F.lit(rules.volatility_floor))
        )
        .select(*group, "contract_id", "weight")
    )
    n = F.count("*").over(W.partitionBy(*group))
    return water_fill(normalise(raw, group=group), F.lit(rules.time_series_cap_numerator) / n, group)


def equal_weights(eligible: DataFrame, group: Sequence[str] = ("decision_ns",)) -> DataFrame:
    return eligible.withColumn("weight", F.lit(1.0) / F.count("*").over(W.partitionBy(*group)))


def seeded_score(seed: int, *parts: Column) -> Column:
    """A reproducible pseudo-random score in [0, 1) from a seed and row identity.

    Derived from MD5 so that any engine draws the same order.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def dead_band_sign(score: Column, threshold: float | Column) -> Column:
    """+1 at or above the threshold, -1 at or below its negative, 0 between."""
    band = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(score >= band, 1).when(score <= -band, -1).otherwise(0)
