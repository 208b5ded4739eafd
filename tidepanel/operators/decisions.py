"""Gates and reason codes: turning pooled statistics into a decision."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ELIGIBLE = "eligible_for_further_review"
REJECTED = "rejected"
INSUFFICIENT = "insufficient_evidence"


# The floors and limits of the decision rules.
@dataclass(frozen=True)
class GateRules:
    episode_floor: int = 50
    trade_floor: int = 200
    fold_floor: int = 3
    false_discovery_gate: float = 0.10
    concentration_limit: float = 0.40
    positive_fold_numerator: int = 2
    positive_fold_denominator: int = 3

    def required_folds(self, fold_count: Column) -> Column:
        """Ceiling of the positive-fold fraction, in integer arithmetic."""
        top = fold_count * self.positive_fold_numerator + (self.positive_fold_denominator - 1)
        return F.floor(top / F.lit(self.positive_fold_denominator))


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """The codes of the rules that fire, in order; an undecidable rule stays silent."""
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in rules]))


def first_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """The code of the first rule that fires, or NULL."""
    return F.coalesce(*[F.when(test, F.lit(code)) for test, code in rules])


def status(evidence: Column, economic: Column) -> Column:
    return (
        F.when(F.size(evidence) > 0, INSUFFICIENT)
        .when(F.size(economic) > 0, REJECTED)
        .otherwise(ELIGIBLE)
    )


def candidate_decision(rules: GateRules, fold_count: Column) -> tuple[Column, Column]:
    """Status and reason codes of one candidate of one fold evaluation, over a row of its totals and bounds."""
    evidence = reasons([
        (fold_count < rules.fold_floor, "FOLD_FLOOR_NOT_MET"),
        (F.col("trade_count") < rules.trade_floor, "EPISODE_FLOOR_NOT_MET"),
    ])
    economic = reasons([
        (F.col("base_total") <= 0, "BASE_NET_NON_POSITIVE"),
        (F.coalesce("lower", F.lit(0.0)) <= 0, "BASE_LOWER_BOUND_NON_POSITIVE"),
        (F.col("adverse_total") <= 0, "ADVERSE_NET_NON_POSITIVE"),
    ])
    context = F.col("candidate") == "no_trade"
    codes = F.when(context, F.array(F.lit("NON_PROMOTABLE_CONTEXT"))).otherwise(F.concat(evidence, economic))
    return F.when(context, "contextual_baseline").otherwise(status(evidence, economic)), codes


def member_decisions(metrics: DataFrame, rules: GateRules) -> DataFrame:
    """Every gate of one family member, over a row of its pooled metrics."""
    c = F.col
    evidence = reasons(
        [
            (c("episodes") < rules.episode_floor, "EPISODE_FLOOR_NOT_MET"),
            (c("p_value").isNull(), "BOOTSTRAP_NOT_AVAILABLE"),
        ]
    )
    over = F.greatest("largest_fold_share", "largest_contract_share", "largest_episode_share")
    economic = reasons(
        [
            (c("base_mean") <= 0, "AGGREGATE_BASE_NET_NON_POSITIVE"),
            (c("lower") <= 0, "BASE_LOWER_BOUND_NON_POSITIVE"),
            (c("adverse_mean") < 0, "AGGREGATE_ADVERSE_NET_NON_POSITIVE"),
            (c("positive_folds") < rules.required_folds(c("fold_count")), "POSITIVE_FOLD_FRACTION_NOT_MET"),
            (c("q_value") > rules.false_discovery_gate, "MULTIPLE_TESTING_GATE_NOT_MET"),
            (over > rules.concentration_limit, "CONCENTRATION_LIMIT_EXCEEDED"),
            (c("base_total") <= c("strongest_base"), "BASE_CONTROL_DOMINANCE_NOT_MET"),
            (c("adverse_total") <= c("strongest_adverse"), "ADVERSE_CONTROL_DOMINANCE_NOT_MET"),
        ]
    )
    return metrics.withColumns(
        {"decision_status": status(evidence, economic), "reason_codes": F.concat(evidence, economic)}
    )


def fold_aggregate(candidates: DataFrame, fold_count: Column, rules: GateRules) -> DataFrame:
    """Cross-fold aggregate: positive folds, totals, worst q and the gates on them.

    `candidates` has a row per candidate and fold: base_total, adverse_total,
    q_value.
    """
    rolled = candidates.groupBy("candidate").agg(
        F.count_if(F.col("base_total") > 0).alias("positive_folds"),
        F.sum("base_total").alias("base_total"),
        F.sum("adverse_total").alias("adverse_total"),
        F.max("q_value").alias("maximum_q_value"),
    )
    failed = reasons(
        [
            (F.col("positive_folds") < rules.required_folds(fold_count), "POSITIVE_FOLD_FRACTION_NOT_MET"),
            (F.col("base_total") <= 0, "AGGREGATE_BASE_NET_NON_POSITIVE"),
            (F.col("adverse_total") <= 0, "AGGREGATE_ADVERSE_NET_NON_POSITIVE"),
            (F.col("maximum_q_value") > rules.false_discovery_gate, "MULTIPLE_TESTING_GATE_NOT_MET"),
        ]
    )
    context = F.col("candidate") == "no_trade"
    return rolled.withColumn(
        "reason_codes", F.when(context, F.array(F.lit("NON_PROMOTABLE_CONTEXT"))).otherwise(failed)
    ).withColumn(
        "decision_status",
        F.when(context, "contextual_baseline").when(F.size("reason_codes") > 0, REJECTED).otherwise(ELIGIBLE),
    )


def dominance(aggregates: DataFrame, rules: GateRules) -> DataFrame:
    """Margins over the `no_trade` row, and who among the dominant is strongest.

    The no-trade totals are read with a window over the candidates of one
    comparison, which are a handful of rows.
    """
    everyone = W.partitionBy()
    idle = lambda c: F.max(F.when(F.col("candidate") == "no_trade", F.col(c))).over(everyone)
    dominates = (
        (F.col("base_margin") > 0)
        & (F.col("adverse_margin") > 0)
        & (F.col("positive_folds") >= 2)
        & (F.col("maximum_q_value") <= rules.false_discovery_gate)
        & (F.col("decision_status") == ELIGIBLE)
    )
    order = W.partitionBy("dominates_no_trade").orderBy(
        F.desc("base_total"), F.desc("adverse_total"), "candidate"
    )
    return (
        aggregates.withColumns(
            {
                "base_margin": F.col("base_total") - idle("base_total"),
                "adverse_margin": F.col("adverse_total") - idle("adverse_total"),
            }
        )
        .withColumn("dominates_no_trade", dominates)
        .withColumn("strongest", F.col("dominates_no_trade") & (F.row_number().over(order) == 1))
    )


def disagreements(reports: DataFrame, fields: Sequence[str]) -> DataFrame:
    """How many distinct values each field that must agree actually takes."""
    counts = reports.agg(*[F.countDistinct(f).alias(f) for f in fields])
    return counts.unpivot([], list(fields), "field", "distinct_values")
