"""Rolling train / validation / test folds with embargo, purge and holdout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.timefns import DAY_NS, WEEK_NS, int_div
from tidepanel.operators import skewsafe

PARTITIONS = ("train", "validation", "test")


@dataclass(frozen=True)
class FoldGeometry:
    train_ns: int = 365 * DAY_NS
    validation_ns: int = 91 * DAY_NS
    test_ns: int = 182 * DAY_NS
    step_ns: int = 182 * DAY_NS
    embargo_ns: int = 14 * DAY_NS
    holdout_ns: int = 182 * DAY_NS

    def offsets(self) -> dict[str, tuple[int, int]]:
        """Start and duration of each partition relative to the fold's start."""
        validation = self.train_ns + self.embargo_ns
        test = validation + self.validation_ns + self.embargo_ns
        return {
            "train": (0, self.train_ns),
            "validation": (validation, self.validation_ns),
            "test": (test, self.test_ns),
        }

    @property
    def length_ns(self) -> int:
        start, duration = self.offsets()["test"]
        return start + duration


def rebalance_samples(decisions: DataFrame, *, holding_days: int, venue: str = "XV") -> DataFrame:
    """Weekly decisions as samples whose label ends `holding_days` later."""
    return decisions.select(
        F.concat_ws(":", F.lit(venue), F.col("decision_ns").cast("string"), F.lit("w1")).alias("sample_id"),
        "decision_ns",
        (F.col("decision_ns") + F.lit(holding_days * DAY_NS)).alias("label_end_ns"),
    )


def calendar_bounds(samples: DataFrame, geometry: FoldGeometry) -> DataFrame:
    """One row: first decision, last decision, spacing, holdout start, fold count.

    The holdout is anchored at the last sample plus one spacing, so that it
    holds exactly its declared duration of decisions.
    """
    latest = samples.select("decision_ns").distinct().orderBy(F.desc("decision_ns")).limit(2)
    edge = latest.agg(F.max("decision_ns").alias("last_ns"), F.min("decision_ns").alias("_before"))
    spacing = F.col("last_ns") - F.col("_before")
    holdout = F.col("last_ns") - F.lit(geometry.holdout_ns) + spacing
    room = holdout - F.col("first_ns") - F.lit(geometry.length_ns)
    return (
        edge.withColumn("first_ns", samples.select(F.min("decision_ns")).scalar())
        .withColumn("spacing_ns", spacing)
        .withColumn("holdout_start_ns", holdout)
        .withColumn(
            "fold_count",
            F.when(room >= 0, int_div(room, geometry.step_ns) + 1).otherwise(F.lit(0)).cast("long"),
        )
        .drop("_before")
    )


def fold_table(bounds: DataFrame, geometry: FoldGeometry) -> DataFrame:
    """One row per fold with the six boundaries."""
    folds = bounds.filter("fold_count > 0").withColumn(
        "fold_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fold_count") - 1))
    )
    base = F.col("first_ns") + F.col("fold_index") * F.lit(geometry.step_ns)
    columns: list[Column] = [F.col("fold_index")]
    for name, (start, duration) in geometry.offsets().items():
        columns += [
            (base + F.lit(start)).alias(f"{name}_start_ns"),
            (base + F.lit(start + duration)).alias(f"{name}_end_ns"),
        ]
    return folds.select(*columns)


def _slot(name: str, end: int, step_ns: int):
    """Fold index to (index, partition, partition end)."""
    return lambda i: F.struct(
        i.alias("fold_index"),
        F.lit(name).alias("partition"),
        (F.col("_first") + i * F.lit(step_ns) + F.lit(end)).alias("_end"),
    )


def fold_membership(samples: DataFrame, bounds: DataFrame, geometry: FoldGeometry) -> DataFrame:
    """`(fold_index, partition, sample_id)` with label-purged membership.

    A sample's folds follow from arithmetic on its decision time, so membership
    is an explode and never a range join between samples and folds.
    """
    first = bounds.select("first_ns").scalar()
    count = bounds.select("fold_count").scalar()
    elapsed = F.col("decision_ns") - F.col("_first")
    spans = []
    for name, (start, duration) in geometry.offsets().items():
        low = int_div(
            F.greatest(elapsed - F.lit(start + duration), F.lit(-geometry.step_ns))
            + F.lit(geometry.step_ns), geometry.step_ns,
        )
        high = F.when(elapsed >= start, int_div(elapsed - F.lit(start), geometry.step_ns)).otherwise(-1)
        high = F.least(high, F.col("_count") - 1)
        indices = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        spans.append(F.transform(indices, _slot(name, start + duration, geometry.step_ns)))
    return (
        samples.withColumns({"_first": first, "_count": count})
        .withColumn("_slot", F.explode(F.concat(*spans)))
        .filter(F.col("label_end_ns") < F.col("_slot._end"))
        .select("_slot.fold_index", "_slot.partition", "sample_id", "decision_ns", "label_end_ns")
    )


def holdout_samples(samples: DataFrame, bounds: DataFrame) -> DataFrame:
    return samples.filter(F.col("decision_ns") >= bounds.select("holdout_start_ns").scalar())


def test_calendar(membership: DataFrame) -> DataFrame:
    """Test decisions of every fold, numbered in order inside the fold."""
    w = W.partitionBy("fold_index").orderBy("decision_ns")
    return (
        membership.filter(F.col("partition") == "test")
        .select("fold_index", "decision_ns")
        .withColumn("ordinal", F.row_number().over(w).cast("long"))
    )


def with_warm_up(calendar: DataFrame, weeks: int) -> DataFrame:
    """Extend each fold back by `weeks` decisions that only form state.

    Warm-up rows carry ``is_warm_up`` and ordinals of zero and below; nothing is
    reported for them.
    """
    base = calendar.withColumn("is_warm_up", F.lit(False))
    if weeks < 1:
        return base
    first = calendar.groupBy("fold_index").agg(F.min("decision_ns").alias("_first"))
    warm = first.withColumn("_back", F.explode(F.sequence(F.lit(1), F.lit(weeks)))).select(
        "fold_index",
        (F.col("_first") - F.col("_back") * F.lit(WEEK_NS)).alias("decision_ns"),
        (1 - F.col("_back")).cast("long").alias("ordinal"),
        F.lit(True).alias("is_warm_up"),
    )
    return base.unionByName(warm)


def chronological_split(df: DataFrame, group: list[str], order: str, *, name: str = "half", ties: tuple[str, ...] = ()) -> DataFrame:
    """First half (n div 2 rows) versus the rest, in `order` and then by `ties`, per group.

    Positions are counted week by week of `order`, so no group is sorted in one task.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"))
    placed = skewsafe.with_ordinal(df, group, [order, *ties], int_div(F.col(order), WEEK_NS), "_position")
    half = F.when(F.col("_position") <= int_div(F.col("_n"), 2), "calibration").otherwise("selection")
    return placed.join(sizes, group).withColumn(name, half).drop("_n", "_position")


def chronology_violations(df: DataFrame, keys: list[str], order: str, identifier: str) -> DataFrame:
    """Rows whose order value repeats within a key, and identifiers that repeat.

    Both are plain counts by value, so no key is ever sorted as a whole.
    """
    repeated_times = df.groupBy(*keys, order).agg((F.count("*") - 1).alias("_extra")).groupBy(*keys).agg(
        F.sum("_extra").alias("repeated_times")
    )
    repeated_ids = df.groupBy(*keys, identifier).agg((F.count("*") - 1).alias("_extra")).groupBy(*keys).agg(
        F.sum("_extra").alias("repeated_ids")
    )
    return repeated_times.join(repeated_ids, keys)
