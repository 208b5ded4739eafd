"""Pooling fold episodes into one retained series per member and scenario."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOOK = ("member", "scenario", "fold_index")


def pool_episodes(episodes: DataFrame, book: Sequence[str] = BOOK) -> DataFrame:
    """Fold held-nothing episodes into a retained neighbour of the same fold.

    Their cost rolls forward onto the next retained episode, or back onto the
    last one when none follows. Counting retained rows from the end gives both
    in one step: every row joins the island of the retained row it counts, and
    a zero count joins island one, the last. A fold that retained nothing has
    no row to roll onto and contributes only to totals.
    """
    cell = W.partitionBy(*book)
    backwards = cell.orderBy(F.desc("ordinal")).rowsBetween(W.unboundedPreceding, 0)
    retained = (~F.col("held_nothing")).cast("long")
    kept = F.when(~F.col("held_nothing"), F.col("decision_ns"))
    return (
        episodes.withColumn("_after", F.sum(retained).over(backwards))
        .withColumn("_kept", F.sum(retained).over(cell))
        .filter(F.col("_kept") > 0)
        .groupBy(*book, F.greatest(F.col("_after"), F.lit(1)).alias("_island"))
        .agg(
            F.max(kept).alias("decision_ns"),
            F.sum("net_return").alias("net_return"),
            F.sum("turnover").alias("turnover"),
            F.max(F.when(kept.isNotNull(), F.col("gross_exposure"))).alias("gross_exposure"),
            F.max(F.when(kept.isNotNull(), F.col("net_exposure"))).alias("net_exposure"),
        )
        .drop("_island")
    )


def fold_totals(episodes: DataFrame) -> DataFrame:
    """Per member, scenario and fold: the raw total, retained and held-nothing counts."""
    return episodes.groupBy(*BOOK).agg(
        F.sum("net_return").alias("fold_total"),
        F.count_if(~F.col("held_nothing")).alias("retained"),
        F.count_if("held_nothing").alias("held_nothing"),
        F.sum("forced_close_count").alias("forced_close_count"),
    )


def concentration(pooled: DataFrame, totals: DataFrame, lines: DataFrame) -> DataFrame:
    """Largest fold, contract and episode share of a positive base total."""
    by_fold = totals.filter(F.col("scenario") == "base").groupBy("member").agg(
        F.sum("fold_total").alias("base_total"), F.max("fold_total").alias("_fold")
    )
    by_contract = (
        lines.filter(F.col("scenario") == "base").groupBy("member", "contract_id")
        .agg(F.sum("net").alias("_net")).groupBy("member").agg(F.max("_net").alias("_contract"))
    )
    by_episode = pooled.filter(F.col("scenario") == "base").groupBy("member").agg(
        F.max("net_return").alias("_episode")
    )
    share = lambda c: F.when(F.col("base_total") > 0, F.coalesce(c, F.lit(0.0)) / F.col("base_total"))
    return by_fold.join(by_contract, "member", "left").join(by_episode, "member", "left").select(
        "member", "base_total",
        share(F.col("_fold")).alias("largest_fold_share"),
        share(F.col("_contract")).alias("largest_contract_share"),
        share(F.col("_episode")).alias("largest_episode_share"),
    )
