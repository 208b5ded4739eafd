"""Polled endpoints: merges by round, means over a window, health of the newest rounds, receipts behind a chain check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.operators import chain


def last_of_round(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One reading per key and round: the last in `order`; NULL values stay."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def merge_rounds(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readings of two endpoints by key and round; `origin` tells a round that one of them lacks."""
    here, there = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    origin = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return here.join(there, list(keys), "full_outer").withColumn("origin", origin).drop("_l", "_r")


def symbol_means(merged: DataFrame, symbol: str, round_: str) -> DataFrame:
    """Per symbol what each endpoint measured; a symbol that one of them never had has no means of it."""
    of = lambda name: F.count_if(F.col("origin") != name)
    left = F.when(F.col("origin") != "right_only", F.col(round_))
    return merged.groupBy(symbol).agg(
        of("right_only").alias("premium_rounds"), of("left_only").alias("book_rounds"), F.count_if(F.col("origin") == "both").alias("shared_rounds"),
        F.avg("rate").alias("mean_rate"), F.max_by("rate", left).alias("last_rate"),
        F.avg("basis_bps").alias("mean_basis_bps"), F.avg("spread_bps").alias("mean_spread_bps"),
    )


def share(part: Column, whole: Column) -> Column:
    """A count over a count; nothing over nothing is zero."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def endpoint_health(segments: DataFrame, journal: str, endpoints: Sequence[str], *, last: int, every: int) -> DataFrame:
    """Health of each endpoint over the newest `last` segments of a journal.

    Segments carry `failures` (texts that begin with the endpoint and a colon),
    `excluded` (symbols left out, by endpoint), `depth_asked` and `depth_failed`.
    Failures are a rate over rounds that asked all endpoints, every `every`-th
    sequence, whether or not they answered; without such a round the rate is
    zero. The depth rate is over all rounds.
    """
    newest = W.partitionBy(journal).orderBy(F.desc("sequence"))
    recent = segments.withColumn("_rk", F.row_number().over(newest)).filter(F.col("_rk") <= last)
    failed = lambda e: F.size(F.filter("failures", lambda f: f.startswith(f"{e}:")))
    told = recent.groupBy(journal).agg(
        F.count("*").alias("rounds"), F.count_if(F.col("sequence") % every == 0).alias("snapshot_rounds"),
        F.max("sequence").alias("last_sequence"), F.max("received_time_ns").alias("newest_ns"),
        share(F.sum("depth_failed"), F.sum("depth_asked")).alias("depth_failure_rate"),
        *[F.struct(F.lit(e).alias("endpoint"), F.sum(failed(e)).alias("failures"),
                   F.sum(F.coalesce(F.element_at("excluded", e), F.lit(0))).alias("excluded_total")).alias(f"_e{i}") for i, e in enumerate(endpoints)],
    )
    each = told.withColumn("_e", F.explode(F.array(*[F.col(f"_e{i}") for i in range(len(endpoints))])))
    return each.select(
        journal, "_e.endpoint", "rounds", "snapshot_rounds", "_e.failures", share(F.col("_e.failures"), F.col("snapshot_rounds")).alias("failure_rate"),
        "_e.excluded_total", "depth_failure_rate", "last_sequence", "newest_ns")


def gated_receipt(records: DataFrame, recomputed: Column, figures: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Figures of each chain, sealed where every record verifies; a chain with a fault is refused and has none.

    `figures` has a row per `chain_id`; a chain without figures is told too.
    """
    faults = F.size("reasons") > 0
    verdict = chain.chain_reasons(records, recomputed).groupBy("chain_id").agg(
        F.count("*").alias("segments"), F.count_if(faults).alias("faulty_segments"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))), ",").alias("reasons"))
    sound = F.col("faulty_segments") == 0
    status = F.when(~sound, "refused").when(F.col("_there").isNull(), "nothing_measured").otherwise("sealed")
    return verdict.join(figures.withColumn("_there", F.lit(True)), "chain_id", "left").select(
        "chain_id", status.alias("status"), "segments", "faulty_segments", "reasons", *[F.when(sound, F.col(c)).alias(c) for c in columns])
