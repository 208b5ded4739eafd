"""Hash-chain verification without walking the chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO_HASH = "0" * 64


def chain_reasons(rows: DataFrame, recomputed: Column, *, first: int = 1) -> DataFrame:
    """Everything one record can be wrong about, given its predecessor.

    The predecessor comes from an equi self-join on ``sequence = previous + 1``,
    so a chain of any length verifies in parallel.
    """
    before = rows.select(
        "chain_id", (F.col("sequence") + 1).alias("sequence"), F.col("content_hash").alias("_linked"),
    )
    joined = rows.join(before, ["chain_id", "sequence"], "left")
    start = F.col("sequence") == first
    return joined.withColumn(
        "reasons",
        F.array_compact(
            F.array(
                F.when(recomputed != F.col("content_hash"), "SEGMENT_HASH_MISMATCH"),
                F.when(F.col("_linked").isNull() & ~start, "SEGMENT_SEQUENCE_GAP"),
                F.when(
                    F.col("previous_hash") != F.coalesce("_linked", F.when(start, F.lit(ZERO_HASH))),
                    "CHAIN_LINK_BROKEN",
                ),
            )
        ),
    ).drop("_linked")


def implied_heads(rows: DataFrame) -> DataFrame:
    """What a chain's records say its head should be."""
    return rows.groupBy("chain_id").agg(
        F.count("*").alias("segment_count"), F.max("sequence").alias("last_sequence"),
        F.max_by("content_hash", "sequence").alias("final_hash"),
    )


def head_mismatches(heads: DataFrame, implied: DataFrame) -> DataFrame:
    """Recorded chain heads against implied ones, field by field."""
    fields = ["segment_count", "last_sequence", "final_hash"]
    right = implied.select("chain_id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    left = heads.withColumn("_here", F.lit(True))
    differs = F.array_compact(
        F.array(*[F.when(F.col(f) != F.col(f"_{f}"), F.lit(f"CHAIN_HEAD_MISMATCH:{f}")) for f in fields])
    )
    reasons = (
        F.when(F.col("_here").isNull(), F.array(F.lit("CHAIN_HEAD_MISSING")))
        .when(F.col("_there").isNull(), F.array(F.lit("CHAIN_HEAD_UNEXPECTED")))
        .otherwise(differs)
    )
    return left.join(right, "chain_id", "full_outer").select("chain_id", reasons.alias("reasons"))


def window_anchor(rows: DataFrame, start_ns: int | Column, end_ns: int | Column) -> DataFrame:
    """Per chain, the last record before a window: what the window must link to."""
    outside = F.col("received_time_ns") < start_ns
    inside = F.col("received_time_ns").between(start_ns, end_ns)
    return rows.groupBy("chain_id").agg(
        F.max(F.when(outside, F.col("sequence"))).alias("anchor_sequence"),
        F.max_by(F.when(outside, F.col("content_hash")), F.when(outside, F.col("sequence"))).alias("anchor_hash"),
        F.min(F.when(inside, F.col("sequence"))).alias("first_sequence"),
        F.min_by(F.when(inside, F.col("previous_hash")), F.when(inside, F.col("sequence"))).alias("first_link"),
        F.count_if(inside).alias("segments"),
    )
