"""Model samples and labels from bars and ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.timefns import int_div
from tidepanel.operators import skewsafe


def _change(later: Column, earlier: Column) -> Column:
    """Relative change; NULL against a zero price, which measures nothing."""
    return F.try_divide(later, earlier) - 1


def bar_samples(primary: DataFrame, reference: DataFrame, *, horizon: int = 1) -> DataFrame:
    """Lag / lead samples per instrument with a guarded cross-venue basis.

    The reference bar of the same open time counts only if it was available no
    later than the primary bar. Bars are calendar-bounded per instrument.
    """
    w = W.partitionBy("instrument_id").orderBy("open_time_ns")
    other = reference.select(
        "open_time_ns",
        F.col("close").alias("_ref_close"),
        F.col("available_time_ns").alias("_ref_available"),
        F.col("source_id").alias("_ref_id"),
    )
    usable = F.col("_ref_available") <= F.col("available_time_ns")
    suffix = F.lit("") if horizon == 1 else F.lit(f":h{horizon}")
    inputs = F.array_compact(
        F.array(F.col("_prev_id"), F.col("source_id"), F.when(usable, F.col("_ref_id")))
    )
    return (
        primary.withColumns(
            {
                "_prev_close": F.lag("close").over(w),
                "_prev_volume": F.lag("base_volume").over(w),
                "_prev_id": F.lag("source_id").over(w),
                "_next_close": F.lead("close", horizon).over(w),
                "label_available_ns": F.lead("available_time_ns", horizon).over(w),
            }
        )
        .filter(F.col("_prev_close").isNotNull() & F.col("_next_close").isNotNull())
        .join(other, "open_time_ns", "left")
        .select(
            "instrument_id",
            F.concat(F.col("instrument_id"), F.lit(":"), F.col("open_time_ns").cast("string"), suffix).alias("sample_id"),
            F.col("available_time_ns").alias("decision_ns"),
            "label_available_ns",
            inputs.alias("input_ids"),
            _change(F.col("close"), F.col("_prev_close")).alias("observed_return"),
            (F.try_divide(F.col("high") - F.col("low"), F.col("close")) * 10_000.0).alias("range_bps"),
            F.when(F.col("_prev_volume") > 0, F.col("base_volume") / F.col("_prev_volume") - 1).alias("volume_change"),
            F.when(usable, _change(F.col("close"), F.col("_ref_close"))).alias("cross_basis"),
            _change(F.col("_next_close"), F.col("close")).alias("forward_return"),
        )
        .filter(F.col("observed_return").isNotNull() & F.col("forward_return").isNotNull())
    )


def forward_labels(
    points: DataFrame, *, horizon_ns: int, round_trip_cost_bps: float, bucket_ns: int
) -> DataFrame:
    """Label each point with the first price at or after its time plus the horizon.

    A forward as-of join on raw ticks: targets and prices are merged in one
    ordered stream per instrument, and the next price is carried back bucket by
    bucket, so a dominant instrument is spread over its time buckets.
    """
    keys = ["instrument_id"]
    outcome = F.struct("event_id", "event_time_ns", "available_time_ns", "price")
    # A target sorts before a price of the same instant, which it may use.
    asked = points.select(
        *keys, (F.col("event_time_ns") + F.lit(horizon_ns)).alias("_t"), F.lit(0).alias("_kind"),
        F.col("event_id").alias("_id"), outcome.alias("_source"),
        F.lit(None).cast(points.select(outcome.alias("o")).schema["o"].dataType).alias("_point"),
    )
    known = points.select(
        *keys, F.col("event_time_ns").alias("_t"), F.lit(1).alias("_kind"), F.col("event_id").alias("_id"),
        F.lit(None).cast(points.select(outcome.alias("o")).schema["o"].dataType).alias("_source"),
        outcome.alias("_point"),
    )
    matched = skewsafe.carry(
        asked.unionByName(known), keys, ["_t", "_kind", "_id"], int_div(F.col("_t"), bucket_ns),
        F.col("_point"), "_outcome", direction="next",
    ).filter((F.col("_kind") == 0) & F.col("_outcome").isNotNull())
    cost = round_trip_cost_bps / 10_000.0
    gross = _change(F.col("_outcome.price"), F.col("_source.price"))
    labels = matched.select(
        *keys,
        F.col("_source.event_id").alias("source_event_id"),
        F.col("_outcome.event_id").alias("outcome_event_id"),
        F.col("_source.event_time_ns").alias("label_start_ns"),
        F.col("_outcome.event_time_ns").alias("label_end_ns"),
        F.col("_outcome.available_time_ns").alias("label_available_ns"),
        gross.alias("gross_return"),
        (gross - F.lit(cost)).alias("net_return"),
        F.when(gross > cost, 1).when(gross < -cost, -1).when(gross.isNotNull(), 0).alias("direction"),
    )
    return with_overlap(labels, keys, bucket_ns)


def with_overlap(labels: DataFrame, keys: list[str], bucket_ns: int) -> DataFrame:
    """Flag a label whose interval is still open when the next label starts."""
    following = skewsafe.carry(
        labels, keys, ["label_start_ns", "source_event_id"], int_div(F.col("label_start_ns"), bucket_ns),
        F.col("label_start_ns"), "_next_start", direction="next", inclusive=False,
    )
    overlap = F.coalesce(F.col("_next_start") < F.col("label_end_ns"), F.lit(False))
    return following.withColumn("overlaps_next", overlap).drop("_next_start")


def imbalance(positive: Column, negative: Column) -> Column:
    """`(a - b) / (a + b)`; NULL when there is nothing on either side."""
    total = positive + negative
    return F.when(total != 0, (positive - negative) / total)


def point_in_time_features(
    states: DataFrame, *, keys: list[str], lookback: int, max_feed_age_ns: int, bucket: Column,
    chunk_rows: int = 4_096,
) -> DataFrame:
    """Return, realised volatility, lineage and availability over trailing rows.

    Rows are numbered once, cut into chunks with a halo of `lookback` rows, and
    all row frames run inside a chunk; see `skewsafe.with_halo`.
    """
    numbered = skewsafe.with_ordinal(states, keys, ["decision_ns", "event_id"], bucket)
    w = W.partitionBy(*keys, "chunk").orderBy("ordinal")
    recent = w.rowsBetween(-(lookback - 1), 0)
    healthy = F.col("book_valid") & (F.col("feed_age_ns") <= F.lit(max_feed_age_ns))
    mean_square = F.avg(F.col("simple_return") * F.col("simple_return")).over(recent)
    # The halo holds one row more than the frame: the first return needs it.
    haloed = skewsafe.with_halo(numbered, "ordinal", chunk_rows=chunk_rows, before=lookback)
    return (
        haloed.withColumn("simple_return", _change(F.col("mid_price"), F.lag("mid_price").over(w)))
        .withColumns(
            {
                "realized_volatility": F.sqrt(mean_square),
                "input_event_ids": F.collect_list("event_id").over(recent),
                "input_available_ns": F.max("available_time_ns").over(recent),
                "feed_healthy": healthy,
                "spread_bps": F.when(
                    healthy, F.try_divide(F.col("best_ask") - F.col("best_bid"), F.col("mid_price")) * 10_000.0
                ),
                "book_imbalance": F.when(healthy, imbalance(F.col("bid_size"), F.col("ask_size"))),
                "trade_flow_imbalance": imbalance(F.col("buy_quantity"), F.col("sell_quantity")),
            }
        )
        .filter("is_home")
        .drop("chunk", "is_home")
    )


def lookahead_violations(rows: DataFrame, available: str, decision: str) -> DataFrame:
    """How many inputs became available only after the decision that used them."""
    late = F.col(available) > F.col(decision)
    return rows.agg(F.count("*").alias("rows"), F.count_if(late).alias("violations"))
