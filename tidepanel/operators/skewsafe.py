"""Ordered operators over raw event tables where one key may hold most rows.

A window partitioned by such a key would sort the key's whole history in one
task. The helpers here cut each key into coarse, order-preserving buckets, do
the ordered work inside ``(key, bucket)`` and carry one summary row per bucket
across. Results are exact; only the per-bucket summaries are ever windowed by
the bare key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BUCKET = "_bucket"
# Slots a key's value range is cut into before an exact quantile is picked, and values drawn per cut between them.
_QUANTILE_SLOTS, _DRAWS = 64, 16


def even_bucket(df: DataFrame, column: str, buckets: int = 4_096) -> Column:
    """Equal-width buckets over a column's range, a fixed number of them.

    The count of per-bucket summaries stays the same however large the table
    grows. Minimum and maximum come from a scalar subquery over one column.
    """
    edges = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("e")).select("e").scalar()
    width = (edges["high"] - edges["low"] + 1) / F.lit(buckets)
    return F.floor((F.col(column) - edges["low"]) / width)


def with_ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "ordinal"
) -> DataFrame:
    """The 1-based position of each row within its key, in `order`.

    `bucket` must not decrease along `order`.
    """
    rows = df.withColumn(_BUCKET, bucket)
    earlier = W.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, _BUCKET)
        .agg(F.count("*").alias("_rows"))
        .select(*keys, _BUCKET, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = W.partitionBy(*keys, _BUCKET).orderBy(*order)
    return (
        rows.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, _BUCKET])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop(_BUCKET, "_offset", "_local")
    )


def with_halo(
    df: DataFrame, ordinal: str, *, chunk_rows: int, before: int = 0, after: int = 0
) -> DataFrame:
    """Copy rows into neighbouring chunks so that row frames never cross a chunk.

    Adds ``chunk`` and ``is_home``. A frame reaching at most `before` rows back
    and `after` rows forward, windowed by ``(key, chunk)``, is exact on the
    rows where ``is_home`` holds; the others are the halo and are to be dropped.
    """
    position = F.col(ordinal)
    first = F.floor((position - F.lit(after)) / F.lit(chunk_rows))
    last = F.floor((position + F.lit(before)) / F.lit(chunk_rows))
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn(
        "is_home", F.col("chunk") == F.floor(position / F.lit(chunk_rows))
    )


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column,
    name: str,
    *,
    direction: str = "last",
    inclusive: bool = True,
) -> DataFrame:
    """The last (or next) non-NULL `value` along `order`, within each key.

    ``direction="next"`` looks ahead instead of back; `inclusive` decides
    whether the row itself counts.
    """
    forward = direction == "next"
    turn = F.desc if forward else F.asc
    pick = F.min if forward else F.max
    rows = df.withColumn(_BUCKET, bucket).withColumn("_value", value)
    stamp = F.struct(*[F.col(c) for c in order], F.col("_value").alias("_value"))
    summary = rows.groupBy(*keys, _BUCKET).agg(
        pick(F.when(F.col("_value").isNotNull(), stamp)).alias("_edge")
    )
    across = W.partitionBy(*keys).orderBy(turn(_BUCKET)).rowsBetween(W.unboundedPreceding, -1)
    edges = summary.select(
        *keys, _BUCKET, F.last("_edge", ignorenulls=True).over(across).alias("_carried")
    )
    local = (
        W.partitionBy(*keys, _BUCKET)
        .orderBy(*[turn(c) for c in order])
        .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        rows.withColumn("_near", F.last("_value", ignorenulls=True).over(local))
        .join(edges, [*keys, _BUCKET])
        .withColumn(name, F.coalesce("_near", F.col("_carried._value")))
        .drop(_BUCKET, "_value", "_near", "_carried")
    )


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
    values: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums along `order` within each key, one per named value."""
    rows = df.withColumn(_BUCKET, bucket).withColumns({f"_v_{n}": v for n, v in values.items()})
    earlier = W.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, _BUCKET)
        .agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
        .select(
            *keys, _BUCKET,
            *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values],
        )
    )
    local = W.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    near = {f"_v_{n}": F.sum(f"_v_{n}").over(local) for n in values}
    return (
        rows.withColumns(near)
        .join(offsets, [*keys, _BUCKET])
        .withColumns({n: F.col(f"_o_{n}") + F.col(f"_v_{n}") for n in values})
        .drop(_BUCKET, *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[Decimal]
) -> DataFrame:
    """Nearest-rank quantiles per key: the value at rank ``ceil(n * q)``.

    Returns long form: keys, ``quantile``, ``value``, ``row_count``.
    """
    def ranks(count: Column) -> Column:
        each = [F.lit(q).cast("decimal(6,4)") for q in quantiles]
        return F.array(*[F.struct(q.alias("label"), F.greatest(F.ceil(count * q), F.lit(1)).cast("long").alias("rank")) for q in each])

    return values_at_ranks(df, keys, value, ranks).withColumnRenamed("label", "quantile")


def slot_bounds(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, _bounds, row_count) of distinct values `_v` with counts `_n`; the same for every order and layout of the rows."""
    draw = F.xxhash64(*keys, "_v")
    lanes = counted.groupBy(*keys, F.pmod(draw, F.lit(_QUANTILE_SLOTS * _DRAWS)).alias("_lane")).agg(
        F.min(F.struct(draw.alias("h"), F.col("_v").alias("v"))).alias("_drawn"), F.sum("_n").alias("_lane_n")
    )
    drawn = F.array_sort(F.collect_list("_drawn.v"))
    return lanes.groupBy(*keys).agg(
        F.filter(drawn, lambda _, i: F.pmod(i, F.lit(_DRAWS)) == _DRAWS - 1).alias("_bounds"), F.sum("_lane_n").alias("row_count")
    )


def values_at_ranks(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[Column], Column]
) -> DataFrame:
    """Values at given ranks per key; `ranks` maps a row count to an array of (label, rank) structs, ranks from 1.

    Equal values are counted before anything is shuffled by key. The slot
    boundaries are every 16th of up to 1,024 values drawn by hash; the slot
    holding the target rank is then ranked exactly, so no task orders more than
    a slot of a hot key. The slots are asked for twice, and the draw is the same
    however its rows arrive, which that of an approximate sketch is not.
    Returns long form: keys, ``label``, ``value``, ``row_count``.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    bounds = slot_bounds(counted, keys)
    slotted = counted.join(bounds, list(keys)).withColumn(
        "_slot", F.size(F.filter("_bounds", lambda b: b < F.col("_v")))
    ).drop("_bounds")
    earlier = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    slots = (
        slotted.groupBy(*keys, "_slot", "row_count")
        .agg(F.sum("_n").alias("_slot_n"))
        .withColumn("_before", F.coalesce(F.sum("_slot_n").over(earlier), F.lit(0)))
    )
    targets = (
        slots.withColumn("_wanted", F.explode(ranks(F.col("row_count"))))
        .withColumns({"label": F.col("_wanted.label"), "_rank": F.col("_wanted.rank")})
        .filter(
            (F.col("_rank") > F.col("_before"))
            & (F.col("_rank") <= F.col("_before") + F.col("_slot_n"))
        )
        .select(*keys, "_slot", "label", (F.col("_rank") - F.col("_before")).alias("_within"))
    )
    inside = W.partitionBy(*keys, "_slot", "label").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    return (
        slotted.join(targets, [*keys, "_slot"])
        .withColumn("_cum", F.sum("_n").over(inside))
        .filter(F.col("_cum") >= F.col("_within"))
        .groupBy(*keys, "label")
        .agg(F.min("_v").alias("value"), F.first("row_count").alias("row_count"))
    )
