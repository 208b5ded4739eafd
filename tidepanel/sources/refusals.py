"""What decoders refuse, with the reason, so that no payload is dropped without a trace.

Each function takes the rows of a decoder of `payloads`, sound ones included, and
returns those it marked `malformed`. Nothing is shuffled but for `recovered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDLE_FIELDS = ("open_time_ns", "open", "high", "low", "close", "base_volume", "quote_volume")
PREMIUM_FIELDS = ("mark_price", "index_price", "last_funding_rate", "next_funding_ms")
TICKER_FIELDS = ("bid_price", "bid_qty", "ask_price", "ask_qty")


def first_missing(names: Sequence[str], otherwise: str) -> Column:
    """The first of the fields that is missing or did not parse."""
    return F.coalesce(*(F.when(F.col(name).isNull(), F.lit(name)) for name in names), F.lit(otherwise))


def refused_fields(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(*keys, reason): the field at fault, or `shape` where all parse and the row or its page is at fault."""
    return rows.where("malformed").select(*keys, first_missing(fields, "shape").alias("reason"))


def _unsound(side: Column) -> Column:
    broken = F.exists(side, lambda level: ~F.coalesce((level["price"] > 0) & (level["quantity"] >= 0), F.lit(False)))
    return F.coalesce(broken, F.lit(True))


def refused_books(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, reason): `bids` or `asks`, the first side that is missing or holds a broken level, else `header`."""
    reason = F.when(_unsound(F.col("bids")), "bids").when(_unsound(F.col("asks")), "asks").otherwise("header")
    return rows.where("malformed").select(*keys, reason.alias("reason"))


def recovered(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(*keys, reason, copies, recovered): refused rows of overlapping pages, and whether some page has a sound row of the same keys.

    Rows whose keys did not parse are kept under null keys, which nothing recovers.
    """
    reason = first_missing(fields, "shape")
    told = rows.withColumn("reason", F.when(F.col("malformed"), reason)).groupBy(*keys, "reason").agg(F.count("*").alias("copies"))
    refused = told.where("reason IS NOT NULL")
    sound = told.where("reason IS NULL").select(*keys, F.lit(True).alias("_sound"))
    return refused.join(sound, list(keys), "left").withColumn("recovered", F.coalesce("_sound", F.lit(False))).drop("_sound")
