"""Views over the given tables; `sqlviews` holds the same definitions as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.timefns import DAY_NS, HOUR_NS, SECOND_NS, int_div, timestamp_to_ns
from tidepanel.operators import skewsafe

VENUE = "XV"
LINE_KEY = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
]


def named_contracts(daily: DataFrame, *labels: str) -> DataFrame:
    """Contract ids `label:first_open`. The daily rows of a label are bounded by
    the calendar, so a window finds the first open without a second raw scan."""
    first = F.min("open_time_ns").over(W.partitionBy(*labels))
    return daily.withColumn("contract_id", F.concat_ws(":", *labels, first.cast("string")))


class Tables:
    """The given tables of one directory and the market-style views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def pieces(self, name: str, rows: int = 250_000) -> int:
        """Partitions for a shuffle of a table, so that a task's share stays the same as the table grows; reads footers only."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.read(name).count() // rows))

    @cached_property
    def lines(self) -> DataFrame:
        """One priced trade per order line, with its instrument labels and day.

        `part` is joined without a hint: Catalyst broadcasts it when it is
        small enough, and AQE splits a hot part key when it is not.
        """
        item = self.read("lineitem").select(
            *LINE_KEY, "l_discount", F.unix_date(F.to_date("l_shipdate")).cast("long").alias("day"),
        )
        part = self.read("part").select("p_partkey", "p_type", "p_brand")
        return item.join(part, item.l_partkey == part.p_partkey).drop("p_partkey").withColumn(
            "price", F.col("l_extendedprice") / F.col("l_quantity")
        )

    def _daily(self, keys: dict[str, Column]) -> DataFrame:
        order = F.struct(*LINE_KEY)
        rows = self.lines.withColumns(keys)
        money = F.col("l_extendedprice").cast("decimal(18,2)")
        bars = rows.groupBy(*keys, "day").agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("l_quantity").alias("base_volume"),
            F.sum(money).cast("double").alias("quote_volume"),
            F.count("*").alias("trade_count"),
        )
        opened = F.col("day") * F.lit(DAY_NS)
        return bars.withColumns(
            {
                "open_time_ns": opened,
                "close_time_ns": opened + F.lit(DAY_NS),
                "available_time_ns": opened + F.lit(DAY_NS + 1),
                "interval_ns": F.lit(DAY_NS),
            }
        )

    def bars(self, instrument: str = "p_type") -> DataFrame:
        """Daily bars per instrument, from every order line."""
        daily = self._daily({"instrument_id": F.col(instrument)})
        return named_contracts(daily.withColumn("venue", F.lit(VENUE)), "instrument_id")

    def legs(self, instrument: str = "p_type") -> DataFrame:
        """Daily bars of two markets: odd line numbers trade `perp`, even ones `spot`."""
        market = F.when(F.col("l_linenumber") % 2 == 1, "perp").otherwise("spot")
        daily = self._daily({"instrument_id": F.col(instrument), "venue": market})
        return named_contracts(daily, "venue", "instrument_id")

    @cached_property
    def decisions(self) -> DataFrame:
        """Weekly decision closes seen anywhere in the panel; reads one column."""
        day = F.unix_date(F.to_date("l_shipdate")).cast("long")
        return (
            self.read("lineitem").select(day.alias("day")).filter(F.pmod("day", F.lit(7)) == 3)
            .select(((F.col("day") + 1) * F.lit(DAY_NS)).alias("decision_ns")).distinct()
        )

    def funding(self, instrument: str = "p_type") -> DataFrame:
        """Signed periodic payments: one per order line, spread over its day."""
        when = F.col("day") * F.lit(DAY_NS) + F.col("l_linenumber") * F.lit(3 * HOUR_NS)
        rate = ((F.col("l_discount").cast("decimal(10,4)") - F.lit("0.05").cast("decimal(10,4)"))
                / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,8)")
        return self.lines.select(
            F.col(instrument).alias("instrument_id"), when.alias("calc_time_ns"), rate.alias("rate"),
            *LINE_KEY,
        )

    @cached_property
    def book_levels(self) -> DataFrame:
        """One order book per order, a row per level; bids mirror the asks below them.

        Every 23rd order's bids arrive worst first, and every 29th order's are
        lifted above its asks, so validation has something to refuse. A book is
        bounded by the depth a venue sends, so one shuffle by book serves the
        levels here and everything measured on them. Windows sort what a task
        holds, so there are as many partitions as the table has pieces.
        """
        level = self.read("lineitem").select(
            "l_orderkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("ask"), "l_quantity"
        ).repartition(self.pieces("lineitem"), "l_orderkey").groupBy("l_orderkey", "ask").agg(F.sum("l_quantity").alias("quantity"))
        book = W.partitionBy("l_orderkey")
        ranked = level.withColumns({
            "level": F.row_number().over(book.orderBy("ask")).cast("long"),
            "best": F.min("ask").over(book), "levels": F.count("*").over(book),
        })
        key = F.col("l_orderkey")
        lift = F.when(key % 29 == 0, 1.5).otherwise(0.999)
        bid_level = F.when(key % 23 == 0, F.col("levels") + 1 - F.col("level")).otherwise(F.col("level"))
        sides = F.array(
            F.struct(F.lit("bid").alias("side"), bid_level.alias("level"),
                     (lift * F.col("best") * F.col("best") / F.col("ask")).alias("price")),
            F.struct(F.lit("ask").alias("side"), F.col("level"), F.col("ask").alias("price")),
        )
        return ranked.withColumn("_side", F.explode(sides)).select(
            key.alias("book_id"),
            F.concat(F.lit("I"), F.lpad((key % 12).cast("string"), 2, "0")).alias("instrument_id"),
            F.when(key % 2 == 0, "perp").otherwise("spot").alias("market"),
            F.when(key % 12 < 6, 1).otherwise(2).alias("tier"),
            (key * F.lit(61 * SECOND_NS)).alias("received_time_ns"),
            "_side.side", "_side.level", "_side.price", "quantity",
        )

    @cached_property
    def ticks(self) -> DataFrame:
        """Trades per instrument; quantity is the number in the JSON property."""
        stamp = timestamp_to_ns(F.col("ts"))
        return self.read("events").select(
            "event_id",
            "user_id",
            F.col("event_type").alias("instrument_id"),
            stamp.alias("event_time_ns"),
            (stamp + F.lit(SECOND_NS)).alias("available_time_ns"),
            F.col("value").alias("price"),
            F.get_json_object("props", "$.k").cast("double").alias("quantity"),
            F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        )

    @cached_property
    def chain(self) -> DataFrame:
        """A hash-linked record chain per user; every 29th event records a hash its content does not have."""
        rows = self.read("events").select(
            F.col("user_id").alias("chain_id"), "event_id", F.col("event_type").alias("kind"),
            timestamp_to_ns(F.col("ts")).alias("received_time_ns"),
            F.col("value").cast("decimal(18,4)").cast("string").alias("payload"),
        )
        bucket = skewsafe.even_bucket(self.read("events"), "event_id")
        numbered = skewsafe.with_ordinal(rows, ["chain_id"], ["event_id"], bucket, "sequence")
        honest = numbered.withColumn("true_hash", chain_hash())
        linked = honest.join(
            honest.select("chain_id", (F.col("sequence") + 1).alias("sequence"),
                          F.col("true_hash").alias("previous_hash")),
            ["chain_id", "sequence"], "left",
        ).withColumn("previous_hash", F.coalesce("previous_hash", F.lit("0" * 64)))
        recorded = F.when(F.col("event_id") % 29 == 0, F.sha2(F.lit("tampered"), 256)).otherwise(
            F.col("true_hash")
        )
        return linked.withColumn("content_hash", recorded).drop("true_hash")

    @property
    def broken_chain(self) -> DataFrame:
        """The chain with every 17th position lost, for queries that look for gaps."""
        return self.chain.filter(F.col("sequence") % 17 != 0)

    @cached_property
    def hour_bars(self) -> DataFrame:
        """Hourly bars per instrument; a busier hour is published a little later."""
        order = F.struct("event_time_ns", "event_id")
        bars = (
            self.ticks.withColumn("open_time_ns", int_div(F.col("event_time_ns"), HOUR_NS) * F.lit(HOUR_NS))
            .groupBy("instrument_id", "open_time_ns")
            .agg(
                F.min_by("price", order).alias("open"),
                F.max("price").alias("high"),
                F.min("price").alias("low"),
                F.max_by("price", order).alias("close"),
                F.sum("quantity").alias("base_volume"),
                F.count("*").alias("trade_count"),
            )
        )
        lag = F.pmod(F.col("trade_count"), F.lit(3)) * F.lit(SECOND_NS)
        return bars.withColumn("available_time_ns", F.col("open_time_ns") + F.lit(HOUR_NS) + lag).withColumn(
            "source_id", F.concat_ws(":", "instrument_id", F.col("open_time_ns").cast("string"))
        )


def chain_hash() -> Column:
    """SHA-256 over a chain row's identity and payload."""
    return F.sha2(
        F.concat_ws("|", F.col("chain_id").cast("string"), F.col("sequence").cast("string"), "kind", "payload"),
        256,
    )


