"""Depth-of-book measurement in long form: one row per book, side and level."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.operators import skewsafe

TIER_MINIMUM_CONTRIBUTORS = 4
QUANTILES = {"p50": Decimal("0.50"), "p90": Decimal("0.90"), "p99": Decimal("0.99")}
# The ranks measured in each tier.
TIER_ONE_RANKS = tuple(range(1, 9))
TIER_TWO_RANKS = (9, 12, 15, 19, 23, 27, 31, 35)


def _checked(levels: DataFrame) -> DataFrame:
    """Levels with the price of the better neighbour on their side; rows stay with their book."""
    inside = W.partitionBy("book_id").orderBy("side", "level")
    same = F.lag("side").over(inside) == F.col("side")
    better = F.when(same, F.lag("price").over(inside))
    worse = F.when(F.col("side") == "bid", F.col("price") >= better).otherwise(F.col("price") <= better)
    return levels.withColumn("_unsorted", F.coalesce(worse, F.lit(False)))


def _book_columns() -> dict[str, Column]:
    """Aggregates of one book, over checked levels."""
    side = lambda s, c: F.when(F.col("side") == s, c)
    on = lambda s: F.col("side") == s
    bad = (F.col("price") <= 0) | (F.col("quantity") <= 0)
    top = F.col("level") == 1
    return {
        "best_bid": F.max(F.when(on("bid") & top, F.col("price"))), "best_ask": F.max(F.when(on("ask") & top, F.col("price"))),
        "bid_levels": F.count_if(on("bid")), "ask_levels": F.count_if(on("ask")),
        "_bid_notional": F.sum(side("bid", F.col("price") * F.col("quantity"))),
        "_ask_notional": F.sum(side("ask", F.col("price") * F.col("quantity"))),
        **{f"_{s}_bad": F.bool_or(on(s) & bad) for s in ("bid", "ask")},
        **{f"_{s}_unsorted": F.bool_or(on(s) & F.col("_unsorted")) for s in ("bid", "ask")},
    }


BOOK = ("book_id", "instrument_id", "market", "tier", "received_time_ns")


def validate_books(levels: DataFrame) -> DataFrame:
    """One row per book: the reason it is unusable (NULL when valid), and its tops."""
    return _judged(_checked(levels).groupBy(*BOOK).agg(*[c.alias(n) for n, c in _book_columns().items()]))


def _judged(book: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("_bid_bad"), "BIDS_NOT_POSITIVE")
        .when(F.col("_bid_unsorted"), "BIDS_UNSORTED")
        .when(F.col("_ask_bad"), "ASKS_NOT_POSITIVE")
        .when(F.col("_ask_unsorted"), "ASKS_UNSORTED")
        .when((F.col("bid_levels") == 0) | (F.col("ask_levels") == 0), "BOOK_EMPTY")
        .when(F.col("best_bid") >= F.col("best_ask"), "BOOK_CROSSED")
    )
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    return book.withColumn("reason", reason).withColumns(
        {
            "mid": F.when(F.col("reason").isNull(), mid),
            "spread_bps": F.when(
                F.col("reason").isNull(), F.bround((F.col("best_ask") - F.col("best_bid")) / mid * 10_000.0, 6)
            ),
            "displayed_notional": F.when(
                F.col("reason").isNull(), F.bround(F.least("_bid_notional", "_ask_notional"), 2)
            ),
        }
    ).drop("_bid_notional", "_ask_notional", "_bid_bad", "_ask_bad", "_bid_unsorted", "_ask_unsorted")


def _filled(levels: DataFrame) -> DataFrame:
    """Levels with quote value and base quantity up to and with each of them."""
    quote = F.col("price") * F.col("quantity")
    along = W.partitionBy("book_id", "side").orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    return levels.withColumns({"_quote": F.sum(quote).over(along), "_base": F.sum("quantity").over(along)})


def _vwap(notional: Column) -> tuple[Column, Column]:
    """Whether a level is the last one that filling the notional touches, and the price paid then."""
    before = F.col("_quote") - F.col("price") * F.col("quantity")
    touched = (notional > before) & (notional <= F.col("_quote"))
    return touched, notional / (F.col("_base") - F.col("quantity") + (notional - before) / F.col("price"))


def fill_prices(levels: DataFrame, notionals: Sequence[float]) -> DataFrame:
    """VWAP of filling each notional from each side; an unfillable one has no row.

    With running totals along the levels, the last level touched is the single
    one whose cumulative quote value first reaches the notional.
    """
    wanted = F.array(*[F.lit(float(n)) for n in notionals])
    asked = _filled(levels).withColumn("notional", F.explode(wanted))
    touched, price = _vwap(F.col("notional"))
    return asked.filter(touched).select("book_id", "side", "notional", price.alias("vwap"))


def depth_observations(levels: DataFrame, notionals: Sequence[float]) -> DataFrame:
    """Slippage per side of every valid book and notional, NULL where too thin.

    Checks, tops and fills are aggregates of one grouping by book, so the levels
    are shuffled once at most.
    """
    fills = {}
    for i, n in enumerate(notionals):
        touched, price = _vwap(F.lit(float(n)))
        for side, name in (("ask", "buy"), ("bid", "sell")):
            fills[f"_{name}_{i}"] = F.max(F.when((F.col("side") == side) & touched, price))
    rows = _checked(_filled(levels)).groupBy(*BOOK).agg(*[c.alias(n) for n, c in {**_book_columns(), **fills}.items()])
    valid = _judged(rows).filter(F.col("reason").isNull())
    asked = F.array(*[F.struct(F.lit(float(n)).alias("notional"), F.col(f"_buy_{i}").alias("buy"), F.col(f"_sell_{i}").alias("sell"))
                      for i, n in enumerate(notionals)])
    out = valid.withColumn("_asked", F.explode(asked)).drop(*fills)
    worse = F.greatest(F.col("_asked.buy") / F.col("mid") - 1, 1 - F.col("_asked.sell") / F.col("mid")) * 10_000.0
    both = F.col("_asked.buy").isNotNull() & F.col("_asked.sell").isNotNull()
    return out.withColumns({"notional": F.col("_asked.notional"), "slippage_bps": F.when(both, F.bround(worse, 6))}).drop("_asked")


def instrument_statistics(observations: DataFrame, *, minimum: int, minimum_span_ns: int, eligibility_notional: float) -> DataFrame:
    """Counts, thin counts and exact quantiles per instrument and notional."""
    keys = ["instrument_id", "market", "tier", "notional"]
    counts = observations.groupBy(*keys).agg(
        F.count("slippage_bps").alias("count"), F.count_if(F.col("slippage_bps").isNull()).alias("insufficient_depth")
    )
    ranked = skewsafe.exact_quantiles(observations, keys, "slippage_bps", list(QUANTILES.values()))
    pick = lambda q: F.max(F.when(F.col("quantile") == F.lit(q).cast("decimal(6,4)"), F.col("value")))
    wide = ranked.groupBy(*keys).agg(*[pick(q).alias(n) for n, q in QUANTILES.items()])
    measured = observations.filter((F.col("notional") == eligibility_notional) & F.col("slippage_bps").isNotNull())
    spans = measured.groupBy("instrument_id", "market", "tier").agg(
        F.count("*").alias("_n"), (F.max("received_time_ns") - F.min("received_time_ns")).alias("span_ns")
    )
    eligible = (F.coalesce("_n", F.lit(0)) >= minimum) & (F.coalesce("span_ns", F.lit(-1)) >= minimum_span_ns)
    return (
        counts.join(wide, keys, "left").join(spans, ["instrument_id", "market", "tier"], "left")
        .withColumn("eligible", eligible).drop("_n")
    )


def tier_medians(statistics: DataFrame, *, floor: int = TIER_MINIMUM_CONTRIBUTORS) -> DataFrame:
    """Medians of eligible members' p50 and p90, withheld below `floor` contributors."""
    keys = ["tier", "market", "notional"]
    nearest = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")
    members = statistics.filter("eligible")
    return members.groupBy(*keys).agg(
        F.count("*").alias("members"), F.count("p50").alias("contributing"),
        F.when(F.count("p50") >= floor, nearest("p50")).alias("p50_of_p50"),
        F.when(F.count("p90") >= floor, nearest("p90")).alias("p50_of_p90"),
    )


def measured_cost_tiers(medians: DataFrame, *, order_notional: float) -> DataFrame:
    """Whole-bps base and adverse slippage per tier: the worse market's median.

    Base reads the smallest measured notional that fits the order, adverse ten
    times that notional.
    """
    base = medians.filter(F.col("notional") >= order_notional).select(F.min("notional")).scalar()
    rung = lambda n, c: F.max(F.when(F.col("notional") == n, F.col(c)))
    marked = medians.withColumn("_base", base)
    return marked.groupBy("tier").agg(
        F.ceil(rung(F.col("_base"), "p50_of_p50")).alias("base_bps"),
        F.ceil(rung(F.col("_base") * 10, "p50_of_p90")).alias("adverse_bps"),
    )


def stratified_sample(pairs: DataFrame) -> DataFrame:
    """Both legs of the declared ranks: the top eight, then every few below."""
    tier = F.when(F.col("liquidity_rank").isin(*TIER_ONE_RANKS), 1).when(F.col("liquidity_rank").isin(*TIER_TWO_RANKS), 2)
    legs = F.array(
        F.struct(F.lit("spot").alias("market"), F.col("spot_contract").alias("contract_id")),
        F.struct(F.lit("perp").alias("market"), F.col("perp_contract").alias("contract_id")),
    )
    return (
        pairs.withColumn("sample_tier", tier).filter(F.col("sample_tier").isNotNull())
        .withColumn("_leg", F.explode(legs)).select("decision_ns", "sample_tier", "liquidity_rank", "_leg.*")
    )
