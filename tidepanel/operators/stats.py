"""Signal evaluation, dependence-aware uncertainty and multiple testing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.operators import skewsafe
from tidepanel.operators.weights import seeded_score

EULER_MASCHERONI = 0.5772156649015329
PROBABILITY_CLIP = 1e-15


@dataclass(frozen=True)
class SignalCost:
    """A turnover-cost scenario for single-position signals, in basis points."""

    scenario: str
    fee_bps: float
    spread_multiplier: float
    slippage_bps: float
    funding_bps: float

    def round_trip(self, spread_bps: float) -> float:
        total = 2 * self.fee_bps + spread_bps * self.spread_multiplier + 2 * self.slippage_bps
        return (total + self.funding_bps) / 10_000.0


def round_trip_cost(cost: SignalCost, spread_bps: Column) -> Column:
    """Round-trip cost as a return, for a spread that varies by row."""
    fixed = 2 * cost.fee_bps + 2 * cost.slippage_bps + cost.funding_bps
    return (spread_bps * F.lit(cost.spread_multiplier) + F.lit(fixed)) / F.lit(10_000.0)


def threshold_signal(score: Column, threshold: Column | float) -> Column:
    """+1 strictly above, -1 strictly below the negative, else 0."""
    band = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(score > band, 1).when(score < -band, -1).otherwise(0)


def margin_signal(probability: Column, margin: Column | float) -> Column:
    return threshold_signal(probability - F.lit(0.5), margin)


def baseline_signals(samples: DataFrame, *, seed: int) -> DataFrame:
    """Four baselines per sample in long form: ``candidate``, ``signal``."""
    sign = F.signum("observed_return").cast("int")
    drawn = F.floor(seeded_score(seed, F.col("sample_id")) * 3).cast("int") - 1
    options = F.array(
        F.struct(F.lit("no_trade").alias("candidate"), F.lit(0).alias("signal")),
        F.struct(F.lit("momentum").alias("candidate"), sign.alias("signal")),
        F.struct(F.lit("mean_reversion").alias("candidate"), (-sign).alias("signal")),
        F.struct(F.lit("random").alias("candidate"), drawn.alias("signal")),
    )
    return samples.withColumn("_b", F.explode(options)).select("*", "_b.candidate", "_b.signal").drop("_b")


def net_returns(signals: DataFrame, costs: Sequence[SignalCost], spread_bps: float) -> DataFrame:
    """Net return of every signal under every cost scenario."""
    table = F.array(
        *[F.struct(F.lit(c.scenario).alias("scenario"), F.lit(c.round_trip(spread_bps)).alias("cost")) for c in costs]
    )
    net = F.when(F.col("signal") == 0, 0.0).otherwise(
        F.col("signal") * F.col("forward_return") - F.col("_c.cost")
    )
    return signals.withColumn("_c", F.explode(table)).withColumns(
        {"scenario": F.col("_c.scenario"), "net_return": net}
    ).drop("_c")


def evaluate_signals(net: DataFrame, group: Sequence[str]) -> DataFrame:
    """Trade count, total, mean and win rate over active rows, per group."""
    active = F.col("signal") != 0
    trades = F.count_if(active)
    return net.groupBy(*group).agg(
        F.count("*").alias("samples"),
        trades.alias("trade_count"),
        F.sum("net_return").alias("total_net_return"),
        F.when(trades > 0, F.sum("net_return") / trades).otherwise(0.0).alias("mean_net_return"),
        F.when(trades > 0, F.count_if(active & (F.col("net_return") > 0)) / trades)
        .otherwise(0.0)
        .alias("win_rate"),
    )


def maximum_drawdown(series: DataFrame, group: Sequence[str], order: str, value: str = "net_return") -> DataFrame:
    """Largest fall of compounded equity from its running peak, starting at one."""
    path = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    equity = F.product(1 + F.col(value)).over(path)
    return (
        series.withColumn("_equity", equity)
        .withColumn("_peak", F.greatest(F.max("_equity").over(path), F.lit(1.0)))
        .groupBy(*group)
        .agg(
            F.greatest(F.max((F.col("_peak") - F.col("_equity")) / F.col("_peak")), F.lit(0.0)).alias(
                "maximum_drawdown"
            )
        )
    )


def summary(series: DataFrame, group: Sequence[str], value: str = "net_return") -> DataFrame:
    """Mean, interpolated median and win rate of a bounded series."""
    return series.groupBy(*group).agg(
        F.count("*").alias("episodes"),
        F.avg(value).alias("mean"),
        F.median(value).alias("median"),
        F.avg((F.col(value) > 0).cast("double")).alias("win_rate"),
    )


def sharpe(series: DataFrame, group: Sequence[str], value: str = "net_return", periods: int = 52) -> DataFrame:
    """Per-period and annualised Sharpe; NULL when the deviation is zero."""
    ratio = F.try_divide(F.avg(value), F.stddev_samp(value))
    return series.groupBy(*group).agg(
        F.count("*").alias("episodes"), ratio.alias("sharpe"),
        (ratio * F.sqrt(F.lit(float(periods)))).alias("annualised_sharpe"),
    )


def deflated_sharpe(series: DataFrame, family: Sequence[str], trial: str, value: str = "net_return") -> DataFrame:
    """Probability that each trial's Sharpe beats the best expected from chance; NULL with a `reason` where it has none.

    Moments are Spark aggregates; only the normal distribution itself, which
    Spark lacks, is evaluated in a small vectorised UDF.
    """
    moments = series.groupBy(*family, trial).agg(
        F.count("*").alias("n"),
        F.try_divide(F.avg(value), F.stddev_samp(value)).alias("sharpe"),
        F.skewness(value).alias("skew"),
        (F.kurtosis(value) + 3).alias("kurt"),
    )
    # Trials that cannot be judged stay, with the reason and without a probability.
    usable = F.col("sharpe").isNotNull() & (F.col("n") >= 3)
    moments = moments.withColumn("_fit", usable)
    cell = W.partitionBy(*family, "_fit")
    spread = moments.withColumns(
        {"trials": F.count("*").over(cell), "trial_deviation": F.stddev_samp("sharpe").over(cell)}
    )
    spread = spread.withColumn("reason", F.when(F.col("n") < 3, "TOO_FEW_OBSERVATIONS").when(F.col("sharpe").isNull(), "NO_VARIATION")
                               .when(F.col("trials") < 2, "TOO_FEW_TRIALS"))

    @F.pandas_udf("double")
    def probability(
        n: pd.Series, observed: pd.Series, skew: pd.Series, kurt: pd.Series, trials: pd.Series, deviation: pd.Series
    ) -> pd.Series:
        normal = NormalDist()

        def one(n_, s, g3, g4, count, dev):
            expected = dev * (
                (1 - EULER_MASCHERONI) * normal.inv_cdf(1 - 1 / count)
                + EULER_MASCHERONI * normal.inv_cdf(1 - 1 / (count * math.e))
            )
            scale = 1 - g3 * s + (g4 - 1) / 4 * s * s
            return normal.cdf((s - expected) * math.sqrt(n_ - 1) / math.sqrt(scale)) if scale > 0 else None

        return pd.Series([one(*row) for row in zip(n, observed, skew, kurt, trials, deviation, strict=True)])

    judged = spread.filter(F.col("reason").isNull())
    return judged.select(
        *family, trial, "n", "sharpe",
        probability("n", "sharpe", "skew", "kurt", "trials", "trial_deviation").alias("deflated_sharpe"), "reason",
    ).unionByName(spread.filter(F.col("reason").isNotNull()).select(
        *family, trial, "n", "sharpe", F.lit(None).cast("double").alias("deflated_sharpe"), "reason"))


def block_start(seed: int, repetition: Column, block: Column, n: Column) -> Column:
    """The hash-drawn start of one resampled block, reproducible in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), repetition.cast("string"), block.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), n)


def bootstrap_means(
    series: DataFrame, group: Sequence[str], order: str, *, block: int, repetitions: int, seed: int,
    value: str = "net_return",
) -> DataFrame:
    """Circular moving-block bootstrap means, a row per group and repetition.

    Each start position carries its block of values as a short array, so a
    repetition reads one row per block instead of one per observation.
    """
    cell = W.partitionBy(*group)
    placed = series.select(
        *group, F.col(value).alias("_v"),
        (F.row_number().over(cell.orderBy(order)) - 1).cast("long").alias("_at"),
        F.count("*").over(cell).alias("_n"),
    )
    # A second lap of the first rows lets the frame run past the end.
    laps = placed.withColumn(
        "_lap", F.explode(F.when(F.col("_at") < block, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ).withColumn("_pos", F.col("_at") + F.col("_lap") * F.col("_n"))
    ahead = cell.orderBy("_pos").rowsBetween(0, block - 1)
    blocks = laps.withColumn("_values", F.collect_list("_v").over(ahead)).filter("_lap = 0").select(
        *group, F.col("_at").alias("_start"), "_values"
    )
    sizes = series.groupBy(*group).agg(F.count("*").alias("_n"), F.avg(value).alias("observed_mean"))
    count = F.ceil(F.col("_n") / F.lit(block)).cast("long")
    draws = (
        sizes.filter(F.col("_n") >= block)
        .withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
        .withColumn("_start", block_start(seed, F.col("repetition"), F.col("_block"), F.col("_n")))
        .withColumn("_take", F.least(F.lit(block), F.col("_n") - F.col("_block") * block).cast("int"))
    )
    total = F.aggregate(F.slice("_values", F.lit(1), F.col("_take")), F.lit(0.0), lambda a, v: a + v)
    return (
        draws.join(blocks, [*group, "_start"])
        .groupBy(*group, "repetition", "_n", "observed_mean")
        .agg((F.sum(total) / F.col("_n")).alias("mean"))
        .withColumnRenamed("_n", "n")
    )


def bootstrap_test(
    series: DataFrame, group: Sequence[str], order: str, *, block: int, repetitions: int, seed: int,
    confidence: float = 0.95, value: str = "net_return",
) -> DataFrame:
    """Percentile interval of the mean and a one-sided p-value under a centred null.

    Centring shifts every resampled mean by the observed one, so the null
    distribution is read off the same draws. A series shorter than a block has
    its mean, but neither interval nor p-value.
    """
    means = bootstrap_means(
        series, group, order, block=block, repetitions=repetitions, seed=seed, value=value
    )
    ranked = means.withColumn(
        "_rank", F.row_number().over(W.partitionBy(*group).orderBy("mean", "repetition")) - 1
    )
    tail = (1 - confidence) / 2
    low, high = int(round(tail, 12) * (repetitions - 1)), int(round(1 - tail, 12) * (repetitions - 1))
    beyond = F.count_if(F.col("mean") - F.col("observed_mean") >= F.col("observed_mean"))
    tested = ranked.groupBy(*group, "n", "observed_mean").agg(
        F.max(F.when(F.col("_rank") == low, F.col("mean"))).alias("lower"),
        F.max(F.when(F.col("_rank") == high, F.col("mean"))).alias("upper"),
        ((beyond + 1) / F.lit(repetitions + 1)).alias("p_value"),
    )
    short = series.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("observed_mean")).filter(F.col("n") < block)
    return tested.unionByName(short, allowMissingColumns=True)


def benjamini_hochberg(tests: DataFrame, family: Sequence[str], name: str, p_value: str = "p_value") -> DataFrame:
    """False-discovery q-values: the running minimum from the largest p down."""
    cell = W.partitionBy(*family)
    rank = F.row_number().over(cell.orderBy(p_value, name))
    down = cell.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)
    return (
        tests.withColumn("_rank", rank)
        .withColumn("_raw", F.col(p_value) * F.count("*").over(cell) / F.col("_rank"))
        .withColumn("q_value", F.least(F.min("_raw").over(down), F.lit(1.0)))
        .drop("_rank", "_raw")
    )


def probability_metrics(predictions: DataFrame, group: Sequence[str], probability: str = "probability") -> DataFrame:
    """Brier score and clipped log loss of the up-move probability."""
    p = F.least(F.greatest(F.col(probability), F.lit(PROBABILITY_CLIP)), F.lit(1 - PROBABILITY_CLIP))
    up = (F.col("forward_return") > 0).cast("double")
    return predictions.groupBy(*group).agg(
        F.count("*").alias("samples"),
        F.avg((p - up) * (p - up)).alias("brier"),
        F.avg(-(up * F.log(p) + (1 - up) * F.log(1 - p))).alias("log_loss"),
    )


def threshold_grid(scores: DataFrame, group: Sequence[str], score: Column, *, candidates: int = 9) -> DataFrame:
    """Distinct thresholds picked at even ranks of |score|, plus zero."""
    slots = candidates - 1

    def ranks(count: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.struct(
            i.alias("label"), (F.floor(i * (count - 1) / F.lit(slots - 1)) + 1).cast("long").alias("rank")))

    sizes = scores.select(*group, F.abs(score).alias("_size"))
    chosen = skewsafe.values_at_ranks(sizes, group, "_size", ranks).select(*group, F.col("value").alias("threshold"))
    return chosen.unionByName(scores.select(*group).distinct().withColumn("threshold", F.lit(0.0))).distinct()


def best_threshold(
    scores: DataFrame, grid: DataFrame, group: Sequence[str], score: Column, *, cost: float, minimum_trades: int
) -> DataFrame:
    """The grid threshold with the highest net total; ties go to the larger one.

    The grid has at most nine rows per group; it is packed into one array so
    that every sample meets its candidates through an equi-join on the group.
    """
    packed = grid.groupBy(*group).agg(F.array_sort(F.collect_set("threshold")).alias("_grid"))
    signal = threshold_signal(F.col("_score"), F.col("threshold"))
    trials = (
        scores.withColumn("_score", score)
        .join(packed, list(group))
        .withColumn("threshold", F.explode("_grid"))
        .withColumn("signal", signal)
        .withColumn(
            "_net", F.when(F.col("signal") == 0, 0.0).otherwise(F.col("signal") * F.col("forward_return") - F.lit(cost))
        )
        .groupBy(*group, "threshold")
        .agg(F.sum("_net").alias("total_net_return"), F.count_if(F.col("signal") != 0).alias("trade_count"))
        .filter(F.col("trade_count") >= minimum_trades)
    )
    return trials.groupBy(*group).agg(
        F.max_by(
            F.struct("threshold", "total_net_return", "trade_count"), F.struct("total_net_return", "threshold")
        ).alias("_best")
    ).select(*group, "_best.*")
