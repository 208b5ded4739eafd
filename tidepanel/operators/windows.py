"""Calendar-complete statistics of one contract's daily closes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.timefns import DAY_NS

EMA_CHUNK = 128


@dataclass(frozen=True)
class IndicatorWindows:
    """Window lengths of the twelve indicators, in days (fixed values)."""

    sma: tuple[int, ...] = (20, 50, 100)
    crosses: tuple[tuple[int, int], ...] = ((20, 50), (50, 100))
    breakout: tuple[int, ...] = (20, 50, 100)
    roc: tuple[int, ...] = (20, 60, 120)
    macd: tuple[int, int] = (12, 26)

    @property
    def span_days(self) -> int:
        """The longest hole-free span any one of the votes needs."""
        longest = [*self.sma, *(slow for _, slow in self.crosses), *self.breakout]
        return max(*longest, *(n + 1 for n in self.roc))

    @property
    def names(self) -> list[str]:
        return [
            *(f"ma_{n}" for n in self.sma),
            *(f"ma_cross_{a}_{b}" for a, b in self.crosses),
            *(f"breakout_{n}" for n in self.breakout),
            *(f"roc_{n}" for n in self.roc),
            f"macd_{self.macd[0]}_{self.macd[1]}",
        ]


def _contract():
    return W.partitionBy("contract_id").orderBy("close_time_ns")


def trailing_return(bars: DataFrame, lookback_days: int, name: str = "trailing_return") -> DataFrame:
    """Return against the close exactly `lookback_days` earlier; NULL if absent.

    A one-point range frame finds the lagged close in the same sort the other
    per-contract windows use, so several lookbacks cost no join.
    """
    exact = _contract().rangeBetween(-lookback_days * DAY_NS, -lookback_days * DAY_NS)
    past = F.max("close").over(exact)
    return bars.withColumn(name, F.when(past > 0, F.col("close") / past - 1))


def annualised_volatility(bars: DataFrame, window_days: int, name: str = "volatility") -> DataFrame:
    """Sample deviation of daily log returns over a complete calendar window.

    A log return exists only against the previous *day*, so the count inside
    the window equals `window_days` exactly when no day is missing.
    """
    w = _contract()
    previous = F.max("close").over(w.rangeBetween(-DAY_NS, -DAY_NS))
    window = w.rangeBetween(-(window_days - 1) * DAY_NS, 0)
    return (
        bars.withColumn(
            "_log_return",
            F.when((previous > 0) & (F.col("close") > 0), F.log(F.col("close") / previous)),
        )
        .withColumn(
            name,
            F.when(
                F.count("_log_return").over(window) == window_days,
                F.stddev_samp("_log_return").over(window) * F.sqrt(F.lit(365.0)),
            ),
        )
        .drop("_log_return")
    )


def contiguous_run(bars: DataFrame, name: str = "run_length") -> DataFrame:
    """Length of the hole-free daily run ending at each bar (gaps and islands)."""
    w = _contract()
    island = F.col("close_time_ns") - F.row_number().over(w) * F.lit(DAY_NS)
    inside = W.partitionBy("contract_id", "_island").orderBy("close_time_ns")
    return (
        bars.withColumn("_island", island)
        .withColumn(name, F.row_number().over(inside).cast("long"))
        .drop("_island")
    )


def sma(bars: DataFrame, window: int, name: str) -> DataFrame:
    """Mean of the last `window` closes of a run at least that long; else NULL."""
    frame = _contract().rowsBetween(-(window - 1), 0)
    return bars.withColumn(
        name, F.when(F.col("run_length") >= window, F.avg("close").over(frame))
    )


def ema(bars: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """The `2 / (w + 1)` recursion over a contract's whole series of non-null closes, per window.

    A step is an affine map of the average before it, and so is a run of steps: in a
    chunk of `EMA_CHUNK` rows the average is `keep^i * carry + own`, where `own` is a
    weighted running sum of the chunk. Only one row per chunk is gathered by contract
    to compose the maps; what a chunk receives is joined back to its rows.
    """
    ordered = W.partitionBy("contract_id").orderBy("close_time_ns")
    inside = W.partitionBy("contract_id", "_chunk").orderBy("close_time_ns").rowsBetween(W.unboundedPreceding, 0)
    keeps = {w: 1.0 - 2.0 / (w + 1) for w in windows}
    rows = bars.withColumn("_place", F.row_number().over(ordered) - 1).withColumns(
        {"_chunk": F.floor(F.col("_place") / EMA_CHUNK), "_step": F.col("_place") % EMA_CHUNK + 1})
    # Weights grow with the step, so that the running sum holds every earlier term; a window of one row keeps nothing.
    own = {w: F.col("close") if w == 1 else F.pow(F.lit(keep), F.col("_step")) * F.sum(
        (1 - keep) * F.col("close") * F.pow(F.lit(1 / keep), F.col("_step"))).over(inside) for w, keep in keeps.items()}
    rows = rows.withColumns({f"_own_{w}": own[w] for w in windows})

    last = F.struct("_step", *(F.col(f"_own_{w}") for w in windows))
    chunks = rows.groupBy("contract_id", "_chunk").agg(
        F.max_by(last, "_step").alias("_last"), F.min_by("close", "_step").alias("_first"))
    gathered = chunks.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("_chunk", "_first", "_last"))).alias("_all"))

    def received(w: int) -> Column:
        """What each chunk receives: the first close of all, then the average at the end of the chunk before."""
        start = F.array(F.get("_all", F.lit(0))["_first"])
        after = lambda got, c: F.pow(F.lit(keeps[w]), c["_last"]["_step"]) * F.element_at(got, -1) + c["_last"][f"_own_{w}"]
        return F.aggregate("_all", start, lambda got, c: F.concat(got, F.array(after(got, c))))

    carries = gathered.select("contract_id", "_all", *(received(w).alias(f"_got_{w}") for w in windows)).select(
        "contract_id", F.posexplode("_all").alias("_at", "_one"), *(f"_got_{w}" for w in windows)).select(
        "contract_id", F.col("_one._chunk").alias("_chunk"), *(F.get(f"_got_{w}", F.col("_at")).alias(f"_carry_{w}") for w in windows))
    out = rows.join(carries, ["contract_id", "_chunk"])
    averages = [(F.pow(F.lit(keep), F.col("_step")) * F.col(f"_carry_{w}") + F.col(f"_own_{w}")).alias(f"ema_{w}") for w, keep in keeps.items()]
    return out.select(*bars.columns, *averages)


def indicator_votes(bars: DataFrame, spec: IndicatorWindows = IndicatorWindows()) -> DataFrame:
    """Twelve votes in {-1, 0, +1}; a vote whose span has a hole is NULL."""
    w = _contract()
    run = F.col("run_length")

    def average(window: int):
        return F.avg("close").over(w.rowsBetween(-(window - 1), 0))

    def vote(needed: int, value):
        return F.when(run >= needed, F.signum(value).cast("int"))

    columns = {}
    for n in spec.sma:
        columns[f"ma_{n}"] = vote(n, F.col("close") - average(n))
    for fast, slow in spec.crosses:
        columns[f"ma_cross_{fast}_{slow}"] = vote(slow, average(fast) - average(slow))
    for n in spec.breakout:
        frame = w.rowsBetween(-(n - 1), 0)
        high = (F.col("close") == F.max("close").over(frame)).cast("int")
        low = (F.col("close") == F.min("close").over(frame)).cast("int")
        columns[f"breakout_{n}"] = F.when(run >= n, high - low)
    for n in spec.roc:
        columns[f"roc_{n}"] = vote(n + 1, F.col("close") - F.lag("close", n).over(w))
    fast, slow = spec.macd
    columns[f"macd_{fast}_{slow}"] = vote(
        spec.span_days, F.col(f"ema_{fast}") - F.col(f"ema_{slow}")
    )
    return contiguous_run(ema(bars, spec.macd)).withColumns(columns)


def trend_score(
    bars: DataFrame, name: str = "score", spec: IndicatorWindows = IndicatorWindows()
) -> DataFrame:
    """Mean of the twelve votes; NULL as soon as one is absent."""
    total = sum((F.col(n) for n in spec.names[1:]), F.col(spec.names[0]))
    return (
        indicator_votes(bars, spec)
        .withColumn(name, total / F.lit(float(len(spec.names))))
        .drop(*spec.names, *[f"ema_{w}" for w in spec.macd], "run_length")
    )


def holding_prices(bars: DataFrame, holding_days: int) -> DataFrame:
    """Entry, exact exit, and the last close strictly inside the holding period."""
    w = _contract()
    exit_at = w.rangeBetween(holding_days * DAY_NS, holding_days * DAY_NS)
    columns = {"exit_close": F.max("close").over(exit_at)}
    if holding_days > 1:
        inside = w.rangeBetween(DAY_NS, (holding_days - 1) * DAY_NS)
        columns["last_inside"] = F.last("close").over(inside)
    else:
        columns["last_inside"] = F.lit(None).cast("double")
    return bars.withColumns(columns).withColumn("entry_close", F.col("close"))
