"""Exact full-batch fits whose per-iteration work is one Spark aggregate."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import skewsafe


def sigmoid(x: Column) -> Column:
    """Logistic function, written so that neither branch overflows."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


FEATURES = ("observed_return", "range_bps", "volume_change", "cross_basis")


def feature_frame(samples: DataFrame) -> DataFrame:
    """Model inputs with absent optional features as zero."""
    return samples.fillna(0.0, ["volume_change", "cross_basis"])


@dataclass(frozen=True)
class Linear:
    """Coefficients on standardised features; `score` is a plain column expression."""

    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        out = F.lit(self.intercept)
        for name, mean, scale, beta in zip(FEATURES, self.means, self.scales, self.coefficients, strict=True):
            out = out + F.lit(beta) * (F.col(name) - F.lit(mean)) / F.lit(scale)
        return out


def moments(train: DataFrame) -> dict[str, float]:
    """Counts, sums and cross products of features and target, in one aggregate."""
    columns = [*FEATURES, "forward_return"]
    terms = [F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns]]
    terms += [
        F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(columns) for b in columns[i:]
    ]
    return train.agg(*terms).first().asDict()


def fit_ridge(train: DataFrame, *, alpha: float) -> Linear:
    """Ridge on train-standardised features; only a 4x4 system reaches the driver."""
    m = moments(feature_frame(train))
    n = m["n"]
    product = lambda a, b: m.get(f"{a}*{b}", m.get(f"{b}*{a}"))
    mean = {c: m[c] / n for c in (*FEATURES, "forward_return")}
    scale = {}
    for c in FEATURES:
        variance = product(c, c) / n - mean[c] ** 2
        scale[c] = math.sqrt(variance) if variance > 0 else 1.0
    cov = lambda a, b: product(a, b) - n * mean[a] * mean[b]
    gram = np.array([[cov(a, b) / scale[a] / scale[b] + (alpha if a == b else 0.0) for b in FEATURES] for a in FEATURES])
    target = np.array([cov(a, "forward_return") / scale[a] for a in FEATURES])
    beta = np.linalg.solve(gram, target)
    return Linear(
        tuple(mean[c] for c in FEATURES), tuple(scale[c] for c in FEATURES), tuple(float(b) for b in beta),
        mean["forward_return"],
    )


def fit_logistic(train: DataFrame, *, l2: float, iterations: int, rate: float) -> Linear:
    """Full-batch gradient descent; each iteration is one five-number aggregate."""
    rows = feature_frame(train).select(*FEATURES, "forward_return").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = rows.agg(
            F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in FEATURES],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES],
        ).first().asDict()
        means = tuple(stats[f"m_{c}"] for c in FEATURES)
        scales = tuple(stats[f"s_{c}"] if stats[f"s_{c}"] > 0 else 1.0 for c in FEATURES)
        model = Linear(means, scales, (0.0,) * len(FEATURES), 0.0)
        label = (F.col("forward_return") > 0).cast("double")
        for _ in range(iterations):
            error = sigmoid(model.score()) - label
            step = rows.select(error.alias("_e"), *FEATURES).agg(
                F.avg("_e").alias("bias"),
                *[F.avg(F.col("_e") * (F.col(c) - m) / s).alias(c) for c, m, s in zip(FEATURES, means, scales, strict=True)],
            ).first()
            beta = tuple(b - rate * (step[c] + l2 * b) for b, c in zip(model.coefficients, FEATURES, strict=True))
            model = replace(model, coefficients=beta, intercept=model.intercept - rate * step["bias"])
        return model
    finally:
        rows.unpersist()


def fit_platt(scored: DataFrame, *, l2: float, iterations: int, rate: float) -> tuple[float, float]:
    """Slope and intercept mapping the raw ``logit`` to a calibrated one."""
    rows = scored.select("logit", "forward_return").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        slope, intercept = 1.0, 0.0
        label = (F.col("forward_return") > 0).cast("double")
        for _ in range(iterations):
            error = sigmoid(F.lit(slope) * F.col("logit") + F.lit(intercept)) - label
            step = rows.select(error.alias("_e"), "logit").agg(
                F.avg("_e").alias("bias"), F.avg(F.col("_e") * F.col("logit")).alias("tilt")
            ).first()
            intercept, slope = intercept - rate * step["bias"], slope - rate * (step["tilt"] + l2 * slope)
        return slope, intercept
    finally:
        rows.unpersist()


@dataclass(frozen=True)
class Stump:
    feature: str
    threshold: float
    left: float
    right: float
    gain: float

    def value(self) -> Column:
        return F.when(F.col(self.feature) <= self.threshold, self.left).otherwise(self.right)


def split_candidates(rows: DataFrame, feature: str, *, minimum_leaf: int, limit: int) -> list[float]:
    """At most `limit` evenly picked midpoints between distinct sorted values.

    Distinct values are counted and ranked through a bucketed running total;
    only the picked midpoints come to the driver.
    """
    counted = rows.groupBy(F.col(feature).alias("v")).agg(F.count("*").alias("c")).withColumn("k", F.lit(0))
    low, width = counted.agg(F.min("v"), (F.max("v") - F.min("v")) / 64 + 1e-300).first()
    if low is None:
        return []
    bucket = F.floor((F.col("v") - F.lit(low)) / F.lit(width))
    ranked = skewsafe.running_totals(counted, ["k"], ["v"], bucket, {"upto": F.col("c")})
    following = skewsafe.carry(ranked, ["k"], ["v"], bucket, F.col("v"), "after", direction="next", inclusive=False)
    total = rows.count()
    usable = following.filter(
        (F.col("upto") >= minimum_leaf) & (F.col("upto") <= total - minimum_leaf) & F.col("after").isNotNull()
    ).select("k", "v", ((F.col("v") + F.col("after")) / 2).alias("mid"))
    count = usable.count()
    numbered = skewsafe.with_ordinal(usable, ["k"], ["v"], bucket, "at")
    if count > limit:
        picks = [count // 2] if limit == 1 else sorted({i * (count - 1) // (limit - 1) for i in range(limit)})
        numbered = numbered.filter((F.col("at") - 1).isin(picks))
    return sorted(r["mid"] for r in numbered.select("mid").collect())


def fit_stumps(
    train: DataFrame, *, rounds: int, rate: float, minimum_leaf: int, limit: int
) -> tuple[float, list[Stump]]:
    """Boosted regression stumps: one aggregate per feature set and round.

    Every row adds its residual to the interval its value falls in; the sums per
    interval are all a round needs to price every candidate split.
    """
    rows = feature_frame(train).select(*FEATURES, "forward_return").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cuts = {f: split_candidates(rows, f, minimum_leaf=minimum_leaf, limit=limit) for f in FEATURES}
        base = rows.agg(F.avg("forward_return")).first()[0]
        fitted: list[Stump] = []
        prediction = F.lit(base)
        for _ in range(rounds):
            slots = F.array(*[
                F.struct(
                    F.lit(f).alias("f"),
                    F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]).cast("array<double>"), _below(f))).alias("slot"),
                )
                for f in FEATURES
            ])
            sums = (
                rows.withColumn("_r", F.col("forward_return") - prediction).withColumn("_s", F.explode(slots))
                .groupBy("_s.f", "_s.slot").agg(F.sum("_r").alias("s"), F.count("*").alias("n")).collect()
            )
            best = _best_split(sums, cuts, rate, minimum_leaf)
            if best is None:
                break
            fitted.append(best)
            prediction = prediction + best.value()
        return base, fitted
    finally:
        rows.unpersist()


def _below(feature: str):
    return lambda cut: cut < F.col(feature)


def _best_split(sums, cuts: dict[str, list[float]], rate: float, minimum_leaf: int) -> Stump | None:
    best = None
    for feature in FEATURES:
        cells = {r["slot"]: (r["s"], r["n"]) for r in sums if r["f"] == feature}
        total, count = sum(s for s, _ in cells.values()), sum(n for _, n in cells.values())
        left_sum, left_n = 0.0, 0
        for i, cut in enumerate(cuts[feature]):
            s, n = cells.get(i, (0.0, 0))
            left_sum, left_n = left_sum + s, left_n + n
            right_sum, right_n = total - left_sum, count - left_n
            if left_n < minimum_leaf or right_n < minimum_leaf:
                continue
            gain = left_sum**2 / left_n + right_sum**2 / right_n - total**2 / count
            if gain > 0 and (best is None or gain > best.gain):
                best = Stump(feature, cut, rate * left_sum / left_n, rate * right_sum / right_n, gain)
    return best


def stump_score(base: float, stumps: list[Stump]) -> Column:
    out = F.lit(base)
    for stump in stumps:
        out = out + stump.value()
    return out
