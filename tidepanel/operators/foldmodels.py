"""Models fitted for every fold at once: one aggregate per step for all of them.

A fit is a row of parameters per group (`keys`, a fold). Each step is a grouped
aggregate with map-side combine over the training rows of all folds; rows meet
their fold's parameters through an equi-join with that small table. What the
driver sees per step is a few numbers a fold, bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidepanel.operators import skewsafe
from tidepanel.operators.models import FEATURES, feature_frame, sigmoid

TARGET = "forward_return"
# Gains are compared as shares of the squared residuals after rounding, so that equal splits of different features tie in every engine.
GAIN_DIGITS = 12


def _doubles(*values: Column) -> Column:
    return F.array(*[v.cast("double") for v in values])


def standardisation(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`means` and `scales` of the features by group; a feature without variation has scale one."""
    deviation = [F.stddev_pop(c) for c in FEATURES]
    return feature_frame(train).groupBy(*keys).agg(
        F.count("*").alias("train_samples"),
        _doubles(*[F.avg(c) for c in FEATURES]).alias("means"),
        _doubles(*[F.when(d > 0, d).otherwise(1.0) for d in deviation]).alias("scales"),
    )


def solved(augmented: Column, size: int) -> Column:
    """The solution of a positive definite system given as rows of ``[a | b]``, by Gauss-Jordan steps."""
    def step(matrix: Column, k: Column) -> Column:
        pivot = F.transform(F.get(matrix, k), lambda v: v / F.get(F.get(matrix, k), k))
        return F.transform(matrix, lambda row, i: F.when(i == k, pivot).otherwise(
            F.zip_with(row, pivot, lambda v, p: v - F.get(row, k) * p)))

    reduced = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), augmented, step)
    return F.transform(reduced, lambda row: F.get(row, F.lit(size)))


def fit_ridge(train: DataFrame, keys: Sequence[str], *, alpha: float) -> DataFrame:
    """Ridge on train-standardised features: keys, `means`, `scales`, `coefficients`, `intercept`.

    One aggregate of covariances; the system is solved in the row that holds them.
    """
    rows = feature_frame(train)
    columns = [*FEATURES, TARGET]
    moments = rows.groupBy(*keys).agg(
        F.count("*").cast("double").alias("_n"), F.avg(TARGET).alias("intercept"),
        *[F.covar_pop(a, b).alias(f"_c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j],
    )
    base = moments.join(standardisation(train, keys), list(keys))
    size = len(FEATURES)
    scale = lambda i: F.get("scales", F.lit(i)) if i < size else F.lit(1.0)

    def cell(i: int, j: int) -> Column:
        value = F.col("_n") * F.col(f"_c{min(i, j)}_{max(i, j)}") / scale(i) / scale(j)
        return value + F.lit(alpha) if i == j else value

    system = F.array(*[F.array(*[cell(i, j) for j in range(size + 1)]) for i in range(size)])
    return base.withColumn("_system", system).select(
        *keys, "train_samples", "means", "scales", solved(F.col("_system"), size).alias("coefficients"), "intercept")


def linear_score() -> Column:
    """The score of a row that carries its fold's parameters."""
    x = _doubles(*[F.col(c) for c in FEATURES])
    z = F.zip_with(F.zip_with(x, "means", lambda v, m: v - m), "scales", lambda v, s: v / s)
    return F.aggregate(F.zip_with(z, "coefficients", lambda v, b: v * b), F.col("intercept"), lambda a, v: a + v)


def _table(rows: DataFrame, keys: Sequence[str], values: list[dict], more: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """Parameters from the driver, typed like the keys of `rows`."""
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(n, kind) for n, kind in more]])
    return rows.sparkSession.createDataFrame([tuple(v[n] for n in schema.names) for v in values], schema)


def fit_logistic(train: DataFrame, keys: Sequence[str], *, l2: float, iterations: int, rate: float) -> DataFrame:
    """Full-batch gradient descent of all folds together; same columns as `fit_ridge`."""
    size = len(FEATURES)
    scaled = standardisation(train, keys)
    x = _doubles(*[F.col(c) for c in FEATURES])
    z = F.zip_with(F.zip_with(x, "means", lambda v, m: v - m), "scales", lambda v, s: v / s)
    rows = feature_frame(train).join(scaled, list(keys)).select(
        *keys, z.alias("_z"), (F.col(TARGET) > 0).cast("double").alias("_up")).persist(StorageLevel.MEMORY_AND_DISK)
    fields = [("coefficients", T.ArrayType(T.DoubleType())), ("intercept", T.DoubleType())]
    try:
        state = {tuple(r[k] for k in keys): r.asDict() | {"coefficients": [0.0] * size, "intercept": 0.0} for r in scaled.collect()}
        for _ in range(iterations):
            logit = F.aggregate(F.zip_with("_z", "coefficients", lambda v, b: v * b), F.col("intercept"), lambda a, v: a + v)
            steps = rows.join(_table(train, keys, list(state.values()), fields), list(keys)).withColumn(
                "_e", sigmoid(logit) - F.col("_up")
            ).groupBy(*keys).agg(
                F.avg("_e").alias("bias"), F.array(*[F.avg(F.col("_e") * F.get("_z", F.lit(i))) for i in range(size)]).alias("tilt"))
            for s in steps.collect():
                held = state[tuple(s[k] for k in keys)]
                held["coefficients"] = [b - rate * (g + l2 * b) for b, g in zip(held["coefficients"], s.tilt, strict=True)]
                held["intercept"] -= rate * s.bias
    finally:
        rows.unpersist()
    doubles = T.ArrayType(T.DoubleType())
    return _table(train, keys, list(state.values()), [("train_samples", T.LongType()), ("means", doubles), ("scales", doubles), *fields])


def fit_platt(scored: DataFrame, keys: Sequence[str], *, l2: float, iterations: int, rate: float) -> DataFrame:
    """`slope` and `shift` by group that map the raw `logit` to a calibrated one."""
    rows = scored.select(*keys, "logit", (F.col(TARGET) > 0).cast("double").alias("_up")).persist(StorageLevel.MEMORY_AND_DISK)
    fields = [("slope", T.DoubleType()), ("shift", T.DoubleType())]
    try:
        state = {tuple(r): {**r.asDict(), "slope": 1.0, "shift": 0.0} for r in rows.select(*keys).distinct().collect()}
        for _ in range(iterations):
            error = sigmoid(F.col("slope") * F.col("logit") + F.col("shift")) - F.col("_up")
            steps = rows.join(_table(scored, keys, list(state.values()), fields), list(keys)).withColumn("_e", error).groupBy(*keys).agg(
                F.avg("_e").alias("bias"), F.avg(F.col("_e") * F.col("logit")).alias("tilt"))
            for s in steps.collect():
                held = state[tuple(s[k] for k in keys)]
                held["shift"], held["slope"] = held["shift"] - rate * s.bias, held["slope"] - rate * (s.tilt + l2 * held["slope"])
    finally:
        rows.unpersist()
    return _table(scored, keys, list(state.values()), fields)


def _long(rows: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """A row per feature: `feature` (its position) and `v`."""
    return rows.select(*keys, *more, F.posexplode(_doubles(*[F.col(c) for c in FEATURES])).alias("feature", "v"))


def split_candidates(train: DataFrame, keys: Sequence[str], *, minimum_leaf: int, limit: int) -> DataFrame:
    """`cuts` by group and feature: at most `limit` evenly picked midpoints between distinct values.

    Equal values are counted before the shuffle. A draw by hash cuts a group's values
    into slots of like counts, the same in each branch that asks for them, so an outlier does not widen them, and only slot
    summaries are ordered as a whole. Every candidate leaves `minimum_leaf` rows on both sides.
    """
    cell = [*keys, "feature"]
    counted = _long(feature_frame(train), keys).groupBy(*cell, "v").agg(F.count("*").alias("_c"))
    drawn = skewsafe.slot_bounds(counted.select(*cell, F.col("v").alias("_v"), F.col("_c").alias("_n")), cell)
    bounds = drawn.withColumnRenamed("row_count", "_total")
    slotted = counted.join(bounds, cell).withColumn("_slot", F.size(F.filter("_bounds", lambda b: b < F.col("v")))).drop("_bounds")
    ranked = skewsafe.running_totals(slotted, cell, ["v"], F.col("_slot"), {"_upto": F.col("_c")})
    following = skewsafe.carry(ranked, cell, ["v"], F.col("_slot"), F.col("v"), "_after", direction="next", inclusive=False)
    usable = following.filter(
        (F.col("_upto") >= minimum_leaf) & (F.col("_upto") <= F.col("_total") - minimum_leaf) & F.col("_after").isNotNull())
    numbered = skewsafe.with_ordinal(usable, cell, ["v"], F.col("_slot"), "_at")
    sizes = usable.groupBy(*cell).agg(F.count("*").alias("_count"))
    if limit == 1:
        chosen = F.col("_at") - 1 == F.floor(F.col("_count") / 2)
    else:
        chosen = F.exists(F.sequence(F.lit(0).cast("long"), F.lit(limit - 1).cast("long")), lambda i: (
            F.floor(i * (F.col("_count") - 1) / F.lit(limit - 1)) == F.col("_at") - 1))
    kept = numbered.join(sizes, cell).filter((F.col("_count") <= limit) | chosen)
    return kept.groupBy(*cell).agg(F.array_sort(F.collect_list((F.col("v") + F.col("_after")) / 2)).alias("cuts"))


STUMP = T.StructType([
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()), T.StructField("left", T.DoubleType()),
    T.StructField("right", T.DoubleType()), T.StructField("gain", T.DoubleType()),
])


def stump_score() -> Column:
    """The score of a row that carries its fold's `base` and `stumps`."""
    x = _doubles(*[F.col(c) for c in FEATURES])
    return F.aggregate("stumps", F.col("base"), lambda a, s: a + F.when(
        F.get(x, s["feature"]) <= s["threshold"], s["left"]).otherwise(s["right"]))


def fit_stumps(train: DataFrame, keys: Sequence[str], *, rounds: int, rate: float, minimum_leaf: int, limit: int) -> DataFrame:
    """Boosted regression stumps of all folds together: keys, `base`, `stumps`.

    A round adds residuals up by the interval that a value falls in, which
    prices every candidate split; ties go to the earlier feature and smaller
    cut. A fold in which no split gains anything keeps the stumps it has.
    """
    cell = [*keys, "feature"]
    rows = feature_frame(train).select(*keys, *FEATURES, TARGET).persist(StorageLevel.MEMORY_AND_DISK)
    fields = [("base", T.DoubleType()), ("stumps", T.ArrayType(STUMP))]
    cuts = split_candidates(rows, keys, minimum_leaf=minimum_leaf, limit=limit).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        state = {tuple(r[k] for k in keys): {**r.asDict(), "stumps": []} for r in rows.groupBy(*keys).agg(F.avg(TARGET).alias("base")).collect()}
        for _ in range(rounds):
            residual = (F.col(TARGET) - stump_score()).alias("_r")
            placed = _long(rows.join(_table(train, keys, list(state.values()), fields), list(keys)), keys, residual).join(cuts, cell)
            slot = F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("slot")
            sums = placed.select(*cell, slot, "_r", "cuts").groupBy(*cell, "slot").agg(
                F.sum("_r").alias("_s"), F.sum(F.col("_r") * F.col("_r")).alias("_q"), F.count("*").alias("_n"), F.first("cuts").alias("cuts"))
            whole = W.partitionBy(*cell)
            upto = whole.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
            sides = sums.select(
                *cell, F.get("cuts", "slot").alias("threshold"), F.sum("_s").over(upto).alias("ls"), F.sum("_n").over(upto).alias("ln"),
                F.sum("_s").over(whole).alias("ts"), F.sum("_n").over(whole).alias("tn"),
                F.sum("_q").over(whole).alias("tq"),
            ).filter(F.col("threshold").isNotNull() & (F.col("ln") >= minimum_leaf) & (F.col("tn") - F.col("ln") >= minimum_leaf))
            rest, others = F.col("ts") - F.col("ls"), F.col("tn") - F.col("ln")
            gain = F.col("ls") * F.col("ls") / F.col("ln") + rest * rest / others - F.col("ts") * F.col("ts") / F.col("tn")
            split = F.struct("feature", "threshold", (rate * F.col("ls") / F.col("ln")).alias("left"), (rate * rest / others).alias("right"), "gain")
            share = F.round(F.try_divide(F.col("gain"), F.col("tq")), GAIN_DIGITS)
            best = sides.withColumn("gain", gain).withColumn("share", share).filter("share > 0").groupBy(*keys).agg(
                F.max_by(split, F.struct("share", -F.col("feature"), -F.col("threshold"))).alias("_best")).collect()
            if not best:
                break
            grown = {tuple(b[k] for k in keys): tuple(b["_best"]) for b in best}
            state = {k: v | {"stumps": [*v["stumps"], *([grown[k]] if k in grown else [])]} for k, v in state.items()}
    finally:
        rows.unpersist()
        cuts.unpersist()
    return _table(train, keys, list(state.values()), fields)
