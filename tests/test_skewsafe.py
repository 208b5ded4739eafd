"""The bucketed helpers against plain Python, with one key holding most rows."""

import math
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tidepanel.operators import skewsafe


def rows():
    rng = random.Random(5)
    keys = ["hot"] * 400 + ["cold"] * 40
    return [(k, i, rng.choice([None, float(rng.randrange(30))])) for i, k in enumerate(keys)]


def by_key():
    out = {}
    for k, i, v in rows():
        out.setdefault(k, []).append((i, v))
    return out


def frame(spark):
    return spark.createDataFrame(rows(), "k string, i bigint, v double")


def test_ordinal_is_the_row_number(spark):
    got = skewsafe.with_ordinal(frame(spark), ["k"], ["i"], F.floor(F.col("i") / 37)).collect()
    want = {(k, i): n for k, items in by_key().items() for n, (i, _) in enumerate(items, 1)}
    assert {(r.k, r.i): r.ordinal for r in got} == want


def test_carry_both_ways(spark):
    df = frame(spark)
    bucket = F.floor(F.col("i") / 11)
    back = skewsafe.carry(df, ["k"], ["i"], bucket, F.col("v"), "x").collect()
    ahead = skewsafe.carry(df, ["k"], ["i"], bucket, F.col("v"), "x", direction="next", inclusive=False).collect()
    for k, items in by_key().items():
        values = [v for _, v in items]
        for n, (i, _) in enumerate(items):
            last = next((v for v in reversed(values[: n + 1]) if v is not None), None)
            following = next((v for v in values[n + 1 :] if v is not None), None)
            assert next(r.x for r in back if (r.k, r.i) == (k, i)) == last
            assert next(r.x for r in ahead if (r.k, r.i) == (k, i)) == following


def test_running_totals(spark):
    got = skewsafe.running_totals(
        frame(spark).fillna(0.0), ["k"], ["i"], F.floor(F.col("i") / 13), {"t": F.col("v")}
    ).collect()
    for k, items in by_key().items():
        total, want = 0.0, {}
        for i, v in items:
            total += v or 0.0
            want[i] = total
        assert {r.i: r.t for r in got if r.k == k} == want


def test_exact_quantiles_are_nearest_rank(spark):
    quantiles = [Decimal("0.50"), Decimal("0.90"), Decimal("0.99")]
    got = skewsafe.exact_quantiles(frame(spark), ["k"], "v", quantiles).collect()
    for k, items in by_key().items():
        values = sorted(v for _, v in items if v is not None)
        for q in quantiles:
            want = values[max(math.ceil(len(values) * q) - 1, 0)]
            assert next(r.value for r in got if r.k == k and r.quantile == q) == want


def test_slots_do_not_depend_on_the_layout_of_rows(spark):
    """The slots are computed twice in a query; a sketch merged in another order cuts them elsewhere, and ranks are lost."""
    rng = random.Random(7)
    values = [round(rng.lognormvariate(3, 1), 4) for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", F.lit("one"))
    counted = df.groupBy("k", F.col("v").alias("_v")).agg(F.count("*").alias("_n"))
    layouts = [skewsafe.slot_bounds(counted.repartition(n, "_n", "_v"), ["k"]).first() for n in (1, 5)]
    assert layouts[0] == layouts[1] and layouts[0].row_count == len(values) and len(layouts[0]._bounds) in (63, 64)
    quantiles = [Decimal(q) / 40 for q in range(1, 40)]
    query = skewsafe.exact_quantiles(df, ["k"], "v", quantiles)
    assert "percentile_approx" not in query._jdf.queryExecution().toString()
    ordered = sorted(values)
    assert {r.quantile: r.value for r in query.collect()} == {q: ordered[max(math.ceil(len(ordered) * q) - 1, 0)] for q in quantiles}
