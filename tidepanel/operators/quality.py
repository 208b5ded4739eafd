"""Duplicate admission, gaps, coverage and reconciliation of panel rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.timefns import DAY_NS, HOUR_NS, int_div, month_index, month_string


def bar_reasons() -> Column:
    """Codes of the row constraints a bar breaks; empty when it is sound."""
    prices = ("open", "high", "low", "close")
    positive = F.forall(F.array(*prices), lambda p: p > 0)
    contained = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    return F.array_compact(
        F.array(
            F.when(~positive, "NON_POSITIVE_PRICE"),
            F.when(~contained, "RANGE_NOT_CONTAINING"),
            F.when(F.col("base_volume") < 0, "NEGATIVE_VOLUME"),
            F.when(F.col("available_time_ns") < F.col("close_time_ns"), "AVAILABLE_BEFORE_CLOSE"),
        )
    )


def conflicts(rows: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Every version, with its number of copies, of keys that have several versions: what `admit` does not pass on."""
    versions = rows.groupBy(*keys, *content).agg(F.count("*").alias("copies"))
    several = versions.groupBy(*keys).agg(F.count("*").alias("versions")).filter("versions > 1")
    return versions.join(several, list(keys))


def admit(rows: DataFrame, keys: Sequence[str], content: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct rows by key, and a report of identical and conflicting duplicates.

    A key with several versions is not admitted; `conflicts` returns those.

    Counting by key and content first collapses copies on the map side, so a
    heavily duplicated key never travels as raw rows.
    """
    versions = rows.groupBy(*keys, *content).agg(F.count("*").alias("_copies"))
    judged = versions.groupBy(*keys).agg(
        F.count("*").alias("versions"), (F.sum("_copies") - 1).alias("surplus"),
        *[F.first(c).alias(c) for c in content],
    )
    report = judged.agg(
        F.count("*").alias("keys"),
        F.coalesce(F.sum(F.when(F.col("versions") == 1, F.col("surplus"))), F.lit(0)).alias("identical_duplicates"),
        F.count_if(F.col("versions") > 1).alias("conflicting_keys"),
    )
    return judged.filter("versions = 1").drop("versions", "surplus"), report


def quality_rollup(bars: DataFrame, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Rows, first and last day, and days missing between them."""
    day = int_div(F.col("open_time_ns"), DAY_NS)
    return bars.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        (F.max(day) - F.min(day) + 1 - F.countDistinct(day)).alias("missing_days"),
    )


def missing_intervals(bars: DataFrame, keys: Sequence[str], interval_ns: int) -> DataFrame:
    """Missing bars from successive differences, and how many are misaligned."""
    w = W.partitionBy(*keys).orderBy("open_time_ns")
    gap = F.lead("open_time_ns").over(w) - F.col("open_time_ns")
    return bars.withColumn("_gap", gap).groupBy(*keys).agg(
        F.coalesce(F.sum(int_div(F.col("_gap"), interval_ns) - 1), F.lit(0)).alias("missing"),
        F.count_if(F.pmod("_gap", F.lit(interval_ns)) != 0).alias("misaligned"),
    )


def missing_days(bars: DataFrame, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Interior calendar days without a bar: the calendar minus what is present.

    Only the gaps are expanded, so a complete instrument generates nothing.
    """
    day = int_div(F.col("open_time_ns"), DAY_NS)
    days = bars.select(*keys, day.alias("day")).distinct()
    w = W.partitionBy(*keys).orderBy("day")
    return (
        days.withColumn("_next", F.lead("day").over(w))
        .filter(F.col("_next") > F.col("day") + 1)
        .select(*keys, F.explode(F.sequence(F.col("day") + 1, F.col("_next") - 1)).alias("day"))
    )


def contiguous_runs(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal runs of consecutive days (gaps and islands)."""
    w = W.partitionBy(*keys).orderBy("day")
    return (
        days.withColumn("_island", F.col("day") - F.row_number().over(w))
        .groupBy(*keys, "_island")
        .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))
        .drop("_island")
    )


def backfill(missing: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing days with the secondary source's row when it has one, and a status."""
    found = secondary.withColumn("_found", F.lit(True))
    return missing.join(found, [*keys, "day"], "left").withColumn(
        "status", F.when(F.col("_found"), "filled").otherwise("absent_at_source")
    ).drop("_found")


def unexplained_gaps(rollup: DataFrame, absent: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """All instruments whose missing days, less those proven absent, exceed `limit`."""
    proven = absent.groupBy(*keys).agg(F.count("*").alias("_proven"))
    return (
        rollup.join(proven, list(keys), "left")
        .withColumn("unexplained", F.col("missing_days") - F.coalesce("_proven", F.lit(0)))
        .filter(F.col("unexplained") > limit)
        .select(*keys, "missing_days", "unexplained")
    )


def settlement_intervals(events: DataFrame, keys: Sequence[str], tolerance_ns: int = 60 * 10**9) -> DataFrame:
    """Whole-hour spacing around each settlement.

    The gap to the next settlement decides, the last one looks back, a lone one
    takes eight hours. `irregular` marks spacings off a whole positive hour.
    """
    w = W.partitionBy(*keys).orderBy("calc_time_ns")
    ahead = F.lead("calc_time_ns").over(w) - F.col("calc_time_ns")
    back = F.col("calc_time_ns") - F.lag("calc_time_ns").over(w)
    hours = int_div(F.col("_gap") + F.lit(HOUR_NS // 2), HOUR_NS)
    off = F.abs(F.col("_gap") - F.col("interval_hours") * F.lit(HOUR_NS)) > tolerance_ns
    return (
        events.withColumn("_gap", F.coalesce(ahead, back, F.lit(8 * HOUR_NS)))
        .withColumn("interval_hours", hours)
        .withColumn("irregular", (F.col("interval_hours") <= 0) | off)
        .drop("_gap")
    )


def field_mismatches(
    previous: DataFrame, base: DataFrame, keys: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Field-level differences of rows about to be replaced, and rows with no successor."""
    right = base.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_there"))
    joined = previous.select(*keys, *fields).join(right, list(keys), "left")
    differences = F.array(
        *[
            F.when(
                ~F.col(f).eqNullSafe(F.col(f"_new_{f}")),
                F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("previous"),
                         F.col(f"_new_{f}").cast("string").alias("base")),
            )
            for f in fields
        ]
    )
    gone = F.array(
        F.struct(F.lit("missing_in_base").alias("field"), F.lit(None).cast("string").alias("previous"),
                 F.lit(None).cast("string").alias("base"))
    )
    found = F.when(F.col("_there"), F.array_compact(differences)).otherwise(gone)
    return joined.withColumn("_d", F.explode(found)).select(*keys, "_d.*")


def superset_reasons(original: DataFrame, extended: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Original manifest rows the extended manifest lost or changed: missing, hash, status."""
    right = extended.select(*keys, F.col("hash").alias("_hash"), F.col("status").alias("_status"), F.lit(True).alias("_there"))
    reason = (
        F.when(F.col("_there").isNull(), "missing")
        .when(F.col("hash") != F.col("_hash"), "hash")
        .when(F.col("status") != F.col("_status"), "status")
    )
    return (
        original.join(right, list(keys), "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select(*keys, "reason")
    )


def integrity_reasons(actual: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files against their manifest, both ways: missing, mismatched, unlisted."""
    have = actual.select(*keys, F.col("hash").alias("_have"))
    want = manifest.select(*keys, F.col("hash").alias("_want"))
    reason = (
        F.when(F.col("_have").isNull(), "missing")
        .when(F.col("_want").isNull(), "unlisted")
        .when(F.col("_have") != F.col("_want"), "mismatched")
    )
    return have.join(want, list(keys), "full_outer").withColumn("reason", reason).filter(
        F.col("reason").isNotNull()
    ).select(*keys, "reason")


def coverage_months(sources: DataFrame) -> DataFrame:
    """Latest present month per kind and instrument."""
    return sources.filter(F.col("status") == "present").groupBy("kind", "instrument_id").agg(
        F.max("month").alias("covered_month")
    )


def coverage_month(sources: DataFrame) -> DataFrame:
    """The month covered in every kind: the earliest of the kinds' latest months."""
    by_kind = sources.filter(F.col("status") == "present").groupBy("kind").agg(F.max("month").alias("m"))
    return by_kind.agg(F.min("m").alias("coverage_month"))


def coverage_class(covered: DataFrame) -> DataFrame:
    """Current, one month behind (publication lag) or stale, against the kind's front."""
    front = F.max("covered_month").over(W.partitionBy("kind"))
    behind = month_index(front) - month_index(F.col("covered_month"))
    return covered.withColumns(
        {"furthest_month": front, "months_behind": behind}
    ).withColumn(
        "coverage",
        F.when(F.col("months_behind") == 0, "current").when(F.col("months_behind") == 1, "lagging").otherwise("stale"),
    )


def exit_gate(exits: DataFrame, asked: Column, coverage: Column) -> DataFrame:
    """Reasons against closing at each exit day; `exits` has `day` and `with_bar`, the instruments that have its bar."""
    reasons = F.array_compact(F.array(
        F.when(F.col("with_bar") == 0, "EXIT_BAR_MISSING").when(F.col("with_bar") < asked, "EXIT_BAR_INCOMPLETE"),
        F.when(month_string(F.col("day") * F.lit(DAY_NS)) > coverage, "COVERAGE_MONTH_NOT_REACHED")))
    return exits.select(
        ((F.col("day") + 1) * F.lit(DAY_NS)).alias("exit_ns"), asked.alias("asked"), "with_bar", coverage.alias("coverage_month"),
        F.array_join(reasons, ",").alias("reasons"))


def stale_instruments(classed: DataFrame) -> DataFrame:
    """A row per instrument that is more than one month behind its kind's front."""
    return classed.filter(F.col("coverage") == "stale").select("kind", "instrument_id", "covered_month", "furthest_month", "months_behind")


def split_by_coverage(tail: DataFrame, covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mark each tail row carried or superseded by the month that now covers it."""
    month = month_string(F.col("open_time_ns"))
    return tail.join(covered.select(*keys, "covered_month"), list(keys), "left").withColumn(
        "disposition", F.when(month <= F.col("covered_month"), "superseded").otherwise("carried")
    ).drop("covered_month")


def union_by_precedence(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of sources where the earliest listed one wins each key.

    `min_by` keeps one row per key on the map side, so overlapping sources are
    reduced before the shuffle.
    """
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for other in ranked[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in keys and c != "_rank"]
    best = out.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_rank").alias("_r"), F.min("_rank").alias("source_rank"))
    return best.select(*keys, "source_rank", "_r.*")
