"""Integer-nanosecond time: the canonical clock of every table in the package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_NS = 1_000_000_000
MINUTE_NS = 60 * SECOND_NS
HOUR_NS = 3_600 * SECOND_NS
DAY_NS = 86_400 * SECOND_NS
WEEK_NS = 7 * DAY_NS

# The epoch began on a Thursday, so an open day with this remainder is a Sunday.
SUNDAY_REMAINDER = 3
# Closes of Sunday bars sit this far past a multiple of a week.
SUNDAY_CLOSE_PHASE_NS = (SUNDAY_REMAINDER + 1) * DAY_NS
# Epoch numbers at or above this are microseconds, below it milliseconds.
MICROSECOND_ERA = 10**15


def int_div(value: Column, divisor: int | Column) -> Column:
    """Long division that stays in integers: a double would lose nanoseconds."""
    return F.call_function("div", value.cast("long"), F.lit(divisor).cast("long"))


def ns_to_timestamp(ns: Column) -> Column:
    return F.timestamp_micros(int_div(ns, 1_000))


def timestamp_to_ns(stamp: Column) -> Column:
    return F.unix_micros(stamp.cast("timestamp")) * F.lit(1_000)


def iso_utc(ns: Column) -> Column:
    """ISO-8601 in UTC, with microseconds only when there are any."""
    stamp = ns_to_timestamp(ns)
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(int_div(ns, 1_000), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.concat(whole, fraction, F.lit("Z"))


def day_string(ns: Column) -> Column:
    return F.date_format(ns_to_timestamp(ns), "yyyy-MM-dd")


def month_string(ns: Column) -> Column:
    return F.date_format(ns_to_timestamp(ns), "yyyy-MM")


def month_index(month: Column) -> Column:
    """`YYYY-MM` as a month count, so that month arithmetic is subtraction."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def month_range(first: Column, last: Column) -> Column:
    """Every `YYYY-MM` from `first` to `last`, both included."""
    months = F.sequence(
        F.to_date(F.concat(first, F.lit("-01"))),
        F.to_date(F.concat(last, F.lit("-01"))),
        F.expr("interval 1 month"),
    )
    return F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))


def month_between(month: Column, first: str | None, last: str | None) -> Column:
    """Whether a month lies in an optionally open-ended closed range."""
    keep = F.lit(True)
    if first is not None:
        keep = keep & (month >= first)
    if last is not None:
        keep = keep & (month <= last)
    return keep


def normalise_epoch_ns(raw: Column) -> Column:
    """Mixed-era epochs: microseconds are floored to milliseconds, then all to ns."""
    value = raw.cast("long")
    millis = F.when(value >= MICROSECOND_ERA, int_div(value, 1_000)).otherwise(value)
    return millis * F.lit(1_000_000)


def is_weekly_bar(open_time_ns: Column) -> Column:
    """Whether a daily bar is the Sunday bar that closes a decision week."""
    return F.pmod(int_div(open_time_ns, DAY_NS), F.lit(7)) == SUNDAY_REMAINDER


def week_end_ns(event_ns: Column, phase_ns: int = SUNDAY_CLOSE_PHASE_NS) -> Column:
    """The weekly decision an event settles into: the first one at or after it."""
    shifted = event_ns - F.lit(phase_ns)
    return int_div(shifted + F.lit(WEEK_NS - 1), WEEK_NS) * F.lit(WEEK_NS) + F.lit(phase_ns)


def sample_id(venue: str, decision_ns: Column) -> Column:
    return F.concat_ws(":", F.lit(venue), decision_ns.cast("string"), F.lit("w1"))


def sample_decision_ns(identifier: Column) -> Column:
    return F.split_part(identifier, F.lit(":"), F.lit(2)).cast("long")
