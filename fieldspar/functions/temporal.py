"""Clocks, report-local intervals and dates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"^([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?$"


def clock_seconds(raw: Column) -> Column:
    """Seconds since midnight of ``HH:MM[:SS]``; null if it is no time of day (24:00 is none)."""
    text = F.trim(raw)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, _CLOCK, i), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(text.rlike(_CLOCK), part(1) * 3600 + part(2) * 60 + part(3))


def _at(period_start: Column, seconds: Column) -> Column:
    midnight = F.date_trunc("day", period_start).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def operation_interval(start_raw: Column, end_raw: Column, period_start: Column) -> Column:
    """(start, end, status) of an operation within its report; an end before the start is on the next day."""
    a, b = clock_seconds(start_raw), clock_seconds(end_raw)
    blank = F.coalesce(start_raw, F.lit("")).isin("") | F.coalesce(end_raw, F.lit("")).isin("")
    status = (
        F.when(period_start.isNull(), "missing_report_period")
        .when((a.isNull() | b.isNull()) & blank, "missing_operation_time")
        .when(a.isNull() | b.isNull(), "invalid_operation_time")
        .when(b < a, "midnight_rollover").when(a == b, "equal_time_ambiguous").otherwise("valid")
    )
    start = F.when(status.isin("midnight_rollover", "equal_time_ambiguous", "valid"), _at(period_start, a))
    end = F.when(status == "midnight_rollover", _at(period_start, b + 86400)).when(status == "valid", _at(period_start, b))
    return F.struct(start.alias("start"), end.alias("end"), status.alias("status"))


def failure_time(start_raw: Column, period_start: Column) -> Column:
    """(start, status) of a failure within its report."""
    a = clock_seconds(start_raw)
    status = F.when(period_start.isNull(), "missing_report_period").when(a.isNull() & F.coalesce(start_raw, F.lit("")).isin(""), "missing_failure_time").when(a.isNull(), "invalid_failure_time").otherwise("valid")
    return F.struct(F.when(status == "valid", _at(period_start, a)).alias("start"), status.alias("status"))


def duration_hours(start_raw: Column, end_raw: Column) -> Column:
    """Hours between two clocks; an end that is not after the start is a day later, so equal clocks are 24 hours."""
    a, b = clock_seconds(start_raw), clock_seconds(end_raw)
    return F.round((b - a + F.when(b <= a, 86400).otherwise(0)) / 3600, 4)


def day_number(day: Column) -> Column:
    """Days since 0001-01-01, which is day 1."""
    return F.datediff(day.cast("date"), F.lit("0001-01-01").cast("date")) + 1


def minutes_between(a: Column, b: Column) -> Column:
    """Absolute distance of two timestamps in minutes."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.abs(micros(a) - micros(b)) / 60e6


def on_day(ts: Column, day: str) -> Column:
    """Whether a timestamp is on a day, as a range that reaches the scan."""
    first = F.lit(day).cast("date").cast("timestamp_ntz")
    return (ts >= first) & (ts < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz"))


def iso(ts: Column) -> Column:
    """ISO text of a timestamp."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def spud_excluded(period_end: Column, spud: Column) -> Column:
    """Whether a report ends more than a day before the well was begun."""
    return F.coalesce(period_end < spud - F.expr("interval 1 day"), F.lit(False))
