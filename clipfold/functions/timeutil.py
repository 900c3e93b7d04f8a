"""Dates and times. Sessions run in UTC; the editorial day is the one in Seoul."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"
MAX_GAP_DAYS = 7


def kst_date(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant.cast("timestamp"), ZONE))


def valid_date(text: Column) -> Column:
    """Whether a text is a real YYYY-MM-DD."""
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def feed_moment(text: Column) -> Column:
    """(at, precision): a bare calendar date is midnight in Seoul, anything else an instant; null if neither parses."""
    bare = F.regexp_replace(text, r"\.", "-")
    is_day = text.rlike(r"^[0-9]{4}[-.][0-9]{2}[-.][0-9]{2}$")
    day = F.to_utc_timestamp(F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")), ZONE)
    formats = ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss zzz", "d MMM yyyy HH:mm:ss Z")
    weekless = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")
    instant = F.coalesce(*(F.try_to_timestamp(weekless, F.lit(f.replace("EEE, ", ""))) for f in formats))
    at = F.when(is_day, day).otherwise(instant)
    return F.when(at.isNotNull(), F.struct(at.alias("at"), F.when(is_day, "date").otherwise("instant").alias("precision")))


def in_window(instant: Column, run_date: Column, days: int) -> Column:
    """Seoul dates of the ``days`` days before the run date, that day itself left out."""
    day = kst_date(instant)
    return (day >= F.date_sub(run_date, days)) & (day < run_date)


def iso_millis(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def korean_label(day: Column) -> Column:
    return F.format_string("%d년 %d월 %d일", F.year(day), F.month(day), F.day(day))


def cadence(run_date: Column, latest: Column, force_bootstrap: Column | None = None, daily_force: Column | None = None) -> Column:
    """(days_since, force_best, window_days, reason) of a run; a latest date after the run is an error."""
    boot, daily = (F.lit(False) if x is None else x for x in (force_bootstrap, daily_force))
    gap = F.datediff(run_date, latest)
    gap = F.when(gap < 0, F.raise_error(F.lit("latest publication is after the run date")).cast("int")).otherwise(gap)
    reason = F.when(daily, "daily_force").when(latest.isNull() | boot, "bootstrap").when(gap >= MAX_GAP_DAYS, "deadline").otherwise("quality_first")
    force = reason != "quality_first"
    return F.struct(gap.alias("days_since"), force.alias("force_best"), F.when(force, MAX_GAP_DAYS).otherwise(1).alias("window_days"), reason.alias("reason"))


def retry_delay_ms(initial: Column, multiplier: Column, attempt: Column, most: Column) -> Column:
    return F.least(most, F.floor(initial * F.pow(multiplier, attempt - 1) + 0.5))


def expires_at(collected: Column, days: Column) -> Column:
    return collected + F.make_dt_interval(days)
