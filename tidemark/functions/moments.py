"""Columns over times and windows of the day."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """ISO times with offset, Z or none, which is UTC, and times as in mails; null where text is no time."""
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC?)$", "+0000")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def is_fresh(at: Column, now: Column, days: Column | float) -> Column:
    """Whether at lies within the days before now. Unknown times count as fresh, and 0 days means no limit."""
    limit = days if isinstance(days, Column) else F.lit(float(days))
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    return F.coalesce((limit <= 0) | (age <= limit * 86400), F.lit(True))


def days_old(at: Column, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(at)) / F.lit(86400.0)


def in_window(clock: Column, start: str, end: str) -> Column:
    """Whether HH:MM lies in [start, end), which may go over midnight; equal ends are an empty window."""
    if start == end:
        return F.lit(False)
    if start < end:
        return (clock >= start) & (clock < end)
    return (clock >= start) | (clock < end)


def window_end(at: Column, start: str, end: str) -> Column:
    """The instant at which the window that holds at ends; null outside it."""
    clock, day = F.date_format(at, "HH:mm"), F.date_trunc("day", at)
    ends = day + F.make_interval(hours=F.lit(int(end[:2])), mins=F.lit(int(end[3:])))
    later = (clock >= start) if start > end else F.lit(False)
    return F.when(in_window(clock, start, end), F.when(later, ends + F.expr("INTERVAL 1 DAY")).otherwise(ends))


def clock_for_display(batch: Column) -> Column:
    return F.when(batch.rlike(r"^\d{2}-\d{2}$"), F.replace(batch, F.lit("-"), F.lit(":"))).otherwise(batch)


def range_for_display(first: Column, last: Column) -> Column:
    a, b = clock_for_display(first), clock_for_display(last)
    return F.when(F.coalesce(first, F.lit("")) == "", "").when(F.coalesce(last, F.lit("")).isin("") | (a == b), a).otherwise(F.concat(F.lit("["), a, F.lit(" ~ "), b, F.lit("]")))


def named_range(name: str, today: date) -> tuple[date, date]:
    """Calendar ranges up to today: this_week starts on Monday, last_week is Monday to Sunday, last_N_days has today."""
    monday, first = today - timedelta(days=today.weekday()), today.replace(day=1)
    if name == "today":
        return today, today
    if name == "yesterday":
        return today - timedelta(days=1), today - timedelta(days=1)
    if name == "this_week":
        return monday, today
    if name == "last_week":
        return monday - timedelta(days=7), monday - timedelta(days=1)
    if name == "this_month":
        return first, today
    if name == "last_month":
        end = first - timedelta(days=1)
        return end.replace(day=1), end
    if name.startswith("last_") and name.endswith("_days"):
        n = int(name.split("_")[1])
        if not 1 <= n <= 365:
            raise ValueError("last_N_days takes 1 to 365 days")
        return today - timedelta(days=n - 1), today
    raise ValueError(f"unknown range: {name}")


def comparison_period(name: str, today: date) -> tuple[date, date]:
    """Ranges of period comparisons, which end before today: last_week is the 7 days before, last_month the 30."""
    spans = {"last_week": 7, "last_month": 30}
    if name in spans:
        return today - timedelta(days=spans[name]), today - timedelta(days=1)
    return named_range(name, today)


def time_for_reader(text: Column, zone: str = "Asia/Shanghai", with_date: bool = True) -> Column:
    """MM-DD HH:MM, or HH:MM, of an ISO time in a zone; one without offset is UTC, whatever the session's zone.

    Of text that is no time, the parts at their places are taken if it has one T, else it stays; null is empty.
    """
    bare = ~text.rlike(r"(Z|\+\d{2}:?\d{2}|-\d{2}:\d{2})$")
    at = F.try_to_timestamp(F.when(bare, F.concat(F.regexp_replace(text, r"\..*", ""), F.lit("Z"))).otherwise(text))
    here = F.convert_timezone(F.current_timezone(), F.lit(zone), at.cast("timestamp_ntz"))
    shown = F.date_format(here, "MM-dd HH:mm" if with_date else "HH:mm")
    parts = F.split(text, "T")
    clock = F.substring(F.get(parts, F.lit(1)), 1, 5)
    raw = F.concat_ws(" ", F.substr(F.get(parts, F.lit(0)), F.lit(6)), clock) if with_date else clock
    return F.coalesce(shown, F.when(F.size(parts) == 2, raw).otherwise(text), F.lit(""))
