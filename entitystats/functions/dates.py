"""Dates, seasons, durations and epoch times."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text date layouts tried in order (fixed values).
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MMM d, yyyy", "MMMM d, yyyy"]
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
    "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy HH:mm:ss",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d MMM yyyy HH:mm:ss z",
    "MMM d yyyy",
    "MMMM d yyyy",
    "MMM d, yyyy h:mm a",
    "MMMM d, yyyy h:mm a",
]


def parse_date(text: Column) -> Column:
    """First layout that fits, else the ISO part before 'T', else null."""
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS]
    iso = F.try_to_timestamp(F.split(text, "T")[0], F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.length(text) > 0, F.coalesce(*tries, iso))


def parse_timestamp(text: Column) -> Column:
    """Timestamp from any known text layout; null when none fits."""
    weekday = F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*(?=[0-9])", "")  # a weekday adds nothing
    plain = F.when(text.contains(","), weekday).otherwise(text)
    return F.coalesce(*[_read(plain, f, text) for f in TIMESTAMP_FORMATS], text.try_cast("timestamp"))


def _read(text: Column, layout: str, whole: Column) -> Column:
    """Timestamp of one layout, tried only where the whole text has its marks: a layout that fails costs an exception."""
    marks = [whole.contains(m) for m in "-/:," if m in layout]
    read = F.try_to_timestamp(text, F.lit(layout))
    return F.when(reduce(and_, marks), read) if marks else read


def epoch_timestamp(number: Column) -> Column:
    """Seconds, or milliseconds above 1e12, since 1970 in UTC."""
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    return F.timestamp_micros((seconds * 1_000_000).cast("bigint"))


def season_label(date: Column, start_month: int = 10) -> Column:
    """'2024-25' style label; months from ``start_month`` on open the new season."""
    first = F.when(F.month(date) >= start_month, F.year(date)).otherwise(F.year(date) - 1)
    return F.concat(first.cast("string"), F.lit("-"), F.lpad(((first + 1) % 100).cast("string"), 2, "0"))


def previous_seasons(label: Column, n: int) -> Column:
    """The season itself and the n-1 before it, newest first."""
    first = F.substring(label, 1, 4).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda back: F.concat(
            (first - back).cast("string"), F.lit("-"), F.lpad(((first - back + 1) % 100).cast("string"), 2, "0")
        ),
    )


def minutes_played(text: Column) -> Column:
    """'mm:ss' or a number as minutes; 0.0 when unreadable."""
    s = text.cast("string")
    at = F.instr(s, ":")
    clock = F.substr(s, F.lit(1), at - 1).try_cast("double") + F.substr(s, at + 1).try_cast("double") / 60.0
    # a text with a colon is never a number, so failing casts stay rare
    return F.coalesce(F.when(at > 0, clock).otherwise(text.try_cast("double")), F.lit(0.0))


def date_in_id(text: Column) -> Column:
    """Date written inside an id, as 20YYMMDD or 20YY-MM-DD."""
    compact = F.regexp_extract(text, r"(20\d{6})", 1)
    dashed = F.regexp_extract(text, r"(20\d{2}-\d{2}-\d{2})", 1)
    return F.when(compact != "", F.try_to_timestamp(compact, F.lit("yyyyMMdd"))).when(
        dashed != "", F.try_to_timestamp(dashed, F.lit("yyyy-MM-dd"))
    )


def is_fresh(fetched_at: Column, now: Column, ttl_hours: float = 6.0) -> Column:
    """Age is at least zero and below the time to live."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(fetched_at.cast("timestamp"))
    return F.coalesce((age >= 0) & (age < int(ttl_hours * 3600 * 1_000_000)), F.lit(False))
