"""Feed dates to epoch milliseconds, time buckets and relative time, as columns.  The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.text import trim_all

HOUR = 3_600_000
SKEW, WINDOW = HOUR, 12 * HOUR
#: Month names of mail dates, and hours of named zones.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"gmt": 0, "ut": 0, "utc": 0, "z": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
#: Arabic months and units (singular, dual, plural).
ARABIC_MONTHS = ("يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر")
MINUTES, HOURS = ("دقيقة", "دقيقتين", "دقائق"), ("ساعة", "ساعتين", "ساعات")

MAIL = (r"^\s*(?:[A-Za-z]{3,9},\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{2,4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([A-Za-z]{1,5}|[+-]\d{4}|[+-]\d{2}:\d{2})?\s*$")
ISO = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:[.,]\d+)?([+-]\d{2}:?\d{2}|Z)?$"
ISO_SHORT = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?:[+-]\d{2}:?\d{2}|Z)?$"


def zone_seconds(zone: Column) -> Column:
    """Offset of ``+HHMM``, ``+HH:MM`` or a name; unknown and absent are UTC."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = F.left(digits, F.lit(2)).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    signed = F.when(zone.startswith("-"), -1).otherwise(1) * (hours * 3600 + minutes * 60)
    known = F.create_map(*[F.lit(x) for z, h in ZONES.items() for x in (z, h * 3600)])
    named = F.coalesce(F.try_element_at(known, F.lower(zone)), F.lit(0))
    return F.when(zone.rlike("^[+-]"), F.coalesce(signed, F.lit(0))).otherwise(named)


def _epoch(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, offset: Column) -> Column:
    """Milliseconds of a wall clock at an offset; null for a day or time that doesn't exist."""
    real = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    wall = F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(8,6)"), F.lit("UTC"))
    return F.when(real, F.unix_millis(wall) - offset * 1000)


def _matched(text: Column, pattern: str, groups: int, use) -> Column:
    """``use(part)`` where the text matches, null elsewhere; ``part(k)`` is the k-th group, empty where it took no part.  All groups come from one match."""
    # no group can hold the mark between them; what the pattern leaves behind its end comes after the last one
    parts = F.split(F.regexp_replace(text, pattern, "".join(f"${k}|" for k in range(1, groups + 1))), r"\|")
    return F.when(text.rlike(pattern), F.transform(F.array(parts), lambda p: use(lambda k: F.get(p, F.lit(k - 1))))[0])


def parse_iso(text: Column) -> Column:
    """Long form with zone, or the form without seconds, whose zone is ignored (read as UTC)."""
    full = lambda part: _epoch(*[part(k).try_cast("int") for k in range(1, 7)], zone_seconds(part(7)))
    short = lambda part: _epoch(*[part(k).try_cast("int") for k in range(1, 6)], F.lit(0), F.lit(0))
    # no text has both forms
    return F.coalesce(_matched(text, ISO, 7, full), _matched(text, ISO_SHORT, 5, short))


def parse_mail(text: Column) -> Column:
    """``[Day, ]D Mon YYYY HH:MM[:SS] [zone]``; years of two digits are of this century."""
    def read(part):
        number = lambda k: part(k).try_cast("int")
        month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(2))).cast("int"), F.lit(0))
        year = F.when(number(3) < 100, number(3) + 2000).otherwise(number(3))
        second = F.when(part(6) == "", 0).otherwise(number(6))
        return F.when(month.isNotNull(), _epoch(year, month, number(1), number(4), number(5), second, zone_seconds(part(7))))

    return _matched(text, MAIL, 7, read)


def parse_date(raw: Column, now_ms: int | Column) -> Column:
    """Epoch milliseconds, or null for what is no date or lies more than an hour ahead of ``now_ms``."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    # bound once, so that the many groups of both patterns don't swell the generated code
    out = F.transform(F.array(trim_all(raw)), lambda t: F.coalesce(parse_iso(t), parse_mail(t)))[0]
    return F.get(F.filter(F.array(out), lambda ms: ms <= now + SKEW), F.lit(0))


def day_bucket(published_at: Column) -> Column:
    """Index of the 12-hour bucket; truncates toward zero."""
    return _div(published_at, WINDOW)


def _div(value: Column, by: int) -> Column:
    """Integer division that truncates toward zero."""
    return ((value - (value % by)) / by).cast("long")


def _counted(n: Column, forms: tuple[str, str, str]) -> Column:
    one, two, few = forms
    before = lambda noun: F.concat(F.lit("قبل "), n.cast("string"), F.lit(f" {noun}"))
    return F.when(n == 1, f"قبل {one}").when(n == 2, f"قبل {two}").when(n <= 10, before(few)).otherwise(before(one))


def absolute_date(millis: Column, zone: str = "UTC") -> Column:
    local = F.from_utc_timestamp(F.timestamp_millis(millis), zone)
    months = F.array(*[F.lit(m) for m in ARABIC_MONTHS])
    return F.concat(F.dayofmonth(local).cast("string"), F.lit(" "), F.element_at(months, F.month(local)))


def relative_time(published_at: Column, now_ms: int | Column, zone: str = "UTC") -> Column:
    """Arabic relative time: now, minutes, hours, yesterday, days, then day and month."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    gone = F.greatest(now - published_at, F.lit(0))
    minutes, hours, days = _div(gone, 60_000), _div(gone, HOUR), _div(gone, 24 * HOUR)
    return (F.when(gone < 60_000, "الآن").when(minutes < 60, _counted(minutes, MINUTES)).when(hours < 24, _counted(hours, HOURS))
            .when(days == 1, "أمس").when(days == 2, "قبل يومين").when(days <= 10, F.concat(F.lit("قبل "), days.cast("string"), F.lit(" أيام")))
            .otherwise(absolute_date(published_at, zone)))
