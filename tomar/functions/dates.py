"""Dates and deadlines as Spark columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tr_lower

#: Months, number words, and the yearly holidays as month and day.
MONTHS = "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık".split()
UNITS = "bir iki üç dört beş altı yedi sekiz dokuz".split()
TENS = "on yirmi otuz kırk elli altmış yetmiş seksen doksan".split()
HOLIDAYS = ["01-01", "04-23", "05-01", "05-19", "07-15", "08-30", "10-29"]


def parse_date(c: Column | str) -> Column:
    """A date from 5.3.2024, 5/3/2024, 5 Mart 2024 or 2024-03-05; null where there is none or it doesn't exist."""
    c = F.col(c) if isinstance(c, str) else c
    low = tr_lower(c)
    part = lambda p, n: F.nullif(F.regexp_extract(low, p, n), F.lit(""))

    def build(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    numeric = r"(?:^|[^0-9])([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})(?:[^0-9]|$)"
    named = rf"(?:^|[^0-9])([0-9]{{1,2}})\s+({'|'.join(MONTHS)})\s+([0-9]{{4}})(?:[^0-9]|$)"
    iso = r"(?:^|[^0-9])([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[^0-9]|$)"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(named, 2)).cast("string")
    return F.coalesce(
        F.when(part(numeric, 1).isNotNull(), build(part(numeric, 3), part(numeric, 2), part(numeric, 1))),
        F.when(part(named, 1).isNotNull(), build(part(named, 3), month, part(named, 1))),
        F.when(part(iso, 1).isNotNull(), build(part(iso, 1), part(iso, 2), part(iso, 3))),
    )


def number_word(c: Column | str) -> Column:
    """The number 1 to 99 that a word or two words name, or digits; else null."""
    c = F.col(c) if isinstance(c, str) else c
    names = {u: i for i, u in enumerate(UNITS, 1)} | {t: 10 * i for i, t in enumerate(TENS, 1)}
    names |= {t + u: 10 * i + k for i, t in enumerate(TENS, 1) for k, u in enumerate(UNITS, 1)}
    low = F.regexp_replace(tr_lower(c), r"\s+", "")
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, low), F.when(low.rlike("^[0-9]{1,2}$"), low.cast("int")))


def business_day(start: Column | str, days: int | Column, holidays: list[date] | None = None) -> Column:
    """The date so many working days later: weekends, yearly holidays and the given ones don't count. 0 days is the start."""
    start = F.col(start) if isinstance(start, str) else start
    n = F.lit(days) if isinstance(days, int) else days
    fixed = F.array(*[F.lit(h) for h in HOLIDAYS])
    extra = F.array(*[F.lit(h) for h in holidays or []]).cast("array<date>")
    ahead = F.filter(
        F.sequence(F.date_add(start, 1), F.date_add(start, n * 3 + 30)),
        lambda d: (F.weekday(d) < 5) & ~F.array_contains(fixed, F.date_format(d, "MM-dd")) & ~F.array_contains(extra, d),
    )
    return F.when(n <= 0, start).otherwise(F.try_element_at(ahead, n))


def escalation(days_left: Column | str) -> Column:
    """gecmis, cok_yakin (3 days), yakin (7 days) or uzak; null for null."""
    d = F.col(days_left) if isinstance(days_left, str) else days_left
    return F.when(d < 0, "gecmis").when(d <= 3, "cok_yakin").when(d <= 7, "yakin").when(d.isNotNull(), "uzak")


def earliest(*candidates: Column) -> Column:
    """The earliest of (date, ordinal, source) structs whose date isn't null."""
    return F.array_min(F.filter(F.array(*candidates), lambda x: x[0].isNotNull()))
