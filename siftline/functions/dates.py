"""Dates in running text: ISO 8601, relative, named months in three languages, numeric; and the tabular Islamic calendar."""

from __future__ import annotations

import re
from calendar import timegm

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.arrow import arrow
from siftline.functions.fixed import ARABIC_MONTHS, ENGLISH_MONTHS, FRENCH_MONTHS
from siftline.functions.text import DIGITS

#: The local offset of times without a zone, and the earliest time taken for a date.
OFFSET, EARLIEST = 3600, 788_918_400
RELATIVE = {"منذ ساعتين": 7200, "منذ يومين": 172_800, "اليوم": 0, "aujourd'hui": 0, "today": 0, "أمس": 86_400, "امس": 86_400, "hier": 86_400, "yesterday": 86_400}
MARKERS = ("منذ", "قبل", "il y a", "ago", "depuis")
UNITS = (
    (("دقيقة", "دقائق", "minute", "min"), 60), (("ساعة", "ساعات", "heure", "hour"), 3600), (("أسبوع", "أسابيع", "اسبوع", "semaine", "week"), 604_800),
    (("شهر", "أشهر", "mois", "month"), 2_592_000), (("سنة", "سنوات", "عام", "an ", "ans", "année", "year"), 31_536_000), (("يوم", "أيام", "ايام", "jour", "day"), 86_400),
)
_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?\s*(Z|z|[+-]\d{2}:?\d{2})?)?")
_DIGITS = str.maketrans(*DIGITS)


def _unix(y: int, m: int, d: int, seconds: int = 0) -> int | None:
    return timegm((y, m, d, 0, 0, 0)) + seconds if 1 <= m <= 12 and 1 <= d <= 31 and y > 0 else None


def _iso(text: str) -> tuple[int, str] | None:
    m = _ISO.match(text)
    if not m:
        return None
    day = _unix(int(m[1]), int(m[2]), int(m[3]))
    if day is None or m[4] is None:
        return None if day is None else (day, "day")
    seconds = int(m[4]) * 3600 + int(m[5]) * 60 + int(m[6] or 0)
    zone = m[7]
    shift = OFFSET if zone is None else 0 if zone in "Zz" else (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 3600 + int(zone[-2:]) * 60)
    return day + seconds - shift, "second"


def _relative(text: str, now: int) -> tuple[int, str] | None:
    for phrase, back in RELATIVE.items():
        if phrase in text:
            return now - back, "day"
    if any(m in text for m in MARKERS) and (n := re.search(r"\d+", text)):
        for names, seconds in UNITS:
            if any(u in text for u in names):
                return now - int(n[0]) * seconds, "day"
    return None


def _named(text: str) -> tuple[int, str] | None:
    month = next((n for name, n in (*ARABIC_MONTHS, *FRENCH_MONTHS, *ENGLISH_MONTHS) if name in text), None)
    if month is None:
        return None
    numbers = [int(x) for x in re.findall(r"\d+", text)]
    year = next((n for n in numbers if 1995 <= n <= 2100), None)
    day = next((n for n in numbers if 1 <= n <= 31), None)
    if year is None:
        return None
    unix = _unix(year, month, day or 1)
    return None if unix is None else (unix, "day" if day else "month")


def _numeric(text: str) -> tuple[int, str] | None:
    m = re.search(r"(\d{1,4})[/.-](\d{1,2})[/.-](\d{1,4})", text)
    if not m:
        return None
    a, b, c = int(m[1]), int(m[2]), int(m[3])
    y, mo, d = (a, b, c) if len(m[1]) == 4 else (c, a, b) if b > 12 >= a else (c, b, a)
    unix = _unix(y if y > 99 else 2000 + y, mo, d)
    return None if unix is None else (unix, "day")


def parse_date(text: str | None, now: int) -> tuple[int, str] | None:
    """(unix seconds, precision) of the best reading that is after 1995 and at most a day ahead of now."""
    text = (text or "").strip().translate(_DIGITS).lower()
    for reading in (_iso(text.upper()), _relative(text, now), _named(text), _numeric(text)):
        if reading:
            return reading if EARLIEST < reading[0] < now + 86_400 else None
    return None


@arrow("struct<unix:long,precision:string>")
def date_of(x: pd.Series, now: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_date(t, int(n)) or (None, None) for t, n in zip(x, now)], columns=["unix", "precision"]).astype({"unix": "Int64"})


def w3c_date(c: Column) -> Column:
    """Seconds of a sitemap's lastmod: year, month, day and perhaps a time; an offset is ignored."""
    day = F.coalesce(F.try_to_timestamp(F.left(c, F.lit(10)), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.left(c, F.lit(7)), F.lit("yyyy-MM")), F.try_to_timestamp(F.left(c, F.lit(4)), F.lit("yyyy")))
    clock = F.regexp_extract(c, r"T(\d{2}):(\d{2}):?(\d{2})?", 0)
    part = lambda k: F.coalesce(F.regexp_extract(clock, r"T(\d{2}):(\d{2}):?(\d{2})?", k).try_cast("long"), F.lit(0))
    return F.unix_timestamp(day) + part(1) * 3600 + part(2) * 60 + part(3)


def hijri(day: Column) -> Column:
    """Year, month and day of the tabular Islamic calendar, by days since its first."""
    n = F.unix_date(day) + 492_148  # days since 16 July 622 (Julian)
    year = F.floor((30 * n + 10646) / 10631).cast("int")
    first = lambda y: (y - 1) * 354 + F.floor((3 + 11 * y) / 30)
    month = F.least(F.lit(12), F.ceil((n - (first(year) + 29)) / 29.5).cast("int") + 1)
    start = F.ceil(29.5 * (month - 1)).cast("long") + first(year)
    return F.struct(year.alias("year"), month.alias("month"), (n - start + 1).cast("int").alias("day"))
