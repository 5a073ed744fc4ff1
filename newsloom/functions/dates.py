"""Date, period and back-off expressions; all native, with the reference day as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

#: Month names as they are printed, the English ones by their first three letters, the Turkish ones folded.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
TURKISH_MONTHS = ("ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik")


def normalise(c: Column) -> Column:
    """A printed date as a date: ISO with or without padding, ``2026 Sep 7``, ``2026 Sep``, ``2026-09``, ``2026``, ``7 Sep 2026``; else null.

    A day that its month does not have (31 February) is refused, not moved: years run from 1990 to 2100."""
    s = F.lower(F.trim(c))
    month = lambda m: F.when(m.rlike("^[0-9]+$"), m.try_cast("int")).otherwise(F.array_position(F.array(*(F.lit(x) for x in MONTHS)), F.substring(m, 1, 3)).cast("int"))
    forms = (
        (r"^([0-9]{4})[-/. ]([0-9]{1,2}|[a-z]{3,9})[-/. ]([0-9]{1,2})(?:[t ].*)?$", (1, 2, 3)),
        (r"^([0-9]{4})[-/. ]([0-9]{1,2}|[a-z]{3,9})$", (1, 2, None)),
        (r"^([0-9]{4})$", (1, None, None)),
        (r"^(?:[a-z]{3}, )?([0-9]{1,2}) ([a-z]{3,9}) ([0-9]{4})(?: .*)?$", (3, 2, 1)),
    )
    found = []
    for pattern, (y, m, d) in forms:
        part = lambda i, p=pattern: F.regexp_extract(s, p, i)
        year = part(y).try_cast("int")
        mm = month(part(m)) if m else F.lit(1)
        dd = part(d).try_cast("int") if d else F.lit(1)
        text = F.format_string("%04d-%02d-%02d", year, mm, dd)
        found.append(F.when(s.rlike(pattern) & year.between(1990, 2100), F.try_to_date(text, "yyyy-MM-dd")))
    return F.coalesce(*found)


def age_days(c: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), c)


def period_bounds(c: Column) -> Column:
    """Year, quarter and month keys of a day with their first and last days."""
    y, q, m = F.year(c), F.quarter(c), F.month(c)
    bounds = lambda key, unit, months: F.struct(key.alias("key"), F.trunc(c, unit).alias("start"), F.date_add(F.add_months(F.trunc(c, unit), months), -1).alias("end"))
    return F.struct(
        bounds(F.concat(F.lit("Y"), y), "year", 12).alias("year"),
        bounds(F.concat(F.lit("Q"), y, F.lit("-"), q), "quarter", 3).alias("quarter"),
        bounds(F.concat(F.lit("M"), y, F.lit("-"), F.lpad(m.cast("string"), 2, "0")), "month", 1).alias("month"),
    )


def backoff_minutes(base: int, failures: Column, cap: int) -> Column:
    """base doubled for each failure after the first, at most cap; 0 without failures."""
    return F.when(failures <= 0, F.lit(0).cast("long")).otherwise(F.least(F.lit(cap).cast("double"), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(30)))).cast("long"))


#: Words beside a deadline, folded, and how many characters before and behind a day they may stand.
CUES = ("son basvuru", "basvuru son", "son tarih", "son gun", "tarihine kadar", "tarihinde sona", "deadline", "apply by", "application close", "applications close", "close on", "closes", "due on", "due by", "until")
BEFORE, BEHIND = 45, 25


def deadline(c: Column, published: Column) -> Column:
    """The latest day that a text prints beside a word for a deadline; null if no day has one.

    Days are read in numbers and with English or Turkish months, day or month first; a day without a year falls on or
    after the publication; years run from 2000 to 2100."""
    s = fold(F.regexp_replace(c, r"\s+", " "))
    before = "|".join(rf"(?<={cue}.{{0,{BEFORE - len(cue)}}})" for cue in CUES)
    behind = "|".join(rf".{{0,{BEHIND - len(cue)}}}{cue}" for cue in CUES)
    cued = lambda day: F.regexp_extract_all(s, F.lit(rf"(?={day})(?:{before}){day}|{day}(?={behind})"), 0)
    names = "|".join((*TURKISH_MONTHS, *(f"{m}[a-z]{{0,6}}" for m in MONTHS)))
    numbers = F.transform(cued(r"(?<![0-9])[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}(?![0-9])"), lambda d: F.try_to_date(F.regexp_replace(d, "[/-]", "."), "d.M.yyyy"))
    day_first = cued(rf"(?<![0-9])[0-9]{{1,2}} (?:{names})\b\.?(?: [0-9]{{4}})?")
    month_first = cued(rf"\b(?:{names}) [0-9]{{1,2}}(?:st|nd|rd|th)?\b(?:,? [0-9]{{4}})?")
    worded = F.transform(F.concat(day_first, month_first), lambda d: _worded(d, published))
    return F.array_max(F.filter(F.concat(numbers, worded), lambda d: F.year(d).between(2000, 2100)))


def _worded(d: Column, published: Column) -> Column:
    parts = F.filter(F.split(d, "[^a-z0-9]+"), lambda p: p != "")
    name = F.get(F.filter(parts, lambda p: p.rlike("^[a-z]")), F.lit(0))
    figures = F.transform(F.filter(parts, lambda p: p.rlike("^[0-9]")), lambda p: F.regexp_extract(p, "^[0-9]+", 0))
    place = lambda names, x: F.nullif(F.array_position(F.array(*(F.lit(n) for n in names)), x), F.lit(0))
    month = F.coalesce(place(TURKISH_MONTHS, name), place(MONTHS, F.left(name, F.lit(3))))
    on = lambda year: F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), F.get(figures, F.lit(0))), "yyyy-M-d")
    this = on(F.year(published))
    return F.when(F.size(figures) > 1, on(F.get(figures, F.lit(1)))).when(this >= published, this).otherwise(on(F.year(published) + 1))
