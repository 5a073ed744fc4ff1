"""Names, titles and printed days: normalisers, slugs, languages and discovery; all native."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import MONTHS, TURKISH_MONTHS
from .text import fold

#: Words that tell Turkish and English apart, titles that go before names.
TURKISH = ("ve", "bir", "için", "ile", "olarak", "bu", "da", "de")
ENGLISH = ("the", "and", "of", "for", "with", "in", "to", "is")
HONORIFICS = "^((prof|dr|doc|assoc|mr|mrs|ms)[. ]+)+"


def actor_name(c: Column) -> Column:
    """A person's or body's name: folded, without titles and signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(F.trim(c)), HONORIFICS, ""), "[^a-z0-9]+", " "))


def alias_name(c: Column) -> Column:
    """An alias: folded, what stands in brackets dropped, words alone."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"\([^)]*\)", " "), "[^a-z0-9]+", " "))


def label_name(c: Column) -> Column:
    """A label: lower case and single spaces, everything else kept."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def slug(c: Column, most: int = 60) -> Column:
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most)), "-+$", "")


def search_terms(c: Column, most: int = 5) -> Column:
    """The first ``most`` different words of at least four letters, joined as a search wants them."""
    return F.array_join(F.slice(F.array_distinct(F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)), 1, most), " AND ")


def language(c: Column) -> Column:
    """``tr`` or ``en`` by letters that only one has, else by its commonest words; null if nothing tells."""
    words = F.split(F.lower(c), r"[^\p{L}]+")
    count = lambda some: F.size(F.filter(words, lambda w: w.isin(*some)))
    return F.when(F.lower(c).rlike("[ğışİ]"), "tr").when(count(TURKISH) > count(ENGLISH), "tr").when(count(ENGLISH) > count(TURKISH), "en")


def takeaway(c: Column, cues: Sequence[str] = ("conclu", "found", "show")) -> Column:
    """The first sentence that has a cue, else the last one."""
    sentences = F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    hit = F.get(F.filter(sentences, lambda s: F.lower(s).rlike("|".join(cues))), F.lit(0))
    return F.coalesce(hit, F.try_element_at(sentences, F.lit(-1)))


def without_days(c: Column) -> Column:
    """A title without the days that listings print before or behind it."""
    day = rf"(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-]20[0-9]{{2}}|20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}} (?:{'|'.join(MONTHS)})[a-z]* 20[0-9]{{2}})"
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"(?i)^\s*{day}\s*[-–:|]?\s*", ""), rf"(?i)\s*[-–:|(]?\s*{day}\)?\s*$", ""))


def locator(channel: Column, c: Column) -> Column:
    """An account or site in the one spelling of its channel: handles without @, sites without scheme, www and slash."""
    bare = F.lower(F.trim(c))
    site = F.regexp_replace(F.regexp_replace(bare, "^https?://(www[.])?", ""), "/+$", "")
    handle = F.regexp_replace(F.regexp_replace(bare, "^https?://[^/]+/", ""), "^@|[/?].*$", "")
    return F.when(channel.isin("x", "instagram"), handle).when(channel == "youtube", F.regexp_replace(site, "^youtube[.]com/(c/|channel/|@)?", "")).otherwise(site)


def url_topic(c: Column) -> Column:
    """The first part of a URL's path that is no language, year or number; null for roots."""
    parts = F.split(F.regexp_replace(F.regexp_extract(F.lower(c), "^[a-z]+://[^/?#]*([^?#]*)", 1), "^/+", ""), "/")
    return F.get(F.filter(parts, lambda p: (p != "") & ~p.rlike("^([a-z]{2}|[0-9]+)$")), F.lit(0))


def impossible_year(c: Column) -> Column:
    """True if a text prints a year from 2101 to 9999 as a number of its own."""
    return c.rlike(r"(?<![0-9])(210[1-9]|21[1-9][0-9]|2[2-9][0-9]{2}|[3-9][0-9]{3})(?![0-9])")


def utc(c: Column) -> Column:
    """A timestamp with an offset (Z, +02:00 or +0200) in UTC; null if it has none."""
    return F.when(c.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(F.regexp_replace(c, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")))


def printed_days(c: Column) -> Column:
    """All days that a text prints in numbers or with English or Turkish months, in order of kind, as dates."""
    s = fold(c)
    numbers = F.transform(F.regexp_extract_all(s, F.lit(r"(?<![0-9])([0-9]{1,2}[./][0-9]{1,2}[./]20[0-9]{2})(?![0-9])"), 1), lambda d: F.try_to_date(F.regexp_replace(d, "/", "."), "d.M.yyyy"))
    iso = F.transform(F.regexp_extract_all(s, F.lit(r"(?<![0-9])(20[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])"), 1), lambda d: F.try_to_date(d, "yyyy-MM-dd"))

    def worded(names: Sequence[str], rest: str) -> Column:
        def day(d: Column) -> Column:
            parts = F.split(d, " ")
            month = F.array_position(F.array(*(F.lit(n) for n in names)), F.regexp_extract(parts[1], f"^({'|'.join(names)})", 1))
            return F.try_to_date(F.concat_ws("-", parts[2], month.cast("string"), parts[0]), "yyyy-M-d")

        return F.transform(F.regexp_extract_all(s, F.lit(rf"(?<![0-9])([0-9]{{1,2}} (?:{'|'.join(names)}){rest} 20[0-9]{{2}})(?![0-9])"), 1), day)

    return F.filter(F.concat(numbers, iso, worded(MONTHS, "[a-z]*"), worded(TURKISH_MONTHS, "")), lambda d: d.isNotNull())
