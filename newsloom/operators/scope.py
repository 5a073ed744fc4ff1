"""One scope for lists and counts: route, window, channel, family, path and status, as composed predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_match, rule_table

#: Which path a route takes when nothing was said at acquisition; and the lane that route and channel mean.
PATHS = (("TIME_SENSITIVE", "route IN ('news', 'notice')"), ("EVERGREEN", "route = 'research'"))
LANES = (("grant", "channel LIKE 'grant_%'"), ("training", "channel LIKE 'training%'"), ("news", "route = 'news'"), ("research", "route = 'research'"), ("notice", "route = 'notice'"))
UNCLASSIFIED = "UNCLASSIFIED"
LEAST, USUAL, MOST = 1, 200, 500


def effective_path() -> Column:
    """What was said at acquisition, else what the route means, else UNCLASSIFIED."""
    return F.coalesce("acquisition", rule_table(PATHS), F.lit(UNCLASSIFIED))


def semantic_lane() -> Column:
    return rule_table(LANES)


def family(prefix: str) -> Column:
    """Channels of a family; an underscore in the prefix stands for any one character, as in SQL."""
    return F.col("channel").like(f"{prefix}%")


def bucket() -> Column:
    """Status as the desk shows it: what is in the trash is done, if it was archived as done, and trash if deleted or not said."""
    trash = F.col("status") == "trash"
    rules = [("done", trash & (F.col("archive_kind") == "done")), ("trash", trash & F.coalesce(F.col("archive_kind"), F.lit("")).isin("", "deleted"))]
    return F.coalesce(first_match(rules), F.when(~trash, F.col("status")))


def limit_of(n: int | None) -> int:
    """A list's limit, brought between 1 and 500; 200 if none is asked for."""
    return USUAL if n is None else max(LEAST, min(MOST, n))


def checked_limit(n: int) -> int:
    """A limit that has to be right: a whole number from 1 to 500, else an error."""
    if isinstance(n, bool) or not isinstance(n, int) or not LEAST <= n <= MOST:
        raise ValueError(f"a limit is a whole number from {LEAST} to {MOST}, not {n!r}")
    return n


def where_given(df: DataFrame, **values) -> DataFrame:
    """Equality with each value that is not None; the others ask nothing, and add nothing to the plan."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


@dataclass(frozen=True)
class Scope:
    """What a list or count is of; None asks nothing."""

    as_of: str
    route: str | None = None
    days: int | None = None
    family: str | None = None
    not_channel: str | None = None
    path: str | None = None  # TIME_SENSITIVE: that path, or members of a collection; EVERGREEN: that path or members
    least_title: int = 12


def scoped(items: DataFrame, members: DataFrame, s: Scope) -> DataFrame:
    """Rows of the scope. Time is what is known of fetched and published; titles of some length and channels without a sign of the old system count.

    ``members`` (item_id) is met by an existence join, never by a join that repeats rows.
    """
    rows = where_given(items, route=s.route).where(~F.coalesce(F.col("channel"), F.lit("")).contains("@") & (F.length(F.trim("title")) >= s.least_title))
    if s.days is not None:
        rows = rows.where(F.coalesce("fetched", "published") >= F.date_sub(F.lit(s.as_of).cast("date"), s.days))
    if s.family is not None:
        rows = rows.where(family(s.family))
    if s.not_channel is not None:
        rows = rows.where(F.coalesce("channel", F.lit("")) != s.not_channel)
    if s.path is not None:
        held = members.select(F.col("item_id").alias("__member")).distinct()
        rows = rows.join(held, rows["item_id"] == held["__member"], "left").where((effective_path() == s.path) | F.col("__member").isNotNull()).drop("__member")
    return rows
