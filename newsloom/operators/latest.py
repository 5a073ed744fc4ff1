"""Latest-wins, streaks and budgets over ordered groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ties: str = "one") -> DataFrame:
    """Rows that come first in ``order`` within their keys; ``ties='all'`` keeps every row that ties.

    ``one`` is an aggregate where possible at the call site (``max_by``); here it is a ranking, which Spark cuts
    before the shuffle by its window group limit.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rank = F.rank() if ties == "all" else F.row_number()
    return df.withColumn("__rank", rank.over(w)).where("__rank = 1").drop("__rank")


def winner(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the largest ``order`` tuple in each group: one partial aggregate, no sort."""
    best = F.max(F.struct(*(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), *values)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__best.{v}").alias(v) for v in values))


def leading_streak(df: DataFrame, keys: Sequence[str], order: Sequence[str], broken_by: Column) -> DataFrame:
    """(keys, streak): rows later by ``order`` than the last one for which ``broken_by`` holds.

    The last breaking row of each key, then a count of what is newer: two aggregates that combine on the map side, so a key
    with a long history is never sorted in one task. Columns of the order hold no nulls.
    """
    place = F.struct(*order)
    rows = df.select(*keys, place.alias("__at"), broken_by.alias("__broken"))
    last = rows.groupBy(*keys).agg(F.max(F.when(F.col("__broken"), F.col("__at"))).alias("__last"))
    newer = F.count_if(F.col("__last").isNull() | (F.col("__at") > F.col("__last")))
    return rows.join(last, list(keys)).groupBy(*keys).agg(newer.alias("streak"))


def with_first(df: DataFrame, key: str, value: str, name: str = "first") -> DataFrame:
    """Rows with the least ``value`` of their key: an aggregate that combines on the map side and a join, so a key that very many rows share is not one window."""
    return df.join(df.groupBy(key).agg(F.min(value).alias(name)), key, "left")


def within_budget(df: DataFrame, order: Sequence[Column], cost: str, budget: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose running cost stays within the budget, in order, within their keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_cost", F.sum(cost).over(w)).where(F.col("running_cost") <= budget)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(rank) <= n)


def spread(df: DataFrame, target: str, family: str, unit: str, rank: Column, families: Sequence[str], cap: int, values: Sequence[str] = ()) -> DataFrame:
    """(target, family, unit, values) of the rows that a pass over each target's rows by ``rank`` takes: no unit twice, at most ``cap`` of a family.

    A row whose family is full leaves its unit free for another family, so the pass is one fold. It reads few rows: the first
    of each (family, unit), and of these the first cap x families of a family, as no more than that many units can be taken.
    Both cuts are exact and made before the shuffle, so a hot target sends each task's few best rows. Rows of other families
    take no part; null units are one unit.
    """
    rows = df.where(F.col(family).isin(*families)).groupBy(target, family, unit).agg(F.min(F.struct(rank.alias("rank"), *values)).alias("first"))
    place = F.row_number().over(Window.partitionBy(target, family).orderBy("first.rank"))
    few = rows.withColumn("__place", place).where(F.col("__place") <= cap * len(families))
    one = F.struct(F.col("first.rank").alias("rank"), F.col(family).alias("family"), F.col(unit).alias("unit"), F.struct(*(F.col(f"first.{v}").alias(v) for v in values), F.lit(True).alias("__taken")).alias("values"))
    listed = few.groupBy(target).agg(F.array_sort(F.collect_list(one)).alias("rows"))

    def step(taken: Column, x: Column) -> Column:
        room = F.size(F.filter(taken, lambda t: t["family"] == x["family"])) < cap
        return F.when(room & ~F.exists(taken, lambda t: t["unit"].eqNullSafe(x["unit"])), F.array_append(taken, x)).otherwise(taken)

    taken = F.aggregate("rows", F.slice("rows", 1, 0), step)
    return listed.select(target, F.explode(taken).alias("t")).select(target, F.col("t.family").alias(family), F.col("t.unit").alias(unit), *(F.col(f"t.values.{v}").alias(v) for v in values))
