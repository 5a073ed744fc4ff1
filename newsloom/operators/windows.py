"""Windowed aggregates kept up to date from daily partials whose distinct sets can be merged.

A partial is a row for each selector, day, kind of set and range of 64 numbers, with the numbers seen as the bits of one long; rows of kind ``rows`` count
observations, and their set is the day itself. Bits of any days are united by an OR, so windows of any length, and their distinct counts, are exact merges of
partials: nothing is counted again from observations, and no row is expanded by a distinct count. Identifiers are numbers; near ones share a row.

Observations and partials are dealt by selector into as many parts as their number asks, before anything is grouped: a task holds
about ``PART`` rows however many there are, and no row that it holds is wider than its key and a few numbers.

Batches are appended under their own name, so a batch that is applied again replaces itself. Only touched selectors are worked out again: those of the batch,
and those with a partial on a day that a window takes in or lets go as the reference day moves. What a batch worked out is appended too; a
selector's current windows are those of the last batch that touched it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove

WINDOWS = (7, 30, 90)
#: Rows of one part that a task groups.
PART = 400_000


def dealt(df: DataFrame, keys: Sequence[str], factor: int) -> DataFrame:
    """Rows of a selector together, in parts that hold about ``PART`` rows when each is opened ``factor`` times."""
    parts = max(math.ceil(df.count() * factor / PART), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartition(parts, *keys)


def partials(observations: DataFrame, keys: Sequence[str], sets: Sequence[str], day: str = "day") -> DataFrame:
    """(keys, day, kind, bucket, n, bits): one pass; null members are in no set."""
    member = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("long").alias("id"))
    each = F.explode(F.array(member("rows", F.unix_date(day)), *(member(s, F.col(s)) for s in sets)))
    few = dealt(observations.select(*keys, F.col(day).alias("day"), *sets), keys, 1 + len(sets))
    rows = few.select(*keys, "day", each.alias("m")).select(*keys, "day", "m.kind", "m.id").where((F.col("kind") == "rows") | F.col("id").isNotNull())
    own = rows.groupBy(*keys, "day", "kind", F.shiftright("id", 6).alias("bucket"))
    return own.agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, CAST(id & 63L AS INT))")).alias("bits"))


def merged(parts: DataFrame, keys: Sequence[str], sets: Sequence[str], today: Column, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """(keys, days, n, each set's size, momentum, first_day, last_day, active_days) of every window up to ``today``."""
    age = F.datediff(today, "day")
    near = parts.where((age >= 0) & (age < 2 * max(windows))).select(*keys, "day", "kind", "bucket", "n", "bits")
    opened = near.select("*", F.explode(F.array(*map(F.lit, windows))).alias("days")).where(age < 2 * F.col("days"))
    now = age < F.col("days")
    rows = F.col("kind") == "rows"
    one = opened.groupBy(*keys, "days", "kind", "bucket").agg(
        F.bit_or(F.when(now, F.col("bits"))).alias("bits"), F.sum(F.when(rows & now, F.col("n"))).alias("n"), F.sum(F.when(rows & ~now, F.col("n"))).alias("prior"),
        F.min(F.when(rows & now, F.col("day"))).alias("first_day"), F.max(F.when(rows & now, F.col("day"))).alias("last_day"),
    )
    # a few rows for each window: sizes of its sets, and its days, which lie in few buckets, as bits from the first of these on
    start = F.shiftright(F.unix_date(F.date_sub(today, max(windows))).cast("long"), 6)
    small = one.groupBy(*keys, "days", "kind", F.when(rows, F.col("bucket") - start).alias("at")).agg(F.sum(F.bit_count("bits")).alias("size"), F.max(F.when(rows, F.col("bits"))).alias("bits"), F.sum("n").alias("n"), F.sum("prior").alias("prior"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    seen = F.when(F.col("bits").isNotNull(), F.unhex(F.concat(F.repeat(F.lit("0" * 16), F.col("at").cast("int")), F.lpad(F.hex("bits"), 16, "0"))))
    n, prior = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("prior"), F.lit(0))
    size = lambda s: F.coalesce(F.sum(F.when(F.col("kind") == s, F.col("size"))), F.lit(0)).alias(s)
    return small.groupBy(*keys, "days").agg(n.alias("n"), *map(size, sets), (n - prior).alias("momentum"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.bitmap_count(F.bitmap_or_agg(seen)).alias("active_days")).where("n > 0")


@dataclass(frozen=True)
class WindowStore:
    """Partials and windows in a folder that driver and executors share."""

    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    sets: tuple[str, ...]
    windows: tuple[int, ...] = WINDOWS

    def _read(self, name: str) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}") if there else None

    def _edges(self, before: str, today: str) -> Column:
        """True for days that some window, or the one before it, takes in or lets go between two reference days."""
        crossed = F.lit(False)
        for limit in {0, *self.windows, *(2 * w for w in self.windows)}:
            inside = lambda d, limit=limit: F.datediff(F.lit(d).cast("date"), "day") < limit if limit else F.datediff(F.lit(d).cast("date"), "day") < 0
            crossed = crossed | (inside(before) != inside(today))
        return crossed

    def apply(self, batch: int, observations: DataFrame, today: str, before: str | None = None) -> DataFrame:
        """Take in a batch (numbered in order) and work out what it touches up to ``today``; ``before`` is the reference day of the batch before. Returns the windows that were worked out."""
        partials(observations, self.keys, self.sets).write.mode("overwrite").parquet(f"{self.folder}/partials/batch={batch}")
        parts = self._read("partials").where(F.col("batch") <= batch)
        touched = parts.where(F.col("batch") == batch)
        if before is not None and before != today:
            touched = touched.select(*self.keys).unionAll(parts.where(self._edges(before, today)).select(*self.keys))
        touched = touched.select(*self.keys).distinct()
        own = dealt(parts, self.keys, len(self.windows)).join(touched, list(self.keys), "left_semi")
        out = merged(own, self.keys, self.sets, F.lit(today).cast("date"), self.windows)
        # a selector whose windows are all empty now keeps one row that says so
        gone = touched.join(out.select(*self.keys).distinct(), list(self.keys), "left_anti")
        out.unionByName(gone, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.folder}/windows/batch={batch}")
        return self._read("windows").where((F.col("batch") == batch) & F.col("days").isNotNull()).drop("batch")

    def current(self) -> DataFrame:
        """All selectors' windows."""
        rows = self._read("windows")
        last = rows.groupBy(*self.keys).agg(F.max("batch").alias("batch"))
        return rows.join(last, [*self.keys, "batch"]).where(F.col("days").isNotNull()).drop("batch")

    def clear(self) -> None:
        remove(self.spark, self.folder)
