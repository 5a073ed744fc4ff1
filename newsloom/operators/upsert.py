"""Merging a batch of incoming rows into the rows there are, without a mutable table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(existing: DataFrame, incoming: DataFrame, key: str, *, arrival: str, replaced: Sequence[str], filled: Sequence[str], fixed: Sequence[str]) -> DataFrame:
    """One generation from two: all rows of ``existing`` with the first arrival of each key merged in, and an ``action``.

    ``replaced`` columns take the incoming value where it is not null, ``filled`` only where the old one
    is null, ``fixed`` never once they are set. action: ``insert``, ``full`` (a replaced column changed),
    ``meta`` (only filled ones did) or ``none``.
    """
    first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(arrival))).where("__n = 1")
    new = first.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in (*replaced, *filled, *fixed)))
    both = existing.withColumn("__old", F.lit(True)).join(new, existing[key] == F.col("__key"), "full_outer")
    changed = lambda columns: F.greatest(F.lit(False), F.lit(False), *columns)
    full = changed([F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)) for c in replaced])
    meta = changed([F.col(c).isNull() & F.col(f"__{c}").isNotNull() for c in (*filled, *fixed)])
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__key").isNull(), "none").when(full, "full").when(meta, "meta").otherwise("none")
    return both.select(F.coalesce(key, "__key").alias(key), *(F.coalesce(f"__{c}", c).alias(c) for c in replaced), *(F.coalesce(c, f"__{c}").alias(c) for c in (*filled, *fixed)), action.alias("action"))


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is new, one of each key."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def conflicts(df: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys that occur with more than one content."""
    return df.groupBy(*keys).agg(F.countDistinct(F.struct(*content)).alias("contents")).where("contents > 1")


def resolved(batch: DataFrame, store: DataFrame) -> DataFrame:
    """(arrival, stored_id): the row of the store that each arriving row means, by dedupe key, else by work, else where the work is a dedupe key.

    Three equi-joins and one aggregate; of several stored rows under one key the least id.
    """
    pair = lambda left, right, rank: batch.select("arrival", F.col(left).alias("__key")).join(store.select("stored_id", F.col(right).alias("__key")), "__key").select("arrival", F.struct(F.lit(rank).alias("r"), "stored_id").alias("hit"))
    hits = pair("dedupe_key", "dedupe_key", 0).unionAll(pair("work_id", "work_id", 1)).unionAll(pair("work_id", "dedupe_key", 2))
    return hits.groupBy("arrival").agg(F.min("hit").alias("hit")).select("arrival", "hit.stored_id")


def planned(batch: DataFrame, store: DataFrame, *, refused: str) -> DataFrame:
    """(arrival, stored_id, action, title, published, url) of every arriving row that decides something.

    Of several rows that mean one stored row the first decides. Known rows: a changed title makes a ``full`` update, filled gaps a
    ``meta`` update, else ``none``; rows that were enriched are compared by their original title and keep their wording; a day or URL, once
    set, stays. Unknown rows are inserted, or refused where the SQL condition ``refused`` holds.
    """
    hits = resolved(batch, store)
    first = hits.groupBy("stored_id").agg(F.min("arrival").alias("arrival"))
    known = hits.select("arrival").join(first.select("arrival", "stored_id"), "arrival", "left").select("arrival", "stored_id", F.lit(True).alias("known"))
    old = store.select("stored_id", F.col("title").alias("old_title"), "original_title", "enriched", F.col("published").alias("old_day"), F.col("url").alias("old_url"))
    rows = batch.select("arrival", "title", "published", "url", F.expr(refused).alias("refused")).join(known, "arrival", "left").where("known is null or stored_id is not null").join(old, "stored_id", "left")
    gap = lambda a, b: F.col(a).isNull() & F.col(b).isNotNull()
    fresh = F.col("stored_id").isNull()
    action = F.when(fresh & F.col("refused"), "refused").when(fresh, "insert").when(~F.col("title").eqNullSafe(F.col("original_title")), "full").when(gap("old_day", "published") | gap("old_url", "url"), "meta").otherwise("none")
    return rows.select("arrival", "stored_id", action.alias("action"), F.when(F.coalesce("enriched", F.lit(False)), F.col("old_title")).otherwise(F.col("title")).alias("title"), F.coalesce("old_day", "published").alias("published"), F.coalesce("old_url", "url").alias("url"))
