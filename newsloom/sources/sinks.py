"""Writing results so that a repeated run changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch replaces its own ``batch_id`` partition, so a batch that runs again is written once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return put


def with_artifact_id(rows: DataFrame, content: str) -> DataFrame:
    """Content-addressed: equal bytes have equal ids, and one row is kept for each."""
    return rows.withColumn("artifact_id", F.concat(F.lit("art_"), F.sha2(F.col(content), 256))).dropDuplicates(["artifact_id"])


def outbox(events: DataFrame, sent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events that have not been sent, once by the hash of their keys."""
    key = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)), 256)
    return events.withColumn("dedupe_key", key).dropDuplicates(["dedupe_key"]).join(sent.select("dedupe_key"), "dedupe_key", "left_anti")


def changed_snapshots(new: DataFrame, latest: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Snapshots whose fingerprint differs from the latest one of their key."""
    old = latest.select(F.col(key).alias("__key"), F.col(fingerprint).alias("__fp"))
    return new.join(old, (new[key] == F.col("__key")) & (new[fingerprint] == F.col("__fp")), "left_anti")
