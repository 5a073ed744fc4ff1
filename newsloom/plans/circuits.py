"""Circuits of sources, from the whole log and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove, shared_dir, written
from ..sources.tables import LOG_SQL
from ..streaming.circuits import PLATFORM, STORE, TRANSIENT, circuit_stream, circuits
from ..streaming.signals import table_stream
from .health import NOW
from .registry import query

_RUNS = "SELECT CAST(user_id AS VARCHAR) AS source, ts, event_type, k FROM log WHERE event_type IN ('purchase', 'signup', 'error')"
_CIRCUITS = f"""WITH {LOG_SQL}, runs AS ({_RUNS} AND ts <= TIMESTAMP '{NOW}'), good AS (SELECT source, max(ts) FILTER (WHERE event_type <> 'error') AS good FROM runs GROUP BY 1),
after AS (SELECT r.* FROM runs r JOIN good g USING (source) WHERE event_type = 'error' AND (good IS NULL OR ts > good)),
own AS (SELECT source, count(*) AS n, max(ts) AS failed_at, bool_or(k % 10 = 0) AS permanent FROM after GROUP BY 1)
SELECT source, CASE WHEN n IS NULL THEN 'CLOSED' WHEN permanent THEN 'OPEN' WHEN n < 3 THEN 'CLOSED' WHEN failed_at + INTERVAL 6 HOUR <= TIMESTAMP '{NOW}' THEN 'HALF_OPEN' ELSE 'OPEN' END AS state, CAST(coalesce(n, 0) AS INTEGER) AS failures FROM good LEFT JOIN own USING (source)"""


def _runs(rows: DataFrame) -> DataFrame:
    """Runs of users as sources, for a table or a stream of events: a purchase or signup is completed, an error failed, its class by the number in its properties."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(k % 10 == 0, "AUTH_FAILURE").when(k % 10 == 1, PLATFORM).otherwise(TRANSIENT)
    failed = F.col("event_type") == "error"
    at = F.col("ts").cast("timestamp")
    rows = rows.where(F.col("event_type").isin("purchase", "signup", "error") & (at <= F.lit(NOW).cast("timestamp")))
    return rows.select(F.col("user_id").cast("string").alias("source"), F.unix_micros(at).alias("run"), at.alias("at"), F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"), F.when(failed, kind).alias("failure"))


@query(_CIRCUITS)
def circuit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's circuit at one moment, from its whole log."""
    return circuits(_runs(spark.read.parquet(f"{sf_dir}/events.parquet")), NOW).select("source", "state", "failures")


@query(_CIRCUITS)
def stream_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same circuits carried as stream state with timers: the last change of each source, once the stream has read what is there."""
    path = f"{sf_dir}/events.parquet"
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        changes = circuit_stream(_runs(table_stream(spark, path)))
        changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    newest = written(spark.read.parquet(f"{folder}/out").groupBy("source").agg(F.max_by(F.struct("state", "failures", "probe_after"), "at").alias("c")))
    remove(spark, folder)
    # a cooldown that ends after the last row of the stream ends here
    state = F.when((F.col("c.state") == "OPEN") & (F.col("c.probe_after") <= F.lit(NOW).cast("timestamp")), "HALF_OPEN").otherwise(F.col("c.state"))
    return newest.select("source", state.alias("state"), "c.failures")
