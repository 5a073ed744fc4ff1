"""Where incremental readers go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cursor import next_cursors
from ..sources.tables import LOG_SQL, log
from .health import NOW
from .registry import query

_RUNS = f"""runs AS (SELECT user_id AS reader, CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status, ts AS created_at, ts AS finished_at,
 day - 2 AS since, CASE WHEN k % 3 = 0 THEN concat('p', k) END AS token_out, CASE WHEN k % 7 > 0 THEN day END AS newest, CASE WHEN k % 2 = 0 THEN 'request failed: 400 bad token' ELSE 'request failed: 503' END AS error FROM log WHERE ts <= TIMESTAMP '{NOW}')"""


@query(f"""WITH {LOG_SQL}, {_RUNS}, done AS (SELECT * FROM runs WHERE status = 'COMPLETED' QUALIFY row_number() OVER (PARTITION BY reader ORDER BY finished_at DESC) = 1),
last AS (SELECT reader, status = 'FAILED' AND error LIKE '%request failed: 400 %' AS refused FROM runs WHERE status IN ('COMPLETED', 'FAILED') QUALIFY row_number() OVER (PARTITION BY reader ORDER BY created_at DESC) = 1),
j AS (SELECT r.reader, d.since, d.token_out, d.newest, d.token_out IS NOT NULL AND NOT coalesce(refused, false) AS on_ FROM (SELECT DISTINCT reader FROM runs) r LEFT JOIN done d USING (reader) LEFT JOIN last USING (reader))
SELECT reader, CASE WHEN on_ THEN since ELSE coalesce(newest, since, CAST(DATE '{NOW[:10]}' - 3 AS DATE)) END AS since, CASE WHEN on_ THEN token_out END AS page_token, CASE WHEN on_ THEN newest END AS newest FROM j""")
def next_source_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound, page token and newest date with which each reader's next run begins, decided from its last completed and last finished runs."""
    status = F.when(F.col("event_type").isin("purchase", "signup"), "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise("RUNNING")
    k = F.col("k")
    runs = log(spark, sf_dir).where(F.col("ts") <= F.lit(NOW).cast("timestamp_ntz")).select(
        F.col("user_id").alias("reader"), status.alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("finished_at"), F.date_sub("day", 2).alias("since"), F.when(k % 3 == 0, F.concat(F.lit("p"), k)).alias("token_out"),
        F.when(k % 7 > 0, F.col("day")).alias("newest"), F.when(k % 2 == 0, "request failed: 400 bad token").otherwise("request failed: 503").alias("error"),
    )
    return next_cursors(runs, NOW[:10])
