"""Loading of the tables, and the views under which they stand in for the domain's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reference days: nothing here reads the clock.
ITEMS_AS_OF, EVENTS_AS_OF, ORDERS_AS_OF = "2025-02-15", "2024-01-31", "2001-12-31"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content items: documents with their labels as editorial state; the first line is the title."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    route = F.when(F.col("lang") == "en", "news").when(F.col("lang") == "fr", "research").when(F.col("lang") == "de", "notice")
    status = F.when(F.col("quality").isNull(), "inbox").when(F.col("toxic") == 1, "hold").when(F.col("quality") == 1, "production").otherwise("trash")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"), route.alias("route"), F.col("source").alias("source_id"), F.lower(F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("title"), "text",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("published"), "n_chars", "quality", "toxic", status.alias("status"),
    )


ITEMS_SQL = """items AS (
  SELECT d.doc_id AS item_id, CASE lang WHEN 'en' THEN 'news' WHEN 'fr' THEN 'research' WHEN 'de' THEN 'notice' END AS route,
    source AS source_id, lower(trim(split_part(text, chr(10), 1))) AS title, text,
    DATE '2024-01-01' + CAST(d.doc_id % 400 AS INTEGER) AS published, n_chars, quality, toxic,
    CASE WHEN l.doc_id IS NULL THEN 'inbox' WHEN toxic = 1 THEN 'hold' WHEN quality = 1 THEN 'production' ELSE 'trash' END AS status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation versions: a part's price in a year, as each order line released it; withdrawn lines take no part."""
    rows = load(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_partkey").alias("series_id"), F.year("l_shipdate").cast("long").alias("period"), F.date_format("l_shipdate", "yyyyMMdd").cast("long").alias("release_rank"),
        F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_suppkey").alias("source"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"),
    )


VERSIONS_SQL = """versions AS (
  SELECT l_partkey AS series_id, CAST(year(l_shipdate) AS BIGINT) AS period, CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT) AS release_rank,
    l_orderkey AS release_id, CAST(l_linenumber AS BIGINT) AS line, l_suppkey AS source, l_extendedprice AS value, l_quantity AS quantity, l_returnflag AS flag, l_linestatus AS state
  FROM lineitem)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action log: events by user, with the number in their properties and their day."""
    return load(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("day"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


LOG_SQL = "log AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


#: What the desk adds to an item, as SQL over the items view: channel, how it was acquired, how it was archived, when it was fetched.
DESK = {
    "channel": "CASE item_id % 9 WHEN 0 THEN 'grant_abroad' WHEN 1 THEN 'grants' WHEN 2 THEN 'training' WHEN 3 THEN 'old@desk' ELSE 'general' END",
    "acquisition": "CASE item_id % 6 WHEN 0 THEN 'EVERGREEN' WHEN 1 THEN 'TIME_SENSITIVE' END",
    "archive_kind": "CASE item_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'deleted' WHEN 2 THEN '' END",
    "fetched": "CASE WHEN item_id % 5 <> 0 THEN published + INTERVAL '2' DAY END",
}
#: Items that were taken into the evergreen collection: a table of its own.
MEMBERS_SQL = "members AS (SELECT doc_id AS item_id, 'EVERGREEN' AS temporal_path FROM labels WHERE quality = 1 AND doc_id % 3 = 0)"
DESK_SQL = f"{ITEMS_SQL}, {MEMBERS_SQL}, desk AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in DESK.items())} FROM items)"


def desk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).selectExpr("*", *(f"{e} AS {n}" for n, e in DESK.items()))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").where("quality = 1 AND doc_id % 3 = 0").select(F.col("doc_id").alias("item_id"), F.lit("EVERGREEN").alias("temporal_path"))
