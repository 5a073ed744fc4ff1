"""The desk's read path: paths, lanes, families, buckets, scoped lists and counts, views, and the full item upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import case_sql
from ..operators import scope as S
from ..operators.upsert import planned
from ..sources.tables import DESK_SQL, ITEMS_AS_OF, LOG_SQL, desk, items, load, members
from .registry import query

_PATH = f"coalesce(acquisition, {case_sql(S.PATHS)}, 'UNCLASSIFIED')"
_BUCKET = "CASE WHEN status <> 'trash' THEN status WHEN archive_kind = 'done' THEN 'done' WHEN coalesce(archive_kind, '') IN ('', 'deleted') THEN 'trash' END"


@query(f"WITH {DESK_SQL} SELECT item_id, {_PATH} AS path FROM desk")
def effective_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk(spark, sf_dir).select("item_id", S.effective_path().alias("path"))


@query(f"WITH {DESK_SQL} SELECT item_id, {case_sql(S.LANES)} AS lane FROM desk")
def semantic_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk(spark, sf_dir).select("item_id", S.semantic_lane().alias("lane"))


@query(f"WITH {DESK_SQL} SELECT item_id, channel FROM desk WHERE channel LIKE 'grant_%'")
def family_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk(spark, sf_dir).where(S.family("grant_")).select("item_id", "channel")


@query(f"WITH {DESK_SQL} SELECT coalesce(route, 'unclassified') AS route, {_BUCKET} AS bucket, count(*) AS n FROM desk GROUP BY ALL")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by route and bucket, where the trash divides into what is done and what was thrown away."""
    return desk(spark, sf_dir).groupBy(F.coalesce("route", F.lit("unclassified")).alias("route"), S.bucket().alias("bucket")).agg(F.count("*").alias("n"))


_SCOPED = f"""scoped AS (SELECT * FROM desk WHERE route = 'news' AND NOT contains(coalesce(channel, ''), '@') AND length(trim(title)) >= 12 AND coalesce(fetched, published) >= DATE '{ITEMS_AS_OF}' - INTERVAL 300 DAY
 AND coalesce(channel, '') <> 'training' AND ({_PATH} = 'TIME_SENSITIVE' OR EXISTS (SELECT 1 FROM members m WHERE m.item_id = desk.item_id)))"""
_NEWS = S.Scope(ITEMS_AS_OF, route="news", days=300, not_channel="training", path="TIME_SENSITIVE")


@query(f"WITH {DESK_SQL}, {_SCOPED} SELECT item_id, title, published, {_BUCKET} AS bucket FROM scoped ORDER BY published DESC, item_id DESC LIMIT 100")
def scope_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred of a scope: the limit is the feature."""
    rows = S.scoped(desk(spark, sf_dir), members(spark, sf_dir), _NEWS)
    return rows.select("item_id", "title", "published", S.bucket().alias("bucket")).orderBy(F.desc("published"), F.desc("item_id")).limit(S.limit_of(100))


@query(f"WITH {DESK_SQL}, {_SCOPED} SELECT {_BUCKET} AS bucket, count(*) AS n FROM scoped GROUP BY 1")
def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the very scope that the list shows."""
    return S.scoped(desk(spark, sf_dir), members(spark, sf_dir), _NEWS).groupBy(S.bucket().alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {DESK_SQL} SELECT count(*) FILTER (WHERE {_PATH} = 'TIME_SENSITIVE' OR m.item_id IS NOT NULL) AS time_sensitive, count(*) FILTER (WHERE {_PATH} = 'EVERGREEN' OR m.item_id IS NOT NULL) AS evergreen, count(*) FILTER (WHERE {_PATH} = 'EVERGREEN' OR m.item_id IS NOT NULL AND {_BUCKET} = 'production') AS evergreen_view FROM desk LEFT JOIN members m USING (item_id)")
def temporal_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of either path, where members of the collection belong to both; and of the evergreen view, which shows members only once produced."""
    held = members(spark, sf_dir).select("item_id", F.lit(True).alias("member"))
    rows = desk(spark, sf_dir).join(held, "item_id", "left").select(S.effective_path().alias("path"), F.coalesce("member", F.lit(False)).alias("member"), S.bucket().alias("bucket"))
    path = F.col("path")
    return rows.agg(F.count_if((path == "TIME_SENSITIVE") | F.col("member")).alias("time_sensitive"), F.count_if((path == "EVERGREEN") | F.col("member")).alias("evergreen"), F.count_if((path == "EVERGREEN") | F.col("member") & (F.col("bucket") == "production")).alias("evergreen_view"))


@query(f"""WITH {DESK_SQL}, {LOG_SQL.replace('log AS', 'props AS')} SELECT d.item_id, d.title, CASE WHEN m.item_id IS NOT NULL THEN 'EVERGREEN' ELSE {_PATH} END AS path, m.item_id IS NOT NULL AS via_membership, {case_sql(S.LANES)} AS lane, {_BUCKET} AS bucket, coalesce(p.k, -1) AS evidence
FROM desk d LEFT JOIN members m USING (item_id) LEFT JOIN props p ON p.event_id = d.item_id AND p.event_type <> 'error'""")
def item_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as they are shown: three left joins, JSON read with a fallback, and membership above the path.

    The right sides are filtered before they are joined, so items without evidence stay.
    """
    held = members(spark, sf_dir).select("item_id", F.col("temporal_path").alias("held"))
    evidence = load(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("event_id").alias("item_id"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    rows = desk(spark, sf_dir).join(held, "item_id", "left").join(evidence, "item_id", "left")
    return rows.select("item_id", "title", F.coalesce("held", S.effective_path()).alias("path"), F.col("held").isNotNull().alias("via_membership"), S.semantic_lane().alias("lane"), S.bucket().alias("bucket"), F.coalesce("k", F.lit(-1)).alias("evidence"))


@query(f"WITH {DESK_SQL} SELECT item_id, source_id FROM desk WHERE route = 'notice' AND channel = 'general'")
def given_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional parameters: those that are None add nothing to the plan."""
    return S.where_given(desk(spark, sf_dir), route="notice", source_id=None, channel="general", status=None).select("item_id", "source_id")


_PRINTED = "CASE item_id % 5 WHEN 0 THEN concat('on ', CAST(published AS VARCHAR(10))) WHEN 1 THEN 'undated' WHEN 2 THEN NULL ELSE CAST(published AS VARCHAR(10)) END"


@query(f"WITH {DESK_SQL}, p AS (SELECT item_id, {_PRINTED} AS printed FROM desk) SELECT item_id, printed FROM p WHERE printed GLOB '[0-9][0-9][0-9][0-9]-*'")
def dated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose printed day begins like an ISO date."""
    return desk(spark, sf_dir).selectExpr("item_id", f"{_PRINTED} AS printed").where(F.col("printed").rlike("^[0-9]{4}-"))


@query(f"WITH {DESK_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE route IS NULL AND acquisition IS NULL) AS without_route, count(*) FILTER (WHERE NOT (route IS NULL AND acquisition IS NULL)) AS old_channel FROM desk WHERE (route IS NULL AND acquisition IS NULL OR contains(channel, '@') AND status = 'inbox') AND NOT EXISTS (SELECT 1 FROM members m WHERE m.item_id = desk.item_id)")
def unclassified_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclassified items by both branches: without route or word at acquisition, and from the old system, still in the inbox; no members."""
    bare = F.col("route").isNull() & F.col("acquisition").isNull()
    rows = desk(spark, sf_dir).where(bare | F.col("channel").contains("@") & (F.col("status") == "inbox")).join(members(spark, sf_dir), "item_id", "left_anti")
    return rows.agg(F.count("*").alias("n"), F.count_if(bare).alias("without_route"), F.count_if(~bare).alias("old_channel"))


#: The store and an arriving batch, as SQL over the items view.
_STORE = {
    "stored_id": "item_id", "dedupe_key": "concat('u', item_id)", "work_id": "CASE WHEN item_id % 5 = 0 THEN concat('w', item_id) WHEN item_id % 5 = 1 THEN concat('p', item_id) END",
    "title": "CASE WHEN item_id % 7 = 0 THEN concat('enriched ', title) ELSE title END", "original_title": "title", "enriched": "item_id % 7 = 0",
    "published": "CASE WHEN item_id % 4 <> 0 THEN published END", "url": "CASE WHEN item_id % 6 <> 0 THEN concat('https://x.org/', item_id) END",
}
_BATCH = {
    "arrival": "item_id", "dedupe_key": "CASE item_id % 10 WHEN 0 THEN concat('x', item_id) WHEN 5 THEN concat('y', item_id) ELSE concat('u', item_id) END",
    "work_id": "CASE WHEN item_id % 5 = 0 THEN concat('w', item_id) WHEN item_id % 10 = 6 THEN concat('u', item_id) END",
    "title": "CASE WHEN item_id % 8 = 0 THEN concat(title, ' (update)') ELSE title END", "published": "published", "url": "concat('https://x.org/', item_id)",
}
_columns = lambda d: ", ".join(f"{e} AS {n}" for n, e in d.items())


@query(f"""WITH {DESK_SQL}, store AS (SELECT {_columns(_STORE)} FROM items WHERE item_id % 3 <> 0), batch AS (SELECT {_columns(_BATCH)} FROM items),
 hits AS (SELECT arrival, stored_id, 0 AS r FROM batch JOIN store USING (dedupe_key) UNION ALL SELECT arrival, stored_id, 1 FROM batch JOIN store USING (work_id) UNION ALL SELECT arrival, stored_id, 2 FROM batch JOIN store ON batch.work_id = store.dedupe_key),
 best AS (SELECT arrival, arg_min(stored_id, (r, stored_id)) AS stored_id FROM hits GROUP BY arrival), one AS (SELECT min(arrival) AS arrival, stored_id FROM best GROUP BY stored_id),
 m AS (SELECT b.arrival, s.stored_id, b.title AS new_title, s.title AS old_title, coalesce(s.enriched, false) AS enriched, s.original_title, b.published AS new_day, s.published AS old_day, b.url AS new_url, s.url AS old_url, s.stored_id IS NULL AS fresh
   FROM batch b LEFT JOIN one o USING (arrival) LEFT JOIN store s ON s.stored_id = o.stored_id WHERE b.arrival IN (SELECT arrival FROM one) OR b.arrival NOT IN (SELECT arrival FROM best))
SELECT arrival, stored_id, CASE WHEN fresh AND (length(trim(new_title)) < 12 OR new_day > DATE '{ITEMS_AS_OF}') THEN 'refused' WHEN fresh THEN 'insert' WHEN new_title IS DISTINCT FROM original_title THEN 'full' WHEN old_day IS NULL AND new_day IS NOT NULL OR old_url IS NULL AND new_url IS NOT NULL THEN 'meta' ELSE 'none' END AS action,
 CASE WHEN enriched THEN old_title ELSE new_title END AS title, coalesce(old_day, new_day) AS published, coalesce(old_url, new_url) AS url FROM m""")
def item_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch does to the store: lookup by three keys, refused, inserted or merged, with frozen days and wording."""
    rows = items(spark, sf_dir)
    store = rows.where("item_id % 3 <> 0").selectExpr(*(f"{e} AS {n}" for n, e in _STORE.items()))
    batch = rows.selectExpr(*(f"{e} AS {n}" for n, e in _BATCH.items()))
    return planned(batch, store, refused=f"length(trim(title)) < 12 OR published > DATE '{ITEMS_AS_OF}'")
