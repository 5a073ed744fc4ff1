"""Identities, clusters, aliases, evidence and facets of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import survivors
from ..sources.tables import ITEMS_SQL, LOG_SQL, items, load, log
from .registry import query

#: Fixed value: the alphabet of RFC 4648, and the digits that Spark and others write in base 32.
BASE32, DIGITS = "abcdefghijklmnopqrstuvwxyz234567", "0123456789abcdefghijklmnopqrstuv"


def base32(hexes: Column, groups: int = 4) -> Column:
    """The first ``groups`` times 20 bits of a hexadecimal text in base 32."""
    parts = [F.lpad(F.lower(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(groups)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def escaped(c: Column) -> Column:
    """A component of a key in which the separators are escaped."""
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")), F.lit("="), F.lit("%3D"))


@query(f"SELECT p_partkey, concat('brand=', replace(p_brand, '#', '|#'), '|type=', p_type) AS raw, concat('brand=', replace(replace(replace(replace(p_brand, '#', '|#'), '%', '%25'), '|', '%7C'), '=', '%3D'), '|type=', p_type) AS series_key, concat('ser_', translate(concat({', '.join(f'''lower(to_base(CAST('0x' || substr(sha256(concat('k', p_partkey)), {5 * i + 1}, 5) AS BIGINT), 32, 4))''' for i in range(4))}), '{DIGITS}', '{BASE32}')) AS series_id FROM part")
def series_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical keys with escaped components, and short identifiers in base 32."""
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit("|#"))
    raw = F.concat(F.lit("brand="), brand, F.lit("|type="), "p_type")
    key = F.concat(F.lit("brand="), escaped(brand), F.lit("|type="), escaped(F.col("p_type")))
    return load(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), key.alias("series_key"), F.concat(F.lit("ser_"), base32(F.sha2(F.concat(F.lit("k"), "p_partkey"), 256))).alias("series_id"))


@query(f"""WITH {ITEMS_SQL}, f AS (SELECT sha256(text) AS fp, item_id, published FROM items), old AS (SELECT fp, min(item_id) AS cluster_id FROM f WHERE item_id % 4 = 0 GROUP BY fp), g AS (SELECT fp, count(*) AS members, min(item_id) AS least, arg_min(item_id, (published, item_id)) AS representative FROM f GROUP BY fp HAVING count(*) >= 2)
SELECT coalesce(cluster_id, least) AS cluster_id, cluster_id IS NOT NULL AS reused, members, representative FROM g LEFT JOIN old USING (fp)""")
def cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of equal texts: the least id that a cluster had before is used again, and the earliest member represents it."""
    f = items(spark, sf_dir).select(F.sha2("text", 256).alias("fp"), "item_id", "published")
    old = f.where("item_id % 4 = 0").groupBy("fp").agg(F.min("item_id").alias("cluster_id"))
    g = f.groupBy("fp").agg(F.count("*").alias("members"), F.min("item_id").alias("least"), F.min(F.struct("published", "item_id")).alias("r")).where("members >= 2")
    return g.join(old, "fp", "left").select(F.coalesce("cluster_id", "least").alias("cluster_id"), F.col("cluster_id").isNotNull().alias("reused"), "members", F.col("r.item_id").alias("representative"))


@query("""WITH a AS (SELECT concat('name ', c_custkey % 200) AS alias, c_custkey AS id FROM customer), t AS (SELECT id, CASE WHEN id % 6 IN (1, 2, 3) THEN id - id % 6 ELSE id END AS survivor FROM (SELECT DISTINCT id FROM a)) SELECT alias, count(DISTINCT survivor) AS survivors, CASE WHEN count(DISTINCT survivor) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN count(DISTINCT survivor) = 1 THEN min(survivor) END AS id FROM a JOIN t USING (id) GROUP BY alias""")
def alias_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases resolved through merges to what survives; several survivors are ambiguous and give none.

    Identities 6n + 3, + 2 and + 1 were merged one into the next, the last into 6n: chains that are followed to their end.
    """
    a = load(spark, sf_dir, "customer").select(F.concat(F.lit("name "), F.col("c_custkey") % 200).alias("alias"), F.col("c_custkey").alias("id"))
    merged = a.select("id").distinct().where((F.col("id") % 6).between(1, 3)).select("id", (F.col("id") - 1).alias("resolved_to"))
    ends = a.join(survivors(merged), "id", "left").select("alias", F.coalesce("survivor", "id").alias("survivor"))
    n = F.countDistinct("survivor")
    return ends.groupBy("alias").agg(n.alias("survivors"), F.when(n == 1, "resolved").otherwise("ambiguous").alias("outcome"), F.when(n == 1, F.min("survivor")).alias("id"))


@query(f"""WITH {LOG_SQL}, claims AS (SELECT event_id AS claim, k AS link, user_id FROM log WHERE event_type = 'purchase') SELECT claim, CASE WHEN p_partkey IS NULL THEN 'no_link' WHEN d.doc_id IS NULL THEN 'no_evidence' WHEN l.doc_id IS NULL THEN 'no_item' WHEN s.s_suppkey IS NULL THEN 'no_feed' WHEN n.n_nationkey IS NULL THEN 'no_origin' ELSE 'whole' END AS chain FROM claims c
 LEFT JOIN part ON p_partkey = c.link AND p_partkey % 9 <> 0 LEFT JOIN documents d ON d.doc_id = p_partkey AND d.lang <> 'es' LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN supplier s ON s.s_suppkey = d.doc_id % 12 LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_regionkey <> 2""")
def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's chain through link, evidence, item, feed and origin, and where it breaks first."""
    c = log(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("claim"), F.col("k").alias("link"))
    mark = lambda df, key, name, value=None: df.select(F.col(key).alias("__k"), (F.col(value) if value else F.lit(True)).alias(name))
    link = mark(load(spark, sf_dir, "part").where("p_partkey % 9 <> 0"), "p_partkey", "link_ok")
    evidence = mark(load(spark, sf_dir, "documents").where("lang <> 'es'"), "doc_id", "evidence_ok")
    item = mark(load(spark, sf_dir, "labels").dropDuplicates(["doc_id"]), "doc_id", "item_ok")
    feed = mark(load(spark, sf_dir, "supplier"), "s_suppkey", "nation", "s_nationkey")
    origin = mark(load(spark, sf_dir, "nation").where("n_regionkey <> 2"), "n_nationkey", "origin_ok")
    rows = c
    for other, key in ((link, F.col("link")), (evidence, F.col("link")), (item, F.col("link")), (feed, F.col("link") % 12), (origin, F.col("nation"))):
        rows = rows.join(other, key == other["__k"], "left").drop("__k")
    chain = F.when(F.col("link_ok").isNull(), "no_link").when(F.col("evidence_ok").isNull(), "no_evidence").when(F.col("item_ok").isNull(), "no_item").when(F.col("nation").isNull(), "no_feed").when(F.col("origin_ok").isNull(), "no_origin").otherwise("whole")
    return rows.select("claim", chain.alias("chain"))


@query(f"""WITH {LOG_SQL}, o AS (SELECT user_id % 40 AS concept, k AS unit, user_id % 3 AS geo, event_type AS platform, user_id, value >= 20 AS commercial, (ts, event_id) AS seen FROM log), u AS (SELECT concept, unit, arg_min(commercial, seen) AS commercial FROM o GROUP BY ALL), c AS (SELECT concept, count(*) AS units, count(*) FILTER (WHERE commercial) AS commercial_units FROM u GROUP BY 1), f AS (SELECT concept, platform, count(DISTINCT unit) AS n FROM o GROUP BY ALL), m AS (SELECT concept, max(n) AS most, CAST(sum(n) AS BIGINT) AS over_families FROM f GROUP BY 1)
SELECT concept, units, commercial_units, round(CAST(commercial_units AS DOUBLE) / units, 6) AS commercial_share, geos, platforms, actors, most, over_families FROM c JOIN m USING (concept) JOIN (SELECT concept, count(DISTINCT geo) AS geos, count(DISTINCT platform) AS platforms, count(DISTINCT user_id) AS actors FROM o GROUP BY 1) USING (concept)""")
def signal_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per concept: origin units and how many are commercial by the first context seen, geographies, platforms, actors, and origins by family."""
    o = log(spark, sf_dir).select((F.col("user_id") % 40).alias("concept"), F.col("k").alias("unit"), (F.col("user_id") % 3).alias("geo"), F.col("event_type").alias("platform"), "user_id", (F.col("value") >= 20).alias("commercial"), F.struct("ts", "event_id").alias("at"))
    u = o.groupBy("concept", "unit").agg(F.min(F.struct("at", "commercial")).alias("f"))
    c = u.groupBy("concept").agg(F.count("*").alias("units"), F.count_if(F.col("f.commercial")).alias("commercial_units"))
    f = o.groupBy("concept", "platform").agg(F.countDistinct("unit").alias("n")).groupBy("concept").agg(F.max("n").alias("most"), F.sum("n").alias("over_families"), F.count("*").alias("platforms"))
    who = o.select("concept", "geo", "user_id").distinct().groupBy("concept").agg(F.countDistinct("geo").alias("geos"), F.countDistinct("user_id").alias("actors"))
    return c.join(f, "concept").join(who, "concept").select("concept", "units", "commercial_units", F.round(F.col("commercial_units") / F.col("units"), 6).alias("commercial_share"), "geos", "platforms", "actors", "most", "over_families")
