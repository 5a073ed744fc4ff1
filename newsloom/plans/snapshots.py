"""From observations to snapshots in one chain, with the checks that a snapshot has to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import case_sql, code_table, codes_sql, rule_table
from ..functions.text import fingerprint
from ..operators.latest import top_per_group, winner
from ..sources.tables import EVENTS_AS_OF, LOG_SQL, VERSIONS_SQL, load, log, versions
from .registry import query
from .signals import windowed

#: What speaks for a candidate, which class it is, and by which route it is promoted.
REASONS = (("convergence", "families >= 4"), ("persistence", "active_days >= 8"), ("momentum", "momentum > 0"), ("breadth", "units >= 20"))
CLASSES = (("CORRECTIVE", "momentum < 0 AND families >= 5"), ("FRONTIER", "families = 1"), ("STRONG", "families >= 4 AND active_days >= 10"), ("EMERGING", "families >= 2"))
_CHAIN = f"""e AS (SELECT user_id % 60 AS concept, k AS unit, event_type AS family, max_by(day, (ts, event_id)) AS day, max_by(value, (ts, event_id)) AS value, max_by(event_id, (ts, event_id)) AS event_id FROM log GROUP BY ALL),
 w AS (SELECT concept, CAST(d.days AS INTEGER) AS days, count(*) FILTER (WHERE day > DATE '{EVENTS_AS_OF}' - d.days) AS n, count(*) FILTER (WHERE day <= DATE '{EVENTS_AS_OF}' - d.days) AS before, count(DISTINCT unit) FILTER (WHERE day > DATE '{EVENTS_AS_OF}' - d.days) AS units, count(DISTINCT family) FILTER (WHERE day > DATE '{EVENTS_AS_OF}' - d.days) AS families, count(DISTINCT day) FILTER (WHERE day > DATE '{EVENTS_AS_OF}' - d.days) AS active_days
   FROM e CROSS JOIN (VALUES (7), (30), (90)) d(days) WHERE day > DATE '{EVENTS_AS_OF}' - 2 * d.days AND day <= DATE '{EVENTS_AS_OF}' GROUP BY ALL), a AS (SELECT concept, days, n, units, families, active_days, n - before AS momentum FROM w WHERE n > 0)"""


def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest observation of each concept, origin unit and family."""
    rows = log(spark, sf_dir).select((F.col("user_id") % 60).alias("concept"), F.col("k").alias("unit"), F.col("event_type").alias("family"), "ts", "event_id", "day", "value")
    return winner(rows.withColumn("at", F.col("ts")), ["concept", "unit", "family"], ["at", "event_id"], ["event_id", "day", "value"])


def aggregates(observations: DataFrame) -> DataFrame:
    """Volume, origin units, families, active days and momentum of each concept and window."""
    now = lambda c: F.when(F.col("prior") == 0, F.col(c))
    n = F.count_if(F.col("prior") == 0)
    return windowed(observations).groupBy("concept", "days").agg(n.alias("n"), F.countDistinct(now("unit")).alias("units"), F.countDistinct(now("family")).alias("families"), F.countDistinct(now("day")).alias("active_days"), (n - F.count_if(F.col("prior") == 1)).alias("momentum")).where("n > 0")


@query(f"""WITH {LOG_SQL}, {_CHAIN}, b AS (SELECT concept, arg_max(a, (units, days)) AS m FROM a GROUP BY concept), c AS (SELECT concept, m.days AS days, m.units AS units, m.families AS families, m.active_days AS active_days, m.momentum AS momentum FROM b WHERE m.units >= 10)
SELECT concept, days, units, {codes_sql(REASONS)} AS reasons, {case_sql(CLASSES, 'WEAK')} AS class, CASE WHEN families > 1 THEN 'convergence' WHEN families = 1 THEN 'frontier' END AS route, sha256(concat_ws(chr(31), CAST(concept AS VARCHAR), CAST(days AS VARCHAR), CAST(units AS VARCHAR), CAST(families AS VARCHAR))) AS fingerprint FROM c""")
def candidate_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: effective observations, windows, the gate on independent units, the strongest window of each candidate, its reasons, class, route and fingerprint."""
    a = aggregates(effective(spark, sf_dir))
    best = a.groupBy("concept").agg(F.max(F.struct("units", "days", "families", "active_days", "momentum")).alias("m")).where("m.units >= 10")
    c = best.select("concept", *(F.col(f"m.{x}").alias(x) for x in ("days", "units", "families", "active_days", "momentum")))
    route = F.when(F.col("families") > 1, "convergence").when(F.col("families") == 1, "frontier")
    return c.select("concept", "days", "units", code_table(REASONS).alias("reasons"), rule_table(CLASSES, "WEAK").alias("class"), route.alias("route"), fingerprint(F.col("concept"), F.col("days"), F.col("units"), F.col("families")).alias("fingerprint"))


@query(f"WITH {LOG_SQL}, {_CHAIN} SELECT days, count(*) AS concepts, CAST(sum(n) AS BIGINT) AS n, max(families) AS most_families, max(units) AS most_units FROM a GROUP BY days")
def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of window: concepts, volume, and the most families and units."""
    return aggregates(effective(spark, sf_dir)).groupBy("days").agg(F.count("*").alias("concepts"), F.sum("n").alias("n"), F.max("families").alias("most_families"), F.max("units").alias("most_units"))


@query(f"WITH {LOG_SQL}, {_CHAIN}, r AS (SELECT DISTINCT concept, family FROM e WHERE day > DATE '{EVENTS_AS_OF}' - 7 AND value IS NOT NULL) SELECT concept, family, count(*) AS observations FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.concept = e.concept AND r.family = e.family) GROUP BY ALL")
def unreferenced_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that a snapshot counts without a current reference: each is a violation."""
    e = effective(spark, sf_dir)
    current = e.where((F.col("day") > F.date_sub(F.lit(EVENTS_AS_OF).cast("date"), 7)) & F.col("value").isNotNull()).select("concept", "family").distinct()
    return e.join(current, ["concept", "family"], "left_anti").groupBy("concept", "family").agg(F.count("*").alias("observations"))


@query("""WITH docs AS (SELECT doc_id, source, sha256(text) AS fp FROM documents), c AS (SELECT fp, min(doc_id) AS cluster, count(*) AS n FROM docs GROUP BY fp HAVING count(*) >= 2)
SELECT doc_id, CASE WHEN n IS NOT NULL THEN concat('cluster:', cluster) WHEN doc_id % 4 <> 0 THEN concat('item:', doc_id) ELSE concat('observation:', doc_id) END AS origin_unit FROM docs LEFT JOIN c USING (fp)""")
def origin_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as one origin: the cluster of equal texts, else the item, else the observation itself."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fp"))
    c = docs.groupBy("fp").agg(F.min("doc_id").alias("cluster"), F.count("*").alias("n")).where("n >= 2")
    i = F.col("doc_id")
    unit = F.coalesce(F.concat(F.lit("cluster:"), F.col("cluster")), F.when(i % 4 != 0, F.concat(F.lit("item:"), i)), F.concat(F.lit("observation:"), i))
    return docs.join(c, "fp", "left").select("doc_id", unit.alias("origin_unit"))


_RELATION_RULES = (("unknown_group", "group_name NOT IN ('view', 'click', 'purchase')"), ("too_few", "members < 2"), ("too_deep", "members > 3"), ("rejected_member", "rejected > 0"))


@query(f"""WITH {LOG_SQL}, g AS (SELECT event_type AS group_name, k, day, count(DISTINCT user_id) AS members, count(DISTINCT user_id) FILTER (WHERE user_id % 13 = 0) AS rejected FROM log GROUP BY ALL) SELECT group_name, k, day, members, coalesce({case_sql(_RELATION_RULES)}, 'recorded') AS outcome FROM g""")
def relation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed relations between survivors: only declared groups, of two or three members, none of them rejected."""
    g = log(spark, sf_dir).groupBy(F.col("event_type").alias("group_name"), "k", "day").agg(F.countDistinct("user_id").alias("members"), F.countDistinct(F.when(F.col("user_id") % 13 == 0, F.col("user_id"))).alias("rejected"))
    return g.select("group_name", "k", "day", "members", rule_table(_RELATION_RULES, "recorded").alias("outcome"))


@query(f"WITH {VERSIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY release_rank DESC, release_id DESC, line DESC) AS n FROM versions) SELECT series_id, period, n, release_rank, value FROM r WHERE n <= 3")
def revision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three versions of each cell: the slice is the feature, and the ranking is cut before the shuffle."""
    order = [F.desc("release_rank"), F.desc("release_id"), F.desc("line")]
    return top_per_group(versions(spark, sf_dir), ["series_id", "period"], order, 3, "n").select("series_id", "period", "n", "release_rank", "value")


#: What leaves the house: these fields and no others; and keys that must never do.
PUBLISHED = ("event_id", "kind", "day")
FORBIDDEN = ("token", "password", "user")
_PAYLOAD = "concat('{\"k\":', k, ',\"user\":', user_id, ',\"note\":\"n\"}')"


@query(f"WITH {LOG_SQL} SELECT event_id, event_type AS kind, day, concat('{{\"k\":', k, ',\"note\":\"n\"}}') AS payload, CASE WHEN user_id % 9 = 0 THEN 'missing' ELSE 'given' END AS attribution FROM log WHERE event_type IN ('view', 'purchase')")
def handoff_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they are handed on: an allow-list of columns, forbidden keys taken out of the JSON, and whether the source is named."""
    kept = F.to_json(F.map_filter(F.from_json(F.expr(_PAYLOAD), "map<string,string>"), lambda k, v: ~k.isin(*FORBIDDEN)))
    payload = F.regexp_replace(kept, '"k":"([0-9]+)"', '"k":$1')
    rows = log(spark, sf_dir).where(F.col("event_type").isin("view", "purchase")).withColumn("kind", F.col("event_type"))
    return rows.select(*PUBLISHED, payload.alias("payload"), F.when(F.col("user_id") % 9 == 0, "missing").otherwise("given").alias("attribution"))


@query("""SELECT p_brand AS family, p_type AS variant, count(*) AS components, count(DISTINCT p_size) AS phases, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes, CASE WHEN count(*) FILTER (WHERE p_retailprice IS NULL) > 0 THEN 'incomplete' WHEN count(DISTINCT p_size) < 2 THEN 'flat' ELSE 'structured' END AS outcome FROM part GROUP BY ALL""")
def protocol_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with their variants, phases in order, and what a dry run says of them."""
    phases = F.countDistinct("p_size")
    sizes = F.array_join(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), ",")
    outcome = F.when(F.count_if(F.col("p_retailprice").isNull()) > 0, "incomplete").when(phases < 2, "flat").otherwise("structured")
    return load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("family"), F.col("p_type").alias("variant")).agg(F.count("*").alias("components"), phases.alias("phases"), sizes.alias("sizes"), outcome.alias("outcome"))


@query(f"WITH {LOG_SQL} SELECT day, concat(day, ': ', count(*), ' events, ', count(*) FILTER (WHERE event_type = 'error'), ' failed, ', count(DISTINCT user_id), ' users') AS line FROM log GROUP BY day")
def daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a day, ready to be written as a report."""
    g = log(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.countDistinct("user_id").alias("users"))
    return g.select("day", F.concat(F.col("day").cast("string"), F.lit(": "), "n", F.lit(" events, "), "failed", F.lit(" failed, "), "users", F.lit(" users")).alias("line"))
