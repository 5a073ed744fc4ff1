"""Admission gates, policies and classifications: ordered rules over items, rule tables over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import all_matches, first_match
from ..functions.text import fold
from ..operators.latest import with_first
from ..sources.tables import EVENTS_AS_OF, ITEMS_AS_OF, ITEMS_SQL, LOG_SQL, items, load, log
from .registry import query

#: Policies by source: (source, allowed pattern or null, denied pattern or null). A denial wins.
POLICIES = (("src0", "(^|[^a-z])(the|of|que)([^a-z]|$)", None), ("src1", None, "[0-9]{6}"), ("src2", "[a-z]", "licensed under"), ("src3", None, "@"))
#: Editorial rules: (order, source or null for all, pattern, unless pattern or null, name).
EDITORIAL = ((1, None, "licensed under", None, "licence_line"), (2, "src4", "thing", "ther", "thing_only"), (3, None, "[|].*[|]", None, "table"), (4, "src5", "a", None, "any_a"))
#: Which classes of evidence may support which direction.
FIREWALL = (("view", "up"), ("click", "up"), ("purchase", "up"), ("purchase", "down"), ("signup", "down"))


def _values(rows: tuple) -> str:
    put = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(put, r))})" for r in rows)


@query(f"""WITH {ITEMS_SQL}, p(source_id, allow, deny) AS (VALUES {_values(POLICIES)})
SELECT item_id, CASE WHEN deny IS NOT NULL AND regexp_matches(lower(text), deny) THEN 'denied' WHEN allow IS NOT NULL AND NOT regexp_matches(lower(text), allow) THEN 'not_allowed' ELSE 'pass' END AS policy FROM items LEFT JOIN p USING (source_id)""")
def source_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items under the content policy of their source; the constant policy table is broadcast, patterns come from its rows."""
    p = spark.createDataFrame(list(POLICIES), "source_id string, allow string, deny string")
    low = F.lower("text")
    rules = [("denied", F.regexp_like(low, F.col("deny"))), ("not_allowed", ~F.regexp_like(low, F.col("allow")))]
    return items(spark, sf_dir).join(F.broadcast(p), "source_id", "left").select("item_id", first_match(rules, "pass").alias("policy"))


@query(f"""WITH {ITEMS_SQL}, r(ord, source_id, pattern, unless, name) AS (VALUES {_values(EDITORIAL)}), h AS (SELECT item_id, arg_min(r.name, r.ord) AS rule FROM items i JOIN r ON (r.source_id IS NULL OR r.source_id = i.source_id) AND regexp_matches(lower(i.text), r.pattern) AND (r.unless IS NULL OR NOT regexp_matches(lower(i.title), r.unless)) GROUP BY item_id)
SELECT i.item_id, coalesce(h.rule, 'none') AS rule FROM items i LEFT JOIN h USING (item_id)""")
def editorial_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first editorial rule that hits each item, compiled from the rule table into one expression: no join."""
    text, title = F.lower("text"), F.lower("title")

    def hit(source: str | None, pattern: str, unless: str | None) -> Column:
        out = text.rlike(pattern)
        if source is not None:
            out &= F.col("source_id") == source
        return out if unless is None else out & ~title.rlike(unless)

    rules = [(name, hit(source, pattern, unless)) for _, source, pattern, unless, name in sorted(EDITORIAL, key=lambda r: r[0])]
    return items(spark, sf_dir).select("item_id", first_match(rules, "none").alias("rule"))


@query(f"""WITH {LOG_SQL}, d AS (SELECT event_id, event_type AS class, CASE WHEN value < 20 THEN 'down' ELSE 'up' END AS direction FROM log), a(class, direction) AS (VALUES {_values(FIREWALL)})
SELECT event_id, class, direction FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.class = d.class AND a.direction = d.direction)""")
def evidence_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence whose class may not support its direction."""
    allowed = spark.createDataFrame(list(FIREWALL), "class string, direction string")
    d = log(spark, sf_dir).select("event_id", F.col("event_type").alias("class"), F.when(F.col("value") < 20, "down").otherwise("up").alias("direction"))
    return d.join(F.broadcast(allowed), ["class", "direction"], "left_anti").select("event_id", "class", "direction")


@query(r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages)
SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'no_host' WHEN regexp_matches(host, '^(localhost|127\.|10\.|192\.168\.|169\.254\.)') THEN 'private_host' WHEN regexp_matches(lower(url), '[?&](token|key|secret|password|sig)=') THEN 'credential' ELSE 'safe' END AS screen FROM u""")
def url_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that must not be fetched or stored, with the reason."""
    u = load(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1).alias("host"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"))
    rules = [("scheme", ~F.col("scheme").isin("http", "https")), ("no_host", F.col("host") == ""), ("private_host", F.col("host").rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.)")), ("credential", F.lower("url").rlike("[?&](token|key|secret|password|sig)="))]
    return u.select("page_id", first_match(rules, "safe").alias("screen"))


@query(f"""WITH {ITEMS_SQL} SELECT item_id, CASE WHEN route IS NULL THEN 'hold' WHEN route = 'news' AND regexp_matches(lower(text), 'licensed under') THEN 'move' WHEN route = 'research' AND n_chars < 300 THEN 'reject' WHEN toxic = 1 THEN 'reject' ELSE 'keep' END AS kind,
 CASE WHEN route IS NULL THEN 'no_route' WHEN route = 'news' AND regexp_matches(lower(text), 'licensed under') THEN 'licence_text' WHEN route = 'research' AND n_chars < 300 THEN 'too_short' WHEN toxic = 1 THEN 'toxic' END AS reason FROM items""")
def lane_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an item belongs to its lane: keep, move, hold or reject, with the reason."""
    rules = [("no_route", F.col("route").isNull()), ("licence_text", (F.col("route") == "news") & F.lower("text").rlike("licensed under")), ("too_short", (F.col("route") == "research") & (F.col("n_chars") < 300)), ("toxic", F.col("toxic") == 1)]
    reason = first_match(rules)
    kind = first_match([("hold", reason == "no_route"), ("move", reason == "licence_text"), ("reject", reason.isNotNull())], "keep")
    return items(spark, sf_dir).select("item_id", kind.alias("kind"), reason.alias("reason"))


@query(f"""WITH {ITEMS_SQL} SELECT item_id, CASE WHEN quality IS NULL THEN 'hold' WHEN quality = 0 OR toxic = 1 THEN 'reject' ELSE 'pass' END AS verdict,
 concat_ws(',', CASE WHEN quality IS NULL THEN 'unrated' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN route IS NULL THEN 'no_route' END) AS codes FROM items""")
def item_pass_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-state eligibility with all reason codes."""
    codes = all_matches([("unrated", F.col("quality").isNull()), ("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1), ("no_route", F.col("route").isNull())])
    verdict = first_match([("hold", F.col("quality").isNull()), ("reject", (F.col("quality") == 0) | (F.col("toxic") == 1))], "pass")
    return items(spark, sf_dir).select("item_id", verdict.alias("verdict"), F.array_join(codes, ",").alias("codes"))


@query(f"""WITH {ITEMS_SQL} SELECT item_id, date_diff('day', published, DATE '{ITEMS_AS_OF}') AS age, CASE WHEN date_diff('day', published, DATE '{ITEMS_AS_OF}') < 0 THEN 'future' WHEN date_diff('day', published, DATE '{ITEMS_AS_OF}') <= 90 THEN 'fresh' WHEN date_diff('day', published, DATE '{ITEMS_AS_OF}') <= 180 THEN 'active' ELSE 'stale' END AS verdict,
 CASE WHEN published BETWEEN DATE '{ITEMS_AS_OF}' - 21 AND DATE '{ITEMS_AS_OF}' + 7 THEN true ELSE false END AS in_window FROM items""")
def day_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age verdict and whether an item falls into the look-back and look-ahead window."""
    today = F.lit(ITEMS_AS_OF).cast("date")
    age = F.datediff(today, "published")
    return items(spark, sf_dir).select("item_id", age.cast("long").alias("age"), first_match([("future", age < 0), ("fresh", age <= 90), ("active", age <= 180)], "stale").alias("verdict"), F.col("published").between(F.date_sub(today, 21), F.date_add(today, 7)).alias("in_window"))


@query("""SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS BIGINT) AS days_left, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') < 0 THEN 0 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') <= 3 THEN 40 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') <= 14 THEN 25 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') <= 30 THEN 10 ELSE 0 END AS boost FROM orders""")
def deadline_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to a deadline and the boost they give."""
    left = F.datediff(F.lit("2001-12-31").cast("date"), F.to_date("o_orderdate"))
    boost = F.when(left < 0, 0).when(left <= 3, 40).when(left <= 14, 25).when(left <= 30, 10).otherwise(0)
    return load(spark, sf_dir, "orders").select("o_orderkey", left.cast("long").alias("days_left"), boost.alias("boost"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'ring|bolt') THEN 'trial' WHEN regexp_matches(lower(p_type), 'promo') THEN 'review' WHEN regexp_matches(lower(p_type), 'economy|standard') THEN 'cohort' ELSE 'other' END AS study_type, CASE WHEN regexp_matches(lower(p_name), 'ring|bolt') THEN 1 WHEN regexp_matches(lower(p_type), 'promo') THEN 2 WHEN regexp_matches(lower(p_type), 'economy|standard') THEN 3 ELSE 9 END AS evidence_rank FROM part""")
def study_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type inferred from tags, else from the title, and its place in the ladder of evidence."""
    name, kind = F.lower("p_name"), F.lower("p_type")
    t = first_match([("trial", name.rlike("ring|bolt")), ("review", kind.rlike("promo")), ("cohort", kind.rlike("economy|standard"))], "other")
    rank = F.when(t == "trial", 1).when(t == "review", 2).when(t == "cohort", 3).otherwise(9)
    return load(spark, sf_dir, "part").select("p_partkey", t.alias("study_type"), rank.alias("evidence_rank"))


@query(f"""WITH {ITEMS_SQL}, e AS (SELECT source_id, quality, CASE WHEN n_chars BETWEEN 200 AND 4000 THEN 1 ELSE 0 END AS predicted FROM items WHERE quality IS NOT NULL), g AS (SELECT source_id, count(*) FILTER (WHERE quality = 1) AS yes, count(*) FILTER (WHERE quality = 0) AS no, CAST(count(*) FILTER (WHERE quality = 1 AND predicted = 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE quality = 1), 0) AS p, CAST(count(*) FILTER (WHERE quality = 0 AND predicted = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE quality = 0), 0) AS f FROM e GROUP BY 1)
SELECT source_id, yes, no, CASE WHEN yes >= 3 AND no >= 3 THEN CAST(floor(100 * least(p, f)) AS BIGINT) END AS clarity FROM g""")
def cluster_clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a simple prediction separates the labels of each cluster; none below three examples a side."""
    predicted, yes, no = F.col("n_chars").between(200, 4000), F.col("quality") == 1, F.col("quality") == 0
    share = lambda a, b: F.count_if(a & b) / F.nullif(F.count_if(b), F.lit(0))
    g = items(spark, sf_dir).where("quality is not null").groupBy("source_id").agg(F.count_if(yes).alias("yes"), F.count_if(no).alias("no"), share(predicted, yes).alias("p"), share(~predicted, no).alias("f"))
    return g.select("source_id", "yes", "no", F.when((F.col("yes") >= 3) & (F.col("no") >= 3), F.floor(100 * F.least("p", "f")).cast("long")).alias("clarity"))


@query(f"""WITH {ITEMS_SQL}, e AS (SELECT coalesce(route, 'all') AS head, CAST(quality AS DOUBLE) AS y, 1 / (1 + exp(-(n_chars / 1000.0 - 1))) AS p FROM items WHERE quality IS NOT NULL)
SELECT head, count(*) AS n, round(avg(abs(p - y)), 4) AS mae, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(CASE WHEN count(*) FILTER (WHERE p >= 0.5) + count(*) FILTER (WHERE y = 1) > 0 THEN 2.0 * CAST(count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS DOUBLE) / (count(*) FILTER (WHERE p >= 0.5) + count(*) FILTER (WHERE y = 1)) END, 4) AS f1 FROM e GROUP BY head""")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error, accuracy and F1 of a scored head, as aggregates over prediction rows."""
    e = items(spark, sf_dir).where("quality is not null").select(F.coalesce("route", F.lit("all")).alias("head"), F.col("quality").cast("double").alias("y"), (1 / (1 + F.exp(-(F.col("n_chars") / F.lit(1000.0) - 1)))).alias("p"))
    said, true = F.col("p") >= 0.5, F.col("y") == 1
    total = F.count_if(said) + F.count_if(true)
    return e.groupBy("head").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 4).alias("mae"), F.round(F.avg(F.when(said == true, 1.0).otherwise(0.0)), 4).alias("accuracy"), F.round(F.when(total > 0, 2.0 * F.count_if(said & true) / total), 4).alias("f1"))


@query(f"""WITH {LOG_SQL}, c AS (SELECT user_id, CASE WHEN k % 3 = 0 THEN 'news' WHEN k % 3 = 1 THEN 'grant' ELSE 'course' END AS lane, count(*) AS n FROM log WHERE event_type = 'purchase' GROUP BY ALL), t AS (SELECT user_id, lane, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY user_id) AS share, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, lane) AS r FROM c)
SELECT user_id, lane, round(share, 4) AS share, CASE WHEN share >= 0.6 THEN 'suggest' WHEN share >= 0.4 THEN 'weak' ELSE 'none' END AS margin FROM t WHERE r = 1""")
def lane_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lane that a user's accepted items point to, and how clearly."""
    d = F.col("k") % 3
    c = log(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id", F.when(d == 0, "news").when(d == 1, "grant").otherwise("course").alias("lane")).agg(F.count("*").alias("n"))
    t = c.groupBy("user_id").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "lane")).alias("best"))
    share = -F.col("best.m") / F.col("total")
    return t.select("user_id", F.col("best.lane").alias("lane"), F.round(share, 4).alias("share"), first_match([("suggest", share >= 0.6), ("weak", share >= 0.4)], "none").alias("margin"))


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS name, 1 AS layer FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, upper(c_name), 2 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_mktsegment, 3 FROM customer)
SELECT id, name, layer FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY layer) AS r FROM a) WHERE r = 1""")
def registry_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several registries laid over each other: each id from the first that has it."""
    c = load(spark, sf_dir, "customer")
    layer = lambda df, name, n: df.select(F.col("c_custkey").alias("id"), name.alias("name"), F.lit(n).alias("layer"))
    a = layer(c.where("c_custkey % 3 = 0"), F.col("c_name"), 1).unionByName(layer(c.where("c_custkey % 2 = 0"), F.upper("c_name"), 2)).unionByName(layer(c, F.col("c_mktsegment"), 3))
    best = a.groupBy("id").agg(F.min(F.struct("layer", "name")).alias("b"))
    return best.select("id", F.col("b.name").alias("name"), F.col("b.layer").alias("layer"))


@query(f"""WITH {LOG_SQL} SELECT event_id, CASE WHEN event_type = 'signup' AND value > 50 THEN 'dossier,brief' WHEN event_type = 'signup' THEN 'dossier' WHEN event_type = 'purchase' THEN 'brief' WHEN event_type = 'error' THEN 'review' ELSE 'closed' END AS outcomes FROM log""")
def event_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event kinds to outcomes; what no policy names is closed."""
    kind, large = F.col("event_type"), F.col("value") > 50
    rules = [("dossier,brief", (kind == "signup") & large), ("dossier", kind == "signup"), ("brief", kind == "purchase"), ("review", kind == "error")]
    return log(spark, sf_dir).select("event_id", first_match(rules, "closed").alias("outcomes"))


@query(f"""WITH {ITEMS_SQL}, d AS (SELECT item_id, title, row_number() OVER (PARTITION BY title ORDER BY item_id) AS copy, quality, toxic, n_chars, route FROM items)
SELECT item_id, CASE WHEN copy > 1 THEN 'duplicate' WHEN toxic = 1 THEN 'integrity' WHEN quality IS NULL THEN 'no_evidence' WHEN route IS NULL THEN 'irrelevant' WHEN quality = 1 THEN 'eligible' ELSE 'refused' END AS status FROM d""")
def research_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by the first thing that keeps them out of the pool."""
    rules = [("duplicate", F.col("item_id") > F.col("first")), ("integrity", F.col("toxic") == 1), ("no_evidence", F.col("quality").isNull()), ("irrelevant", F.col("route").isNull()), ("eligible", F.col("quality") == 1)]
    return with_first(items(spark, sf_dir).select("item_id", "title", "toxic", "quality", "route"), "title", "item_id").select("item_id", first_match(rules, "refused").alias("status"))


@query(f"""WITH {ITEMS_SQL}, w AS (SELECT item_id, route, row_number() OVER (PARTITION BY route ORDER BY CASE WHEN quality = 1 THEN 0 ELSE 1 END, published DESC, item_id) AS place FROM items WHERE route IS NOT NULL)
SELECT item_id, route, place <= CASE route WHEN 'news' THEN 40 WHEN 'research' THEN 20 ELSE 10 END AS admitted FROM w""")
def evergreen_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items of each family fit its daily budget; the others stay, marked as waiting."""
    place = F.row_number().over(Window.partitionBy("route").orderBy(F.when(F.col("quality") == 1, 0).otherwise(1), F.desc("published"), "item_id"))
    budget = F.when(F.col("route") == "news", 40).when(F.col("route") == "research", 20).otherwise(10)
    return items(spark, sf_dir).where("route is not null").select("item_id", "route", (place <= budget).alias("admitted"))


@query(f"""WITH {LOG_SQL}, g AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS attempts, max(day) FILTER (WHERE event_type = 'error') AS last_day, max(day) AS seen FROM log GROUP BY user_id)
SELECT user_id, attempts FROM g WHERE attempts BETWEEN 1 AND 14 AND last_day + CAST(attempts % 4 AS INTEGER) <= DATE '{EVENTS_AS_OF}' AND seen >= DATE '{EVENTS_AS_OF}' - 21""")
def enrichment_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be tried again: attempts left, back-off over, not too old."""
    failed, today = F.col("event_type") == "error", F.lit(EVENTS_AS_OF).cast("date")
    g = log(spark, sf_dir).groupBy("user_id").agg(F.count_if(failed).alias("attempts"), F.max(F.when(failed, F.col("day"))).alias("last_day"), F.max("day").alias("seen"))
    return g.where(F.col("attempts").between(1, 14) & (F.date_add("last_day", (F.col("attempts") % 4).cast("int")) <= today) & (F.col("seen") >= F.date_sub(today, 21))).select("user_id", "attempts")


@query("""WITH w AS (SELECT DISTINCT n_nationkey, unnest(['NATION_' || CAST(n_nationkey AS VARCHAR), 'new ' || CAST(n_nationkey % 7 AS VARCHAR)]) AS mention FROM nation) SELECT mention, count(*) AS feeds FROM w WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE lower(n.n_name) = lower(mention)) GROUP BY mention HAVING count(*) >= 2""")
def unknown_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several feeds mention and no registry knows."""
    n = load(spark, sf_dir, "nation")
    w = n.select("n_nationkey", F.explode(F.array(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")), F.concat(F.lit("new "), (F.col("n_nationkey") % 7).cast("string")))).alias("mention")).distinct()
    known = n.select(fold(F.col("n_name")).alias("key"))
    return w.withColumn("key", fold(F.col("mention"))).join(known, "key", "left_anti").groupBy("mention").agg(F.count("*").alias("feeds")).where("feeds >= 2")


@query(f"""WITH {LOG_SQL} SELECT event_id, user_id % 6 AS slot, CASE WHEN event_id % 12 = 0 THEN 'daily' WHEN event_id % 5 = 0 THEN 'slow' ELSE 'fast' END AS job, CASE WHEN row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) = 1 THEN 'first' ELSE 'repeat' END AS in_batch FROM log""")
def slots_and_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation slot of each call and whether its key came before in the batch."""
    first = F.min("event_id").over(Window.partitionBy("user_id", "k")) == F.col("event_id")
    job = first_match([("daily", F.col("event_id") % 12 == 0), ("slow", F.col("event_id") % 5 == 0)], "fast")
    return log(spark, sf_dir).select("event_id", F.pmod("user_id", F.lit(6)).alias("slot"), job.alias("job"), F.when(first, "first").otherwise("repeat").alias("in_batch"))
