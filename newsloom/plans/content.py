"""Lists, counts, review figures and set operations over content items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import first_match
from ..functions.text import fingerprint, fold
from ..operators import upsert
from ..operators.latest import latest_by, leading_streak, top_per_group, winner, with_first, within_budget
from ..sources.tables import ITEMS_AS_OF, ITEMS_SQL, LOG_SQL, items, load, log
from .registry import query



def as_of() -> Column:
    """The reference day."""
    return F.lit(ITEMS_AS_OF).cast("date")


@query(f"WITH {ITEMS_SQL} SELECT item_id, coalesce(route, 'unclassified') AS route, source_id, title, published, status FROM items WHERE status <> 'trash' ORDER BY published DESC, item_id DESC LIMIT 200")
def item_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 items that are not in the trash: the limit is the feature, and it runs as a top-k."""
    rows = items(spark, sf_dir).where("status <> 'trash'")
    return rows.select("item_id", F.coalesce("route", F.lit("unclassified")).alias("route"), "source_id", "title", "published", "status").orderBy(F.desc("published"), F.desc("item_id")).limit(200)


@query(f"WITH {ITEMS_SQL} SELECT coalesce(route, 'unclassified') AS route, count(*) FILTER (WHERE status = 'inbox') AS inbox, count(*) FILTER (WHERE status = 'hold') AS hold, count(*) FILTER (WHERE status = 'production') AS production, count(*) FILTER (WHERE status = 'trash') AS trash FROM items GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each route by status, as columns."""
    rows = items(spark, sf_dir).groupBy(F.coalesce("route", F.lit("unclassified")).alias("route"))
    return rows.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("inbox", "hold", "production", "trash")))


@query(f"WITH {ITEMS_SQL} SELECT coalesce(route, 'all') AS route, coalesce(status, 'all') AS status, count(*) AS n FROM (SELECT coalesce(route, 'unclassified') AS route, status FROM items) GROUP BY ROLLUP (route, status)")
def nav_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by route and status with totals, in one pass."""
    rows = items(spark, sf_dir).select(F.coalesce("route", F.lit("unclassified")).alias("route"), "status")
    return rows.rollup("route", "status").agg(F.count("*").alias("n")).select(F.coalesce("route", F.lit("all")).alias("route"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@query("SELECT count(*) AS n FROM documents d WHERE lang NOT IN ('en', 'fr', 'de') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unclassified_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a route that nobody has labelled."""
    docs = load(spark, sf_dir, "documents").where(~F.col("lang").isin("en", "fr", "de"))
    return docs.join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("n"))


@query(f"""WITH {ITEMS_SQL}, per AS (SELECT coalesce(route, 'unclassified') AS route, source_id, count(*) AS n, max(published) AS newest, count(*) FILTER (WHERE status = 'inbox' AND published > DATE '{ITEMS_AS_OF}' - 365) AS inbox FROM items GROUP BY 1, 2)
SELECT route, count(*) AS sources, count(*) FILTER (WHERE n >= 5) AS ready, CAST(sum(inbox) AS BIGINT) AS inbox, max(newest) AS newest, round(100.0 * CAST(count(*) FILTER (WHERE n >= 5) AS DOUBLE) / count(*), 1) AS ready_pct FROM per GROUP BY route""")
def route_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each route, how many deliver, and what waits in the inbox."""
    recent = (F.col("status") == "inbox") & (F.col("published") > F.date_sub(as_of(), 365))
    per = items(spark, sf_dir).groupBy(F.coalesce("route", F.lit("unclassified")).alias("route"), "source_id").agg(F.count("*").alias("n"), F.max("published").alias("newest"), F.count_if(recent).alias("inbox"))
    ready = F.count_if(F.col("n") >= 5)
    return per.groupBy("route").agg(F.count("*").alias("sources"), ready.alias("ready"), F.sum("inbox").alias("inbox"), F.max("newest").alias("newest"), F.round(F.lit(100.0) * ready / F.count("*"), 1).alias("ready_pct"))


@query(f"WITH {ITEMS_SQL} SELECT source_id, count(*) AS waiting, min(published) AS oldest FROM items WHERE status = 'inbox' GROUP BY source_id")
def inbox_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("status = 'inbox'").groupBy("source_id").agg(F.count("*").alias("waiting"), F.min("published").alias("oldest"))


@query(f"WITH {ITEMS_SQL} SELECT source_id, count(*) AS decided, round(CAST(count(*) FILTER (WHERE status <> 'production') AS DOUBLE) / count(*), 4) AS reject_rate FROM items WHERE status <> 'inbox' GROUP BY source_id HAVING count(*) >= 5 AND CAST(count(*) FILTER (WHERE status <> 'production') AS DOUBLE) / count(*) >= 0.2")
def low_yield_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with enough decisions of which many were rejections."""
    rate = F.count_if(F.col("status") != "production") / F.count("*")
    out = items(spark, sf_dir).where("status <> 'inbox'").groupBy("source_id").agg(F.count("*").alias("decided"), rate.alias("rate"))
    return out.where("decided >= 5 and rate >= 0.2").select("source_id", "decided", F.round("rate", 4).alias("reject_rate"))


@query(f"""WITH {LOG_SQL}, g AS (SELECT user_id, k % 7 AS reason, count(*) AS n FROM log WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS rejected, arg_max(reason, n * 100 - reason) AS top_reason FROM g GROUP BY user_id""")
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections of each key with the most frequent reason, the smaller one on a tie."""
    g = log(spark, sf_dir).where("event_type = 'error'").groupBy("user_id", (F.col("k") % 7).alias("reason")).agg(F.count("*").alias("n"))
    return g.groupBy("user_id").agg(F.sum("n").alias("rejected"), F.max_by("reason", F.struct("n", -F.col("reason"))).alias("top_reason"))


@query(f"""WITH {LOG_SQL} SELECT event_type, count(*) FILTER (WHERE day >= DATE '2024-01-16') AS recent, count(*) FILTER (WHERE day < DATE '2024-01-16') AS before, count(DISTINCT user_id) AS users FROM log GROUP BY event_type""")
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions before and within the review window, whose first day counts."""
    inside = F.col("day") >= F.lit("2024-01-16").cast("date")
    return log(spark, sf_dir).groupBy("event_type").agg(F.count_if(inside).alias("recent"), F.count_if(~inside).alias("before"), F.countDistinct("user_id").alias("users"))


@query(f"""WITH {LOG_SQL} SELECT k % 10 AS heading, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 00:00:00') AS last_24h, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24 00:00:00') AS last_7d,
 count(*) FILTER (WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-24 00:00:00') AS rejects_7d FROM log GROUP BY 1""")
def heading_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.col("ts") >= F.lit("2024-01-24 00:00:00").cast("timestamp_ntz")
    return log(spark, sf_dir).groupBy((F.col("k") % 10).alias("heading")).agg(F.count_if(F.col("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).alias("last_24h"), F.count_if(week).alias("last_7d"), F.count_if(week & (F.col("event_type") == "error")).alias("rejects_7d"))


@query(f"WITH {ITEMS_SQL} SELECT coalesce(route, 'unclassified') AS topic, count(DISTINCT item_id) AS items, count(DISTINCT source_id) AS feeds, count(DISTINCT title) AS titles, count(quality) AS labelled FROM items GROUP BY 1")
def topic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy(F.coalesce("route", F.lit("unclassified")).alias("topic")).agg(F.countDistinct("item_id").alias("items"), F.countDistinct("source_id").alias("feeds"), F.countDistinct("title").alias("titles"), F.count("quality").alias("labelled"))


@query(f"""WITH {ITEMS_SQL}, g AS (SELECT coalesce(route, 'unclassified') AS topic, source_id, count(*) AS items, count(quality) AS rated, count(*) FILTER (WHERE quality = 1) AS good FROM items GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY good DESC, items DESC, source_id) AS rank FROM g) WHERE rank <= 8""")
def topic_sources_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best sources of each topic."""
    g = items(spark, sf_dir).groupBy(F.coalesce("route", F.lit("unclassified")).alias("topic"), "source_id").agg(F.count("*").alias("items"), F.count("quality").alias("rated"), F.count_if(F.col("quality") == 1).alias("good"))
    return top_per_group(g, ["topic"], [F.desc("good"), F.desc("items"), F.col("source_id")], 8)


@query("""SELECT o_orderpriority AS relation, count(*) AS hits, count(l.n) AS rated, round(avg(l.q), 2) AS avg_score, count(*) FILTER (WHERE l.q >= 30) AS good FROM orders o
 LEFT JOIN (SELECT l_orderkey, count(*) AS n, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey GROUP BY 1""")
def relation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each relation and the scores of those that were rated: one pre-aggregated left join."""
    rated = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("q"))
    joined = load(spark, sf_dir, "orders").join(rated, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy(F.col("o_orderpriority").alias("relation")).agg(F.count("*").alias("hits"), F.count("n").alias("rated"), F.round(F.avg("q"), 2).alias("avg_score"), F.count_if(F.col("q") >= 30).alias("good"))


@query(f"WITH {ITEMS_SQL} SELECT source_id, count(*) FILTER (WHERE quality = 1) AS yes, count(*) FILTER (WHERE quality = 0) AS no, CASE WHEN count(quality) >= 8 THEN round(100 * CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) / count(quality), 1) END AS rate FROM items GROUP BY source_id")
def authority_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes for and against each source; a rate only from eight votes on."""
    yes = F.count_if(F.col("quality") == 1)
    return items(spark, sf_dir).groupBy("source_id").agg(yes.alias("yes"), F.count_if(F.col("quality") == 0).alias("no"), F.when(F.count("quality") >= 8, F.round(F.lit(100) * yes / F.count("quality"), 1)).alias("rate"))


@query(f"""WITH {ITEMS_SQL}, u AS (SELECT 'source' AS dimension, source_id AS key, quality FROM items WHERE quality IS NOT NULL UNION ALL SELECT 'route', coalesce(route, 'unclassified'), quality FROM items WHERE quality IS NOT NULL)
SELECT dimension, key, count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality = 0) AS rejected,
 CASE WHEN count(*) < 5 THEN 'below_noise_floor' WHEN CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) / count(*) >= 0.9 THEN 'raise' WHEN CAST(count(*) FILTER (WHERE quality = 0) AS DOUBLE) / count(*) >= 0.2 THEN 'lower' ELSE 'no_clear_signal' END AS proposal FROM u GROUP BY ALL""")
def accept_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance by every dimension in one unpivoted pass, with noise floors."""
    rated = items(spark, sf_dir).where("quality is not null").select("source_id", F.coalesce("route", F.lit("unclassified")).alias("route"), "quality")
    long = rated.select("quality", F.explode(F.array(F.struct(F.lit("source").alias("dimension"), F.col("source_id").alias("key")), F.struct(F.lit("route").alias("dimension"), F.col("route").alias("key")))).alias("d"))
    yes, no = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    rule = first_match([("below_noise_floor", F.count("*") < 5), ("raise", yes / F.count("*") >= 0.9), ("lower", no / F.count("*") >= 0.2)], "no_clear_signal")
    return long.groupBy("d.dimension", "d.key").agg(yes.alias("accepted"), no.alias("rejected"), rule.alias("proposal"))


@query(f"""WITH {LOG_SQL}, g AS (SELECT k % 5 AS channel, CAST(count(*) FILTER (WHERE event_type = 'purchase' AND day < DATE '2024-01-15') AS DOUBLE) / nullif(count(*) FILTER (WHERE day < DATE '2024-01-15'), 0) AS b,
 CAST(count(*) FILTER (WHERE event_type = 'purchase' AND day >= DATE '2024-01-15') AS DOUBLE) / nullif(count(*) FILTER (WHERE day >= DATE '2024-01-15'), 0) AS a FROM log GROUP BY 1)
SELECT channel, round(b, 4) AS before, round(a, 4) AS after, CASE WHEN a IS NULL OR b IS NULL THEN 'not_enough' WHEN a - b > 0.02 THEN 'improved' WHEN b - a > 0.02 THEN 'regressed' ELSE 'unchanged' END AS verdict FROM g""")
def before_after_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of accepted actions before and after a change."""
    old, bought = F.col("day") < F.lit("2024-01-15").cast("date"), F.col("event_type") == "purchase"
    ratio = lambda side: F.count_if(bought & side) / F.nullif(F.count_if(side), F.lit(0))
    g = log(spark, sf_dir).groupBy((F.col("k") % 5).alias("channel")).agg(ratio(old).alias("b"), ratio(~old).alias("a"))
    verdict = first_match([("not_enough", F.col("a").isNull() | F.col("b").isNull()), ("improved", F.col("a") - F.col("b") > 0.02), ("regressed", F.col("b") - F.col("a") > 0.02)], "unchanged")
    return g.select("channel", F.round("b", 4).alias("before"), F.round("a", 4).alias("after"), verdict.alias("verdict"))


@query(f"WITH {ITEMS_SQL} SELECT round(avg(CASE WHEN route = 'research' THEN 1.0 ELSE 0.0 END), 4) AS share, avg(CASE WHEN route = 'research' THEN 1.0 ELSE 0.0 END) BETWEEN 0.10 AND 0.15 AS in_range FROM items")
def content_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg(F.when(F.col("route") == "research", 1.0).otherwise(0.0))
    return items(spark, sf_dir).agg(F.round(share, 4).alias("share"), share.between(0.10, 0.15).alias("in_range"))


@query("SELECT count(*) AS works FROM (SELECT doc_id FROM documents WHERE n_chars > 2000 UNION SELECT doc_id FROM labels WHERE quality = 1)")
def distinct_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the union of two sources of works."""
    a = load(spark, sf_dir, "documents").where("n_chars > 2000").select("doc_id")
    return a.union(load(spark, sf_dir, "labels").where("quality = 1").select("doc_id")).distinct().agg(F.count("*").alias("works"))


@query("SELECT count(*) AS n FROM (SELECT 1 FROM events WHERE event_type = 'error' LIMIT 500)")
def capped_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether there are at least 500: the cap is the feature."""
    return load(spark, sf_dir, "events").where("event_type = 'error'").limit(500).agg(F.count("*").alias("n"))


@query(f"WITH {LOG_SQL} SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_id FROM log GROUP BY user_id")
def source_health_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status that came with the newest fetch of each source."""
    return log(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("last_id"))


@query(f"WITH {ITEMS_SQL} SELECT title AS name, count(DISTINCT source_id) AS actors FROM items GROUP BY title HAVING count(DISTINCT source_id) >= 2")
def repeated_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy(F.col("title").alias("name")).agg(F.countDistinct("source_id").alias("actors")).where("actors >= 2")


@query(f"""WITH {LOG_SQL}, d AS (SELECT k % 5 AS scope, day, count(*) FILTER (WHERE event_type = 'purchase') AS found, count(*) AS seen FROM log GROUP BY ALL), m AS (SELECT *, CASE WHEN CAST(found AS DOUBLE) / seen < 0.2 THEN 0 ELSE 1 END AS good FROM d),
 i AS (SELECT *, sum(good) OVER (PARTITION BY scope ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT scope, day, found, seen, CAST(CASE WHEN good = 1 THEN 0 ELSE count(*) FILTER (WHERE good = 0) OVER (PARTITION BY scope, island ORDER BY day ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS low_streak FROM i""")
def wave_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily yield of each scope and for how many waves in a row it was low."""
    d = log(spark, sf_dir).groupBy((F.col("k") % 5).alias("scope"), "day").agg(F.count_if(F.col("event_type") == "purchase").alias("found"), F.count("*").alias("seen"))
    good = F.when(F.col("found") / F.col("seen") < 0.2, 0).otherwise(1)
    running = Window.partitionBy("scope").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    i = d.withColumn("good", good).withColumn("island", F.sum("good").over(running))
    low = F.sum(1 - F.col("good")).over(Window.partitionBy("scope", "island").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return i.select("scope", "day", "found", "seen", F.when(F.col("good") == 1, F.lit(0)).otherwise(low).cast("long").alias("low_streak"))


@query(f"""WITH {ITEMS_SQL} SELECT source_id, count(*) FILTER (WHERE status = 'production') AS approved, count(*) FILTER (WHERE status = 'production' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = item_id AND e.event_type = 'purchase')) AS waiting FROM items GROUP BY source_id""")
def production_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved items of each channel and those that nobody has produced yet."""
    made = load(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("item_id"), F.lit(True).alias("made"))
    rows = items(spark, sf_dir).join(made, "item_id", "left")
    on = F.col("status") == "production"
    return rows.groupBy("source_id").agg(F.count_if(on).alias("approved"), F.count_if(on & F.col("made").isNull()).alias("waiting"))


@query(f"""WITH {LOG_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM log WHERE event_type IN ('purchase', 'error', 'click'))
SELECT user_id, event_type AS decision, event_id FROM a WHERE n = 1 AND event_type <> 'click'""")
def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision in force for each item; an undo (click) leaves none."""
    acts = log(spark, sf_dir).where(F.col("event_type").isin("purchase", "error", "click"))
    return winner(acts, ["user_id"], ["ts", "event_id"], ["event_type", "event_id"]).where("event_type <> 'click'").select("user_id", F.col("event_type").alias("decision"), "event_id")


@query(f"WITH {LOG_SQL} SELECT user_id, day, event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM log) WHERE r = 1")
def latest_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rating of each user's newest day."""
    return latest_by(log(spark, sf_dir), ["user_id"], [F.desc("day")], ties="all").select("user_id", "day", "event_id")


@query(f"""WITH {LOG_SQL}, m AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS broken FROM log)
SELECT user_id, count(*) FILTER (WHERE broken = 0) AS streak, CASE WHEN count(*) FILTER (WHERE broken = 0) >= 3 THEN 'open' WHEN count(*) FILTER (WHERE broken = 0) > 0 THEN 'half_open' ELSE 'closed' END AS circuit FROM m GROUP BY user_id""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row, newest first, and the state of the circuit breaker."""
    s = leading_streak(log(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error")
    return s.select("user_id", "streak", first_match([("open", F.col("streak") >= 3), ("half_open", F.col("streak") > 0)], "closed").alias("circuit"))


@query(f"""WITH {LOG_SQL} SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_day, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) > 12 AS refused FROM log""")
def rate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user within the last 24 hours of each call."""
    rows = log(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0))
    return rows.select("event_id", "user_id", n.alias("in_day"), (n > 12).alias("refused"))


@query("""SELECT p_partkey, p_brand, CASE WHEN count(*) OVER (PARTITION BY p_brand) >= 8 THEN round(100.0 * (rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 + 0.5 * count(*) OVER (PARTITION BY p_brand, p_retailprice)) / count(*) OVER (PARTITION BY p_brand), 4) END AS percentile FROM part""")
def cohort_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-rank percentile in a cohort of at least eight."""
    cohort = Window.partitionBy("p_brand")
    below = F.rank().over(cohort.orderBy("p_retailprice")) - 1
    equal = F.count("*").over(Window.partitionBy("p_brand", "p_retailprice"))
    n = F.count("*").over(cohort)
    return load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(n >= 8, F.round(F.lit(100.0) * (below + F.lit(0.5) * equal) / n, 4)).alias("percentile"))


@query(f"""WITH {ITEMS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY n_chars DESC, item_id) AS n FROM items), c AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n_chars DESC, item_id) AS k FROM o WHERE n = 1)
SELECT source_id, item_id, n_chars, CAST(k AS BIGINT) AS rank FROM c WHERE k <= 3""")
def cluster_budget_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item of each cluster (title), then three of each source."""
    one = latest_by(items(spark, sf_dir), ["title"], [F.desc("n_chars"), F.col("item_id")])
    return top_per_group(one, ["source_id"], [F.desc("n_chars"), F.col("item_id")], 3).select("source_id", "item_id", "n_chars", "rank")


@query(f"""WITH {ITEMS_SQL}, f AS (SELECT coalesce(route, 'unclassified') AS topic, item_id, source_id, row_number() OVER (PARTITION BY coalesce(route, 'unclassified'), source_id ORDER BY item_id) AS n FROM items)
SELECT topic, item_id, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY CASE WHEN n > 1 THEN 1 ELSE 0 END, item_id) AS place FROM f) WHERE place <= 25""")
def first_from_distinct_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each topic, first one from every feed, then the rest."""
    rows = items(spark, sf_dir).select(F.coalesce("route", F.lit("unclassified")).alias("topic"), "item_id", "source_id")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("topic", "source_id").orderBy("item_id")))
    return top_per_group(rows, ["topic"], [F.when(F.col("n") > 1, 1).otherwise(0), F.col("item_id")], 25, "place").select("topic", "item_id", "place")


@query(f"""WITH {ITEMS_SQL}, adj(route, delta) AS (VALUES ('news', 2), ('research', 5), ('notice', -1)), lens(source_id, delta) AS (VALUES ('src1', 3), ('src7', -2))
SELECT item_id, CAST(coalesce(a.delta, 0) + coalesce(l.delta, 0) AS BIGINT) AS priority FROM items i LEFT JOIN adj a USING (route) LEFT JOIN lens l USING (source_id) WHERE status = 'inbox' ORDER BY priority DESC, item_id LIMIT 300""")
def relevance_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbox by the sum of the adjustments that match; two constant tables are broadcast."""
    route = spark.createDataFrame([("news", 2), ("research", 5), ("notice", -1)], "route string, by_route long")
    source = spark.createDataFrame([("src1", 3), ("src7", -2)], "source_id string, by_source long")
    rows = items(spark, sf_dir).where("status = 'inbox'").join(F.broadcast(route), "route", "left").join(F.broadcast(source), "source_id", "left")
    priority = F.coalesce("by_route", F.lit(0)) + F.coalesce("by_source", F.lit(0))
    return rows.select("item_id", priority.alias("priority")).orderBy(F.desc("priority"), "item_id").limit(300)


@query("""SELECT c_custkey, max(o_orderdate) AS last_fetch FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING max(o_orderdate) IS NULL OR max(o_orderdate) + INTERVAL 90 DAY <= TIMESTAMP '2001-12-31 00:00:00' ORDER BY last_fetch ASC NULLS FIRST, c_custkey LIMIT 50""")
def rotation_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 feeds that have waited longest among those that are due."""
    last = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_fetch"))
    rows = load(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")
    due = F.col("last_fetch").isNull() | (F.col("last_fetch") + F.expr("INTERVAL 90 DAYS") <= F.lit("2001-12-31 00:00:00").cast("timestamp_ntz"))
    return rows.where(due).orderBy(F.asc_nulls_first("last_fetch"), "c_custkey").limit(50)


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_acctbal >= 6000 THEN 1 WHEN s_acctbal >= 2000 THEN 2 ELSE 3 END AS tier, s_nationkey % 5 + 1 AS minutes, s_nationkey FROM supplier)
SELECT s_suppkey, tier, running_cost FROM (SELECT s_suppkey, tier, CAST(sum(minutes) OVER (PARTITION BY s_nationkey ORDER BY tier, s_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_cost FROM s) WHERE running_cost <= 20""")
def scheduler_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each runner's queue by tier as far as its minutes go."""
    s = load(spark, sf_dir, "supplier")
    rows = s.select("s_suppkey", first_match([("1", s.s_acctbal >= 6000), ("2", s.s_acctbal >= 2000)], "3").cast("int").alias("tier"), (s.s_nationkey % 5 + 1).cast("long").alias("minutes"), "s_nationkey")
    return within_budget(rows, [F.col("tier"), F.col("s_suppkey")], "minutes", 20, ["s_nationkey"]).select("s_suppkey", "tier", "running_cost")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE (l_partkey, l_orderkey, l_linenumber) > (500, 3000, 2) ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey LIMIT 100")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind a key tuple."""
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    behind = F.struct("l_partkey", "l_orderkey", "l_linenumber") > F.struct(F.lit(500).cast("long"), F.lit(3000).cast("long"), F.lit(2))
    return rows.where(behind & (F.col("l_partkey") >= 500)).orderBy("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey").limit(100)


@query("SELECT source, count(*) AS unseen FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def seen_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has not been decided, by source."""
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("unseen"))


@query(f"WITH {ITEMS_SQL} SELECT title, count(*) AS n, min(item_id) AS first_item FROM items WHERE status <> 'trash' AND length(title) >= 25 GROUP BY title HAVING count(*) > 1")
def title_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).where("status <> 'trash' and length(title) >= 25")
    return rows.groupBy("title").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item")).where("n > 1")


@query("""WITH k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doi:10.1000/' || CAST(doc_id % 97 AS VARCHAR) WHEN doc_id % 3 = 1 THEN 'pmid:' || CAST(10000 + doc_id % 89 AS VARCHAR) ELSE 'title:' || md5(text) END AS work FROM documents)
SELECT doc_id, work, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY work) THEN min(doc_id) OVER (PARTITION BY work) END AS duplicate_of FROM k""")
def work_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key a work, by the best identifier there is; later records point to the first."""
    d, i = load(spark, sf_dir, "documents"), F.col("doc_id")
    doi = F.when(i % 3 == 0, F.concat(F.lit("doi:10.1000/"), (i % 97).cast("string")))
    pmid = F.when(i % 3 == 1, F.concat(F.lit("pmid:"), (i % 89 + 10_000).cast("string")))
    work = d.select("doc_id", F.coalesce(doi, pmid, F.concat(F.lit("title:"), F.md5("text"))).alias("work"))
    return with_first(work, "work", "doc_id").select("doc_id", "work", F.when(i != F.col("first"), F.col("first")).alias("duplicate_of"))


@query("""WITH old AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_acctbal FROM customer WHERE c_custkey % 5 <> 0),
 new AS (SELECT c_custkey, c_name, c_mktsegment AS segment, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(o.segment, n.segment) AS segment, coalesce(o.c_name, n.c_name) AS c_name,
 CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN n.c_custkey IS NULL THEN 'none' WHEN n.c_acctbal IS DISTINCT FROM o.c_acctbal THEN 'full' WHEN o.segment IS NULL AND n.segment IS NOT NULL THEN 'meta' ELSE 'none' END AS action
FROM old o FULL OUTER JOIN new n USING (c_custkey)""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations of one table merged field by field."""
    c = load(spark, sf_dir, "customer")
    old = c.where("c_custkey % 5 <> 0").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"), "c_acctbal")
    new = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return upsert.merge(old, new, "c_custkey", arrival="c_custkey", replaced=["c_acctbal"], filled=["segment"], fixed=["c_name"])


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_suppkey)) AS contents FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1")
def key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line keys under which different content was delivered."""
    return upsert.conflicts(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("""WITH f AS (SELECT sha256(text) AS fp, doc_id, source FROM documents) SELECT fp, count(*) AS members, count(DISTINCT source) AS sources, min(doc_id) AS representative FROM f GROUP BY fp HAVING count(*) >= 2""")
def fingerprint_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal content, with the number of independent sources."""
    f = load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("fp"), "doc_id", "source")
    return f.groupBy("fp").agg(F.count("*").alias("members"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("representative")).where("members >= 2")


@query("""SELECT o_orderkey, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1 OR o_orderdate >= TIMESTAMP '2001-01-01 00:00:00'""")
def retention_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up leaves: everything recent and the newest row of each selector."""
    orders, cut = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    newest = winner(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"]).where(F.col("o_orderdate") < cut)
    return orders.where(F.col("o_orderdate") >= cut).unionByName(newest)


@query(f"""WITH {ITEMS_SQL} SELECT item_id, CASE WHEN regexp_matches(title, '^(untitled|test)') THEN 'placeholder_title' WHEN length(title) < 12 THEN 'short_title' WHEN published > DATE '{ITEMS_AS_OF}' THEN 'future_date'
 WHEN route = 'news' AND date_diff('day', published, DATE '{ITEMS_AS_OF}') > 300 THEN 'stale' WHEN date_diff('day', published, DATE '{ITEMS_AS_OF}') > 400 THEN 'stale' WHEN route IS NULL THEN 'off_topic' ELSE 'admitted' END AS reason FROM items""")
def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the first rule that refuses it; refused rows stay, with their reason."""
    age = F.datediff(as_of(), "published")
    rules = [
        ("placeholder_title", F.col("title").rlike("^(untitled|test)")), ("short_title", F.length("title") < 12), ("future_date", F.col("published") > as_of()),
        ("stale", ((F.col("route") == "news") & (age > 300)) | (age > 400)), ("off_topic", F.col("route").isNull()),
    ]
    return items(spark, sf_dir).select("item_id", first_match(rules, "admitted").alias("reason"))


@query("""WITH g AS (SELECT doc_id, md5(text) AS h, lag(md5(text)) OVER (PARTITION BY source ORDER BY doc_id) AS before, source FROM documents) SELECT source, count(*) FILTER (WHERE before IS NULL OR before <> h) AS changed, count(*) AS snapshots FROM g GROUP BY source""")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source's snapshots differ from the one before."""
    h = load(spark, sf_dir, "documents").select("source", "doc_id", F.md5("text").alias("h"))
    g = h.withColumn("before", F.lag("h").over(Window.partitionBy("source").orderBy("doc_id")))
    return g.groupBy("source").agg(F.count_if(F.col("before").isNull() | (F.col("before") != F.col("h"))).alias("changed"), F.count("*").alias("snapshots"))


@query(f"""WITH {ITEMS_SQL} SELECT item_id, CASE WHEN status = 'inbox' AND date_diff('day', published, DATE '{ITEMS_AS_OF}') > 180 AND route IS NOT NULL THEN 'hold' ELSE status END AS status_after FROM items""")
def stale_inbox_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old inbox items are put on hold; items without a route are evergreen and stay."""
    old = (F.col("status") == "inbox") & (F.datediff(as_of(), "published") > 180) & F.col("route").isNotNull()
    return items(spark, sf_dir).select("item_id", F.when(old, "hold").otherwise(F.col("status")).alias("status_after"))


@query("""WITH k AS (SELECT doc_id, source AS key1, md5(text) AS key2 FROM documents), e AS (SELECT min(doc_id) AS known, md5(text) AS key2 FROM documents WHERE doc_id % 2 = 0 GROUP BY 2), s AS (SELECT min(doc_id) AS known, source AS key1 FROM documents WHERE doc_id % 2 = 0 GROUP BY 2)
SELECT k.doc_id, coalesce(e.known, s.known) AS matched, CASE WHEN e.known IS NOT NULL THEN 'content' WHEN s.known IS NOT NULL THEN 'source' ELSE 'none' END AS by_key FROM k LEFT JOIN e USING (key2) LEFT JOIN s USING (key1)""")
def multi_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known row by the best key, else by the next one."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("key1"), F.md5("text").alias("key2"))
    known = d.where("doc_id % 2 = 0")
    e, s = known.groupBy("key2").agg(F.min("doc_id").alias("by_content")), known.groupBy("key1").agg(F.min("doc_id").alias("by_source"))
    out = d.join(e, "key2", "left").join(s, "key1", "left")
    by = first_match([("content", F.col("by_content").isNotNull()), ("source", F.col("by_source").isNotNull())], "none")
    return out.select("doc_id", F.coalesce("by_content", "by_source").alias("matched"), by.alias("by_key"))


@query("""WITH a AS (SELECT n_nationkey AS id, lower(n_name) AS label FROM nation UNION ALL SELECT n_nationkey, 'region ' || CAST(n_regionkey AS VARCHAR) FROM nation), q AS (SELECT DISTINCT label FROM a UNION ALL SELECT 'nowhere')
SELECT q.label, CASE WHEN count(DISTINCT a.id) = 0 THEN 'unresolved' WHEN count(DISTINCT a.id) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN count(DISTINCT a.id) = 1 THEN min(a.id) END AS id FROM q LEFT JOIN a ON a.label = q.label GROUP BY q.label""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to the one entity that bears them; several are ambiguous."""
    n = load(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("id"), fold(F.col("n_name")).alias("label")).unionAll(n.select(F.col("n_nationkey"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))))
    q = a.select("label").distinct().unionAll(spark.createDataFrame([("nowhere",)], "label string"))
    found = F.countDistinct("id")
    return q.join(a, "label", "left").groupBy("label").agg(first_match([("unresolved", found == 0), ("resolved", found == 1)], "ambiguous").alias("outcome"), F.when(found == 1, F.min("id")).alias("id"))


@query("SELECT p_partkey, sha256(p_brand || chr(31) || p_type || chr(31) || CAST(p_size AS VARCHAR)) AS series_key FROM part")
def series_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic identities from the parts of a canonical key."""
    return load(spark, sf_dir, "part").select("p_partkey", fingerprint(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("series_key"))
