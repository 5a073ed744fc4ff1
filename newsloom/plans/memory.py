"""What was found, rated and decided before: queues, ledgers, relations and look-alikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import case_sql, rule_table
from ..functions.text import fold
from ..operators.latest import top_per_group, winner
from ..operators.related import related
from ..sources.tables import ITEMS_AS_OF, ITEMS_SQL, LOG_SQL, items, load, log
from .registry import query

#: Purchases stand in for ratings: the user is the item, the number in the properties the rating (0 to 9 by its last digit).
_RATED_SQL = f"{ITEMS_SQL}, {LOG_SQL}, rated AS (SELECT user_id AS item_id, max_by(k % 10, (ts, event_id)) AS rating FROM log WHERE event_type = 'purchase' GROUP BY 1), relations AS (SELECT event_id AS relation, user_id AS item_id, k AS origin_id, event_type AS kind FROM log WHERE event_type IN ('view', 'click'))"


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, rating): the latest rating of each item, by one aggregate."""
    rows = log(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("item_id"), "ts", "event_id", (F.col("k") % 10).alias("rating"))
    return winner(rows, ["item_id"], ["ts", "event_id"], ["rating"])


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where(F.col("event_type").isin("view", "click")).select(F.col("event_id").alias("relation"), F.col("user_id").alias("item_id"), F.col("k").alias("origin_id"), F.col("event_type").alias("kind"))


@query(f"WITH {_RATED_SQL} SELECT source_id AS tag, i.item_id, title, rating FROM items i LEFT JOIN rated USING (item_id)")
def tagged_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with their items and each item's latest rating, where it has one."""
    return items(spark, sf_dir).join(ratings(spark, sf_dir), "item_id", "left").select(F.col("source_id").alias("tag"), "item_id", "title", "rating")


@query(f"WITH {_RATED_SQL} SELECT relation, i.item_id, i.title, kind, o.title AS origin_title, coalesce(rating, 5) AS rating FROM relations r JOIN items i USING (item_id) LEFT JOIN items o ON o.item_id = r.origin_id LEFT JOIN rated ON rated.item_id = i.item_id")
def relation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the item found, the item it was found from, and the rating."""
    i = items(spark, sf_dir).select("item_id", "title")
    origin = i.select(F.col("item_id").alias("origin_id"), F.col("title").alias("origin_title"))
    return relations(spark, sf_dir).join(i, "item_id").join(origin, "origin_id", "left").join(ratings(spark, sf_dir), "item_id", "left").select("relation", "item_id", "title", "kind", "origin_title", F.coalesce("rating", F.lit(5)).alias("rating"))


@query(f"WITH {_RATED_SQL} SELECT i.item_id, title, count(*) AS hits FROM relations JOIN items i USING (item_id) WHERE NOT EXISTS (SELECT 1 FROM rated WHERE rated.item_id = i.item_id AND rating < 3) GROUP BY ALL ORDER BY hits DESC, any_value(published) DESC, i.item_id LIMIT 20")
def similar_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty items with most relation hits, newest first among equals; poorly rated ones wait: the limit is the feature."""
    hits = relations(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("hits"))
    rows = items(spark, sf_dir).join(hits, "item_id").join(ratings(spark, sf_dir).where("rating < 3"), "item_id", "left_anti")
    return rows.orderBy(F.desc("hits"), F.desc("published"), "item_id").limit(20).select("item_id", "title", "hits")


@query(f"""WITH {_RATED_SQL}, h AS (SELECT item_id, count(*) AS hits, count(*) FILTER (WHERE kind = 'click') > 0 AS narrowed, avg(origin_id) / 100 AS weight FROM relations GROUP BY 1), a AS (SELECT source_id, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 4) AS rate FROM items WHERE quality IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
SELECT i.item_id, narrowed, round(weight, 6) AS weight, coalesce(rate, 50.0) AS authority, hits FROM items i JOIN h USING (item_id) LEFT JOIN a USING (source_id) ORDER BY narrowed DESC, round(weight, 6) DESC, coalesce(rate, 50.0) DESC, hits DESC, published DESC, i.item_id LIMIT 50""")
def candidate_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty candidates by five keys: narrowed by a person, weight of reasons, authority (50 where too few), hits, day."""
    h = relations(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("hits"), (F.count_if(F.col("kind") == "click") > 0).alias("narrowed"), F.round(F.avg("origin_id") / 100, 6).alias("weight"))
    i = items(spark, sf_dir)
    a = i.where("quality is not null").groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.lit(100.0) * F.count_if(F.col("quality") == 1) / F.count("*"), 4).alias("rate")).where("n >= 3").drop("n")
    rows = i.join(h, "item_id").join(a, "source_id", "left").withColumn("authority", F.coalesce("rate", F.lit(50.0)))
    return rows.orderBy(F.desc("narrowed"), F.desc("weight"), F.desc("authority"), F.desc("hits"), F.desc("published"), "item_id").limit(50).select("item_id", "narrowed", "weight", "authority", "hits")


@query(f"WITH {_RATED_SQL}, r AS (SELECT kind, origin_id % 6 AS reason, rating FROM relations JOIN rated USING (item_id) WHERE origin_id % 6 > 0) SELECT kind, round(avg(rating), 6) AS weight, count(*) AS n, least(count(DISTINCT reason), 4) AS reasons FROM r GROUP BY kind")
def reason_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average rating of what relations with a reason found, and how many different reasons, up to four, they had."""
    r = relations(spark, sf_dir).join(ratings(spark, sf_dir), "item_id").withColumn("reason", F.col("origin_id") % 6).where("reason > 0")
    return r.groupBy("kind").agg(F.round(F.avg("rating"), 6).alias("weight"), F.count("*").alias("n"), F.least(F.countDistinct("reason"), F.lit(4)).alias("reasons"))


_WEIGHTS = "CAST(k % 20 - 9 AS DOUBLE) / 20"


@query(f"WITH {LOG_SQL}, w AS (SELECT user_id, event_type AS reason, round(avg({_WEIGHTS}), 6) AS w FROM log GROUP BY ALL), p AS (SELECT user_id, reason, w, 'for' AS side, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, reason) AS r FROM w WHERE w > 0.05 UNION ALL SELECT user_id, reason, w, 'against', row_number() OVER (PARTITION BY user_id ORDER BY w, reason) FROM w WHERE w < -0.05) SELECT user_id, side, reason, w FROM p WHERE r <= CASE side WHEN 'for' THEN 3 ELSE 2 END")
def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three reasons that speak most for each item and two that speak most against it, of some weight."""
    w = log(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("reason")).agg(F.round(F.avg(F.expr(_WEIGHTS)), 6).alias("w"))
    best = top_per_group(w.where("w > 0.05"), ["user_id"], [F.desc("w"), F.col("reason")], 3).select("user_id", F.lit("for").alias("side"), "reason", "w")
    worst = top_per_group(w.where("w < -0.05"), ["user_id"], [F.col("w"), F.col("reason")], 2).select("user_id", F.lit("against"), "reason", "w")
    return best.unionAll(worst)


@query(f"WITH {LOG_SQL} SELECT event_id, user_id, k FROM log l WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM log r WHERE r.event_type = 'error' AND r.k = l.event_id)")
def active_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the ledger that no later entry takes back."""
    rows = log(spark, sf_dir)
    taken = rows.where("event_type = 'error'").select(F.col("k").alias("event_id")).distinct()
    return rows.where("event_type <> 'error'").join(taken, "event_id", "left_anti").select("event_id", "user_id", "k")


_TITLE_KEY = "substr(regexp_replace({0}, '[^a-z0-9]+', ''{1}), 1, 160)"


@query(f"WITH {ITEMS_SQL}, k AS (SELECT item_id, {_TITLE_KEY.format('title', chr(44) + chr(39) + 'g' + chr(39))} AS title_key FROM items WHERE regexp_matches(title, '^[ -~]*$')) SELECT title_key, count(*) AS n, min(item_id) AS first FROM k WHERE length(title_key) >= 25 GROUP BY 1 HAVING count(*) > 1")
def same_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain titles that say the same: letters and digits alone, of some length."""
    rows = items(spark, sf_dir).where(F.col("title").rlike("^[ -~]*$")).select("item_id", F.substring(F.regexp_replace(fold(F.col("title")), "[^a-z0-9]+", ""), 1, 160).alias("title_key"))
    return rows.where(F.length("title_key") >= 25).groupBy("title_key").agg(F.count("*").alias("n"), F.min("item_id").alias("first")).where("n > 1")


@query(f"WITH {LOG_SQL}, d AS (SELECT DISTINCT substr(sha256(concat('item:', user_id)), 1, 16) AS key FROM log WHERE event_type IN ('purchase', 'error')) SELECT doc_id, substr(sha256(concat('item:', doc_id)), 1, 16) AS key FROM documents WHERE substr(sha256(concat('item:', doc_id)), 1, 16) NOT IN (SELECT key FROM d)")
def undecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are not in the ledger of decisions, which keeps short hashes of keys."""
    key = lambda c: F.substring(F.sha2(F.concat(F.lit("item:"), F.col(c)), 256), 1, 16).alias("key")
    decided = log(spark, sf_dir).where(F.col("event_type").isin("purchase", "error")).select(key("user_id")).distinct()
    return load(spark, sf_dir, "documents").select("doc_id", key("doc_id")).join(decided, "key", "left_anti").select("doc_id", "key")


@query(f"WITH {ITEMS_SQL} SELECT item_id, CASE WHEN date_diff('day', published, DATE '{ITEMS_AS_OF}') > 200 THEN 'evergreen' ELSE 'current' END AS lane FROM items")
def lane_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", F.when(F.datediff(F.lit(ITEMS_AS_OF).cast("date"), "published") > 200, "evergreen").otherwise("current").alias("lane"))


@query(f"WITH {ITEMS_SQL} SELECT status, count(*) AS kept FROM items WHERE NOT (status = 'trash' AND published < DATE '{ITEMS_AS_OF}' - 2 OR status = 'production' AND toxic = 0 AND published < DATE '{ITEMS_AS_OF}' - 100) GROUP BY 1")
def purged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a purge by age leaves: the trash is kept for days, what is done for longer."""
    older = lambda d: F.col("published") < F.date_sub(F.lit(ITEMS_AS_OF).cast("date"), d)
    gone = (F.col("status") == "trash") & older(2) | (F.col("status") == "production") & (F.col("toxic") == 0) & older(100)
    return items(spark, sf_dir).where(~gone).groupBy("status").agg(F.count("*").alias("kept"))


_CYCLE = "CASE WHEN k % 4 = 0 THEN concat('call ', 2020 + k % 3, '/', user_id % 7) WHEN k % 4 = 1 THEN concat('round ', user_id % 7, ' of ', 2020 + k % 3) ELSE 'news' END"


@query(f"WITH {LOG_SQL}, t AS (SELECT event_id, {_CYCLE} AS title FROM log), c AS (SELECT event_id, CASE WHEN regexp_matches(title, '20[0-9]{{2}}') THEN concat(regexp_extract(title, '(20[0-9]{{2}})', 1), '-', regexp_extract(title, '(?:/|round )([0-9]+)', 1)) END AS cycle FROM t) SELECT cycle, count(*) AS members, min(event_id) AS first, max(event_id) AS last FROM c WHERE cycle IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exam_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that name the same cycle, however they print it: classes instead of pairs."""
    year, number = F.regexp_extract("title", "(20[0-9]{2})", 1), F.regexp_extract("title", "(?:/|round )([0-9]+)", 1)
    rows = log(spark, sf_dir).selectExpr("event_id", f"{_CYCLE} AS title").select("event_id", F.when(F.col("title").rlike("20[0-9]{2}"), F.concat(year, F.lit("-"), number)).alias("cycle"))
    return rows.where("cycle is not null").groupBy("cycle").agg(F.count("*").alias("members"), F.min("event_id").alias("first"), F.max("event_id").alias("last")).where("members > 1")


@query()
def cross_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, other_id, ratio) in both directions: all titles of other sources whose sequences are alike to 0.8 and more.

    Equal titles of a source are one representative; no pair is lost, whatever the titles share.
    """
    return related(items(spark, sf_dir), least=24).select("item_id", "other_id", F.round("ratio", 6).alias("ratio"))


_KEYS = "concat('doi:', item_id % 200), CASE WHEN item_id % 3 = 0 THEN concat('url:', item_id % 90) END, CASE WHEN item_id % 5 = 0 THEN concat('nature:', item_id % 50) END"


@query(f"WITH {ITEMS_SQL}, k AS (SELECT item_id, unnest([{_KEYS}]) AS key FROM items), known AS (SELECT DISTINCT key FROM k WHERE item_id % 7 = 0 AND key IS NOT NULL) SELECT item_id, count(*) AS keys FROM k JOIN known USING (key) WHERE item_id % 7 <> 0 GROUP BY 1")
def keyed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that share any one of their keys with what is known: keys opened, one equi-join, items counted once."""
    k = items(spark, sf_dir).selectExpr("item_id", f"explode(array({_KEYS})) AS key").where("key is not null")
    known = k.where("item_id % 7 = 0").select("key").distinct()
    return k.where("item_id % 7 <> 0").join(known, "key").groupBy("item_id").agg(F.count("*").alias("keys"))


@query(f"""WITH {LOG_SQL}, intents AS (SELECT DISTINCT user_id AS intent FROM log WHERE event_type = 'signup'), ledger AS (SELECT user_id AS intent, k AS source FROM log WHERE event_type = 'click'), active AS (SELECT s_suppkey AS source, s_nationkey AS nation FROM supplier WHERE s_acctbal > 0)
SELECT intent, count(DISTINCT source) AS sources FROM intents JOIN ledger USING (intent) JOIN active a USING (source) WHERE EXISTS (SELECT 1 FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = a.nation AND o.o_orderstatus = 'O') GROUP BY intent""")
def discovery_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents with the sources found for them that are active where something is going on: semi-joins, never repeated rows."""
    rows = log(spark, sf_dir)
    intents = rows.where("event_type = 'signup'").select(F.col("user_id").alias("intent")).distinct()
    ledger = rows.where("event_type = 'click'").select(F.col("user_id").alias("intent"), F.col("k").alias("source")).distinct()
    busy = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select(F.col("c_nationkey").alias("s_nationkey")).distinct()
    active = load(spark, sf_dir, "supplier").where("s_acctbal > 0").join(busy, "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("source"))
    return intents.join(ledger, "intent").join(active, "source", "left_semi").groupBy("intent").agg(F.count("*").alias("sources"))


_FATE = (("existing", "retried"), ("refused", "excluded"), ("duplicate", "known"), ("merged", "aliased"))


@query(f"""WITH {LOG_SQL}, c AS (SELECT event_id, k AS label, user_id FROM log WHERE event_type = 'view'), f AS (SELECT min(event_id) AS event_id, label FROM c GROUP BY label, user_id)
SELECT c.event_id, {case_sql(_FATE, 'new')} AS fate FROM (SELECT c.event_id, f.event_id IS NULL AS retried, c.label % 10 = 9 AS excluded, s.s_suppkey IS NOT NULL AND s.s_suppkey % 2 = 0 AS known, s.s_suppkey IS NOT NULL AND s.s_suppkey % 2 = 1 AS aliased FROM c LEFT JOIN f USING (event_id) LEFT JOIN supplier s ON s.s_suppkey = c.label) c""")
def candidate_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each proposed candidate: a repeated proposal returns the row there is, known and excluded ones are not created anew."""
    c = log(spark, sf_dir).where("event_type = 'view'").select("event_id", F.col("k").alias("label"), "user_id")
    first = c.groupBy("label", "user_id").agg(F.min("event_id").alias("event_id")).select("event_id", F.lit(True).alias("first"))
    known = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("label"), "s_suppkey")
    rows = c.join(first, "event_id", "left").join(known, "label", "left")
    rows = rows.selectExpr("event_id", "first IS NULL AS retried", "label % 10 = 9 AS excluded", "s_suppkey IS NOT NULL AND s_suppkey % 2 = 0 AS known", "s_suppkey IS NOT NULL AND s_suppkey % 2 = 1 AS aliased")
    return rows.select("event_id", rule_table(_FATE, "new").alias("fate"))
