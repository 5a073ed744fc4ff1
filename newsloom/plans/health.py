"""Sources' health, schedules and circuits, back-off in its variants, utilisation and counts for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import case_sql, code_table, codes_sql, rule_table
from ..operators import policy as P
from ..operators.latest import leading_streak, winner
from ..sources.tables import ITEMS_SQL, LOG_SQL, items, load, log
from .registry import query

NOW = "2024-01-15 00:00:00"
#: A user's events stand in for a source's runs: errors failed, the others succeeded.
_RUNS_SQL = f"""{LOG_SQL}, past AS (SELECT * FROM log WHERE ts <= TIMESTAMP '{NOW}'), g AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN ts END) AS good, max(ts) AS tried, count(*) FILTER (WHERE event_type = 'signup') AS backlog, max_by(k, (ts, event_id)) % 10 = 0 AND max_by(event_type, (ts, event_id)) = 'error' AS permanent FROM past GROUP BY user_id),
 q AS (SELECT p.user_id, count(*) AS failures FROM past p JOIN g USING (user_id) WHERE g.good IS NULL OR p.ts > g.good GROUP BY ALL),
 s AS (SELECT g.user_id, coalesce(q.failures, 0) AS failures, backlog, permanent, CAST(floor(date_diff('second', good, TIMESTAMP '{NOW}') / 3600) AS BIGINT) AS since_last, CAST(floor(date_diff('second', tried, TIMESTAMP '{NOW}') / 3600) AS BIGINT) AS since_start, 12 * (1 + g.user_id % 3) AS cadence, g.user_id % 7 <> 0 AS admitted, g.user_id % 5 <> 0 AS in_window, g.user_id % 11 = 0 AS running FROM g LEFT JOIN q USING (user_id))"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's state at one moment: failures in a row, hours since its last success and try, cadence and admission; aggregates only."""
    past = log(spark, sf_dir).where(F.col("ts") <= F.lit(NOW).cast("timestamp_ntz"))
    last = F.max(F.struct("ts", "event_id", "event_type", "k"))
    g = past.groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("good"), F.max("ts").alias("tried"), F.count_if(F.col("event_type") == "signup").alias("backlog"), last.alias("last"))
    streak = leading_streak(past, ["user_id"], ["ts"], F.col("event_type") != "error").withColumnRenamed("streak", "failures")
    hours = lambda c: F.floor(F.timestamp_diff("SECOND", F.date_trunc("second", F.col(c).cast("timestamp")), F.lit(NOW).cast("timestamp")) / 3600)
    i = F.col("user_id")
    return g.join(streak, "user_id").select("user_id", "failures", "backlog", ((F.col("last.k") % 10 == 0) & (F.col("last.event_type") == "error")).alias("permanent"), hours("good").alias("since_last"), hours("tried").alias("since_start"), (12 * (1 + i % 3)).alias("cadence"), (i % 7 != 0).alias("admitted"), (i % 5 != 0).alias("in_window"), (i % 11 == 0).alias("running"))


@query(f"WITH {_RUNS_SQL} SELECT user_id, failures, {case_sql(P.FRESHNESS, 'FRESH')} AS freshness, {case_sql(P.CIRCUIT, 'CLOSED')} AS circuit, {codes_sql(P.ALERTS)} AS alerts FROM s")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness, circuit (permanent failures open it at once, transient ones after three, each with its cooldown) and alerts by severity."""
    return sources(spark, sf_dir).select("user_id", "failures", rule_table(P.FRESHNESS, "FRESH").alias("freshness"), rule_table(P.CIRCUIT, "CLOSED").alias("circuit"), code_table(P.ALERTS).alias("alerts"))


@query(f"WITH {_RUNS_SQL} SELECT user_id, coalesce({case_sql(P.SCHEDULE)}, 'run') AS plan FROM s")
def schedule_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources run now, and the first reason against each of the others."""
    return sources(spark, sf_dir).select("user_id", rule_table(P.SCHEDULE, "run").alias("plan"))


@query(f"""WITH {_RUNS_SQL}, d AS (SELECT user_id, 10 + user_id % 4 * 10 AS cost, greatest(since_last - cadence, 0) AS late, failures FROM s WHERE since_last >= cadence AND failures < 5), o AS (SELECT *, sum(cost) OVER (ORDER BY late DESC, user_id ROWS UNBOUNDED PRECEDING) AS spent FROM d)
SELECT user_id, cost, late, CAST(spent AS BIGINT) AS spent, CASE WHEN spent <= 600 THEN 'run' WHEN failures >= 3 THEN 'manual_review' ELSE 'deferred' END AS decision FROM o""")
def run_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due sources, latest first, within a budget of seconds; what is left over waits, or is looked at by a person.

    One queue has one order, so its running cost is one ordered pass over (source, cost): the registry of sources, not the data.
    """
    due = sources(spark, sf_dir).where("since_last >= cadence and failures < 5").select("user_id", (10 + F.col("user_id") % 4 * 10).alias("cost"), F.greatest(F.col("since_last") - F.col("cadence"), F.lit(0)).alias("late"), "failures")
    spent = F.sum("cost").over(Window.orderBy(F.desc("late"), "user_id").rowsBetween(Window.unboundedPreceding, 0))
    decision = F.when(F.col("spent") <= 600, "run").when(F.col("failures") >= 3, "manual_review").otherwise("deferred")
    return due.withColumn("spent", spent).select("user_id", "cost", "late", "spent", decision.alias("decision"))


_BACKOFF = {
    "doubling": "CASE WHEN failures <= 0 THEN 0 ELSE CAST(least(1440, 15 * power(2, least(failures - 1, 30))) AS BIGINT) END", "linear": "CAST(least(720, 30 * failures) AS BIGINT)",
    "stepped": "CAST(CASE WHEN failures <= 0 THEN 0 WHEN failures = 1 THEN 5 WHEN failures = 2 THEN 30 WHEN failures = 3 THEN 240 ELSE 1440 END AS BIGINT)", "by_class": "CAST(CASE WHEN permanent THEN 10080 WHEN failures > 0 THEN least(360, 20 * failures) ELSE 0 END AS BIGINT)",
    "by_cadence": "CAST(least(cadence * 60 * (1 + failures), 4320) AS BIGINT)",
}


@query(f"WITH {_RUNS_SQL} SELECT user_id, {', '.join(f'{e} AS {n}' for n, e in _BACKOFF.items())}, since_last * 60 >= {_BACKOFF['by_cadence']} AS due FROM s")
def backoff_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes to wait by each of the five policies, and whether the one by cadence has passed."""
    return sources(spark, sf_dir).selectExpr("user_id", *(f"{e} AS {n}" for n, e in _BACKOFF.items()), f"since_last * 60 >= {_BACKOFF['by_cadence']} AS due")


@query(f"WITH {_RUNS_SQL} SELECT count(*) AS sources, round(sum(least(1.0, 24.0 / cadence)), 6) AS due_a_day, round(sum(least(1.0, 24.0 / cadence)) * 30 / 2400, 6) AS utilisation, round(sum(CASE WHEN failures > 0 THEN 1.0 ELSE 0.0 END) / count(*), 6) AS failing FROM s")
def utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a day's budget the sources' cadences ask for, at thirty seconds a run."""
    load_ = F.sum(F.least(F.lit(1.0), F.lit(24.0) / F.col("cadence")))
    return sources(spark, sf_dir).agg(F.count("*").alias("sources"), F.round(load_, 6).alias("due_a_day"), F.round(load_ * 30 / 2400, 6).alias("utilisation"), F.round(F.sum(F.when(F.col("failures") > 0, 1.0).otherwise(0.0)) / F.count("*"), 6).alias("failing"))


@query(f"""WITH {LOG_SQL}, d AS (SELECT day, count(*) AS n FROM log GROUP BY day) SELECT CAST(sum(n) AS BIGINT) AS rows_now, round(avg(n), 4) AS a_day, round(sum(n) + 90 * avg(n), 2) AS in_90_days, CASE WHEN avg(n) > 0 THEN CAST(floor((1000000 - sum(n)) / avg(n)) AS BIGINT) END AS days_to_limit FROM d""")
def growth_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows there are, come each day, will be there in ninety days, and how long until a limit."""
    d = log(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"))
    total, mean = F.sum("n"), F.avg("n")
    return d.agg(total.alias("rows_now"), F.round(mean, 4).alias("a_day"), F.round(total + 90 * mean, 2).alias("in_90_days"), F.when(mean > 0, F.floor((F.lit(1_000_000) - total) / mean)).alias("days_to_limit"))


@query(f"""WITH {LOG_SQL}, h AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS status, count(*) FILTER (WHERE event_type = 'error') AS attempts, max(ts) AS last FROM log GROUP BY user_id) SELECT status, count(*) AS n, count(*) FILTER (WHERE last > TIMESTAMP '2024-01-30 00:00:00') AS recent, count(*) FILTER (WHERE status = 'error' AND attempts >= 15) AS exhausted FROM h GROUP BY status""")
def handoff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handoffs by their last status, how many are recent, and how many used up their attempts."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    h = log(spark, sf_dir).groupBy("user_id").agg(last.alias("l"), F.count_if(F.col("event_type") == "error").alias("attempts")).select(F.col("l.event_type").alias("status"), "attempts", F.col("l.ts").alias("last"))
    return h.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("last") > F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).alias("recent"), F.count_if((F.col("status") == "error") & (F.col("attempts") >= 15)).alias("exhausted"))


@query("""SELECT 'segment' AS what, c_mktsegment AS key, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'order_status', o_orderstatus, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY ALL UNION ALL SELECT 'language', lang, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'part_type', p_type, count(*) FROM part GROUP BY ALL""")
def observability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six small counts in one table."""
    out = None
    for what, table, key in (("segment", "customer", "c_mktsegment"), ("order_status", "orders", "o_orderstatus"), ("priority", "orders", "o_orderpriority"), ("event", "events", "event_type"), ("language", "documents", "lang"), ("part_type", "part", "p_type")):
        one = load(spark, sf_dir, table).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "key", "n")
        out = one if out is None else out.unionAll(one)
    return out


_TIER = "CASE WHEN s_acctbal >= 7000 THEN 'tier_1' WHEN s_acctbal >= 3000 THEN 'tier_2' ELSE 'tier_3' END"


@query(f"SELECT {_TIER} AS tier, CASE WHEN s_suppkey % 10 = 0 THEN 'retired' ELSE 'active' END AS status, count(*) AS n, count(DISTINCT s_nationkey) AS regions FROM supplier GROUP BY ALL")
def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the registry by tier and status."""
    rows = load(spark, sf_dir, "supplier").selectExpr(f"{_TIER} AS tier", "CASE WHEN s_suppkey % 10 = 0 THEN 'retired' ELSE 'active' END AS status", "s_nationkey")
    return rows.groupBy("tier", "status").agg(F.count("*").alias("n"), F.countDistinct("s_nationkey").alias("regions"))


@query(f"""WITH {ITEMS_SQL}, a AS (SELECT n_nationkey, n_name FROM nation), i AS (SELECT CAST(item_id % 30 AS INTEGER) AS n_nationkey, count(*) AS items, count(*) FILTER (WHERE status = 'inbox') AS inbox, count(*) FILTER (WHERE status = 'production') AS briefs, max(published) AS last_fetch FROM items GROUP BY 1)
SELECT n_name, coalesce(items, 0) AS items, coalesce(inbox, 0) AS inbox, coalesce(briefs, 0) AS briefs, last_fetch, CASE WHEN items IS NULL THEN 'empty' WHEN briefs > 3 THEN 'live' WHEN inbox > 0 THEN 'waiting' ELSE 'quiet' END AS stage FROM a LEFT JOIN i USING (n_nationkey)
UNION ALL SELECT concat('orphan ', n_nationkey), items, inbox, briefs, last_fetch, 'orphan' FROM i WHERE n_nationkey NOT IN (SELECT n_nationkey FROM a)""")
def association_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each association's items, inbox and briefs in one aggregate, its stage, and carriers that belong to no association."""
    rows = items(spark, sf_dir).select((F.col("item_id") % 30).cast("int").alias("n_nationkey"), "status", "published")
    i = rows.groupBy("n_nationkey").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "inbox").alias("inbox"), F.count_if(F.col("status") == "production").alias("briefs"), F.max("published").alias("last_fetch"))
    a = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    stage = rule_table((("empty", "items IS NULL"), ("live", "briefs > 3"), ("waiting", "inbox > 0")), "quiet")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    own = a.join(i, "n_nationkey", "left").select("n_name", zero("items"), zero("inbox"), zero("briefs"), "last_fetch", stage.alias("stage"))
    orphans = i.join(a, "n_nationkey", "left_anti").select(F.concat(F.lit("orphan "), "n_nationkey"), "items", "inbox", "briefs", "last_fetch", F.lit("orphan"))
    return own.unionAll(orphans)


@query(f"""WITH {LOG_SQL}, l AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS last_actor, max(day) AS day FROM log WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY user_id) SELECT user_id, day FROM l WHERE last_actor = 'error' AND day < DATE '2024-01-31' - INTERVAL 1 DAY""")
def system_held_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a machine held last, and long enough ago: the last decision of each, by one aggregate."""
    decisions = log(spark, sf_dir).where(F.col("event_type").isin("signup", "purchase", "error"))
    last = winner(decisions, ["user_id"], ["ts", "event_id"], ["event_type", "day"])
    return last.where((F.col("event_type") == "error") & (F.col("day") < F.date_sub(F.lit("2024-01-31").cast("date"), 1))).select("user_id", "day")
