"""Source health, schedules, state machines and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import backoff_minutes
from ..functions.rules import all_matches, first_match, missing
from ..operators.latest import leading_streak
from ..sources.tables import EVENTS_AS_OF, LOG_SQL, load, log
from .registry import query



def as_of() -> Column:
    """The reference day."""
    return F.lit(EVENTS_AS_OF).cast("date")


@query(f"""WITH {LOG_SQL}, g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, max(day) AS last_day FROM log GROUP BY user_id),
 s AS (SELECT user_id, count(*) FILTER (WHERE broken = 0) AS streak FROM (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS broken FROM log) GROUP BY user_id)
SELECT user_id, CASE WHEN streak >= 3 THEN 'failing' WHEN date_diff('day', last_day, DATE '{EVENTS_AS_OF}') >= 5 THEN 'overdue' WHEN n < 10 THEN 'small_sample' WHEN CAST(errors AS DOUBLE) / n >= 0.3 THEN 'reject' WHEN CAST(errors AS DOUBLE) / n >= 0.25 THEN 'watch' ELSE 'keep' END AS status FROM g JOIN s USING (user_id)""")
def source_revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules over a source's figures: the first that holds is its recommendation."""
    rows = log(spark, sf_dir)
    g = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("day").alias("last_day"))
    s = leading_streak(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error")
    rate = F.col("errors") / F.col("n")
    rules = [("failing", F.col("streak") >= 3), ("overdue", F.datediff(as_of(), "last_day") >= 5), ("small_sample", F.col("n") < 10), ("reject", rate >= 0.3), ("watch", rate >= 0.25)]
    return g.join(s, "user_id").select("user_id", first_match(rules, "keep").alias("status"))


@query(f"""WITH {LOG_SQL}, d AS (SELECT user_id % 20 AS source, day, count(*) FILTER (WHERE event_type = 'purchase') AS accepted FROM log GROUP BY ALL),
 r AS (SELECT *, sum(CASE WHEN accepted > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS broken FROM d)
SELECT source, CAST(sum(accepted) AS BIGINT) AS accepted, count(*) FILTER (WHERE broken = 0) AS zero_streak, CASE WHEN sum(accepted) = 0 THEN 'no_eligible' WHEN count(*) FILTER (WHERE broken = 0) >= 3 THEN 'sparse' WHEN sum(accepted) < 20 THEN 'low' ELSE 'configured' END AS state FROM r GROUP BY source""")
def coverage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = log(spark, sf_dir).groupBy((F.col("user_id") % 20).alias("source"), "day").agg(F.count_if(F.col("event_type") == "purchase").alias("accepted"))
    s = leading_streak(d, ["source"], ["day"], F.col("accepted") > 0).withColumnRenamed("streak", "zero_streak")
    total = d.groupBy("source").agg(F.sum("accepted").alias("accepted"))
    rules = [("no_eligible", F.col("accepted") == 0), ("sparse", F.col("zero_streak") >= 3), ("low", F.col("accepted") < 20)]
    return total.join(s, "source").select("source", "accepted", "zero_streak", first_match(rules, "configured").alias("state"))


@query(f"""WITH {LOG_SQL}, c AS (SELECT day, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, row_number() OVER (ORDER BY day DESC) AS r FROM log GROUP BY day), t AS (SELECT CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(failed) AS BIGINT) AS failed FROM c WHERE r <= 14)
SELECT runs, failed, round(CAST(failed AS DOUBLE) / runs, 4) AS failure_rate, CASE WHEN CAST(failed AS DOUBLE) / runs > 0.5 THEN 'block' WHEN CAST(failed AS DOUBLE) / runs > 0.1 THEN 'caution' ELSE 'safe' END AS level FROM t""")
def capacity_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 14 cycles together: pre-aggregated by day, then a top-k of days."""
    c = log(spark, sf_dir).groupBy("day").agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"))
    t = c.orderBy(F.desc("day")).limit(14).agg(F.sum("runs").alias("runs"), F.sum("failed").alias("failed"))
    rate = F.col("failed") / F.col("runs")
    return t.select("runs", "failed", F.round(rate, 4).alias("failure_rate"), first_match([("block", rate > 0.5), ("caution", rate > 0.1)], "safe").alias("level"))


@query(f"""WITH {LOG_SQL}, f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') % 9 AS failures, max(ts) AS last_try FROM log GROUP BY user_id)
SELECT user_id, failures, CAST(CASE WHEN failures <= 0 THEN 0 ELSE least(1440, 15 * pow(2, failures - 1)) END AS BIGINT) AS wait_minutes, date_trunc('second', last_try) + to_minutes(CAST(CASE WHEN failures <= 0 THEN 0 ELSE least(1440, 15 * pow(2, failures - 1)) END AS BIGINT)) <= TIMESTAMP '2024-01-30 12:00:00' AS due FROM f""")
def backoff_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each source waits after its failures, and whether that time is over."""
    f = log(spark, sf_dir).groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") % 9).alias("failures"), F.max("ts").alias("last_try"))
    f = f.withColumn("wait_minutes", backoff_minutes(15, F.col("failures"), 1440))
    ready = F.date_trunc("second", F.col("last_try").cast("timestamp")) + F.make_dt_interval(mins=F.col("wait_minutes").cast("int"))
    return f.select("user_id", "failures", "wait_minutes", (ready <= F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("due"))


@query(f"""WITH {LOG_SQL} SELECT event_id, CASE WHEN event_type <> 'error' THEN 'ok' WHEN k % 10 IN (0, 1) THEN 'rate_limited' WHEN k % 10 = 2 THEN 'not_found' WHEN k % 10 < 6 THEN 'timeout' ELSE 'server' END AS failure_class FROM log""")
def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("k") % 10
    rules = [("ok", F.col("event_type") != "error"), ("rate_limited", d.isin(0, 1)), ("not_found", d == 2), ("timeout", d < 6)]
    return log(spark, sf_dir).select("event_id", first_match(rules, "server").alias("failure_class"))


@query(f"""WITH {LOG_SQL}, d AS (SELECT day, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS accepted FROM log GROUP BY day)
SELECT day, concat_ws(',', CASE WHEN failed * 4 > runs THEN 'many_failures' END, CASE WHEN accepted = 0 THEN 'nothing_accepted' END, CASE WHEN runs < 300 THEN 'few_runs' END) AS conditions FROM d""")
def attention_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = log(spark, sf_dir).groupBy("day").agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("accepted"))
    codes = all_matches([("many_failures", F.col("failed") * 4 > F.col("runs")), ("nothing_accepted", F.col("accepted") == 0), ("few_runs", F.col("runs") < 300)])
    return d.select("day", F.array_join(codes, ",").alias("conditions"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'retired' WHEN s_acctbal < 1000 THEN 'manual' WHEN o.last_ship IS NULL THEN 'never_run' WHEN date_diff('day', CAST(o.last_ship AS DATE), DATE '2001-12-31') > 75 THEN 'overdue' WHEN o.n < 500 THEN 'healthy_empty' ELSE 'healthy' END AS health
FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_shipdate) AS last_ship, count(*) AS n FROM lineitem GROUP BY 1) o ON o.l_suppkey = s_suppkey""")
def source_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configured source with one state of health."""
    o = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_shipdate").alias("last_ship"), F.count("*").alias("n"))
    rows = load(spark, sf_dir, "supplier").join(o, "s_suppkey", "left")
    rules = [("retired", F.col("s_acctbal") < 0), ("manual", F.col("s_acctbal") < 1000), ("never_run", F.col("last_ship").isNull()), ("overdue", F.datediff(F.lit("2001-12-31").cast("date"), F.to_date("last_ship")) > 75), ("healthy_empty", F.col("n") < 500)]
    return rows.select("s_suppkey", first_match(rules, "healthy").alias("health"))


@query("""WITH c AS (SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal <= 0 THEN 'funds' END, CASE WHEN n IS NULL THEN 'no_orders' END, CASE WHEN n < 8 THEN 'few_orders' END) AS failures FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey)
SELECT c_custkey, failures, CASE WHEN failures = '' THEN 'automation_ready' WHEN contains(failures, 'no_orders') OR contains(failures, 'funds') THEN 'blocked' ELSE 'manual_intake' END AS state FROM c""")
def activation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent gates with all their failures, and the state that follows."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = load(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    failures = all_matches([("funds", F.col("c_acctbal") <= 0), ("no_orders", F.col("n").isNull()), ("few_orders", F.col("n") < 8)])
    rows = rows.select("c_custkey", failures.alias("f"))
    state = first_match([("automation_ready", F.size("f") == 0), ("blocked", F.arrays_overlap("f", F.array(F.lit("funds"), F.lit("no_orders"))))], "manual_intake")
    return rows.select("c_custkey", F.array_join("f", ",").alias("failures"), state.alias("state"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE source END AS source, CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE lang END AS lang, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN source IS NULL OR trim(source) = '' THEN 'source' END, CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'lang' END, CASE WHEN n_chars IS NULL THEN 'n_chars' END) AS missing FROM d""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the required fields that are null or blank."""
    i = F.col("doc_id")
    d = load(spark, sf_dir, "documents").select("doc_id", F.when(i % 6 != 0, F.col("source")).alias("source"), F.when(i % 4 == 0, "  ").otherwise(F.col("lang")).alias("lang"), F.when(i % 10 != 0, F.col("n_chars")).alias("n_chars"))
    return d.select("doc_id", F.array_join(missing(["source", "lang", "n_chars"]), ",").alias("missing"))


@query("""WITH s AS (SELECT p_partkey, p_size * 2 AS density, CASE WHEN length(p_type) > 7 THEN 20 ELSE 5 END AS description, p_retailprice FROM part), t AS (SELECT *, least(density, 60) + least(description, 15) AS raw FROM s)
SELECT p_partkey, round(100.0 * raw / 75, 2) AS score, CASE WHEN 100.0 * raw / 75 >= 80 THEN 'pass' WHEN 100.0 * raw / 75 >= 50 THEN 'watch' ELSE 'fail' END AS band FROM t""")
def source_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clamped weighted score with its band."""
    p = load(spark, sf_dir, "part")
    raw = F.least(p.p_size * 2, F.lit(60)) + F.least(F.when(F.length("p_type") > 7, 20).otherwise(5), F.lit(15))
    score = F.lit(100.0) * raw / 75
    return p.select("p_partkey", F.round(score, 2).alias("score"), first_match([("pass", score >= 80), ("watch", score >= 50)], "fail").alias("band"))


@query(f"""WITH {LOG_SQL} SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29 00:00:00') AS last_48h, bool_and(event_type <> 'error' OR value > 1) AS ok, CASE WHEN bool_and(event_type <> 'error' OR value > 1) THEN 'ready' WHEN count(*) FILTER (WHERE event_type = 'error' AND value <= 1) > 2 THEN 'blocked' ELSE 'degraded' END AS readiness FROM log GROUP BY user_id""")
def health_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = (F.col("event_type") != "error") | (F.col("value") > 1)
    ok = F.bool_and(fine)
    return log(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("ts") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")).alias("last_48h"), ok.alias("ok"), first_match([("ready", ok), ("blocked", F.count_if(~fine) > 2)], "degraded").alias("readiness"))


_REPLAY_SQL = """a AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IN ('purchase', 'signup') OR event_type = 'error' AND k % 10 <> 0 THEN 1 WHEN event_type = 'click' THEN -1 ELSE 0 END AS step, event_type = 'error' AND k % 10 = 0 AS refused FROM log),
 b AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS height FROM a), c AS (SELECT *, height - least(0, min(height) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS depth FROM b),
 d AS (SELECT user_id, max_by(depth, event_id) AS depth, count(*) FILTER (WHERE refused) AS refused FROM c GROUP BY user_id),
 t AS (SELECT c.user_id, max_by(event_type, event_id) AS event_type FROM c JOIN d ON c.user_id = d.user_id AND c.depth = d.depth WHERE step = 1 GROUP BY c.user_id)"""


@query(f"""WITH {LOG_SQL}, {_REPLAY_SQL} SELECT d.user_id, CASE WHEN d.depth = 0 THEN 'inbox' WHEN event_type = 'purchase' THEN 'production' WHEN event_type = 'signup' THEN 'hold' ELSE 'trash' END AS state, CAST(d.depth AS BIGINT) AS changes, d.refused FROM d LEFT JOIN t USING (user_id)""")
def triage_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's state after its whole action log: promote, hold, delete (with a reason) and undo, replayed in order.

    An undo takes back the last change that still stands, as from a stack. The stack's depth is the running sum of steps above its
    running minimum, and what stands at the end is the last change that reached the final depth: windows and aggregates, no replay.
    """
    rows = log(spark, sf_dir).select("user_id", "event_id", "event_type", "k")
    refused = (F.col("event_type") == "error") & (F.col("k") % 10 == 0)  # a deletion needs a reason
    change = F.col("event_type").isin("purchase", "signup") | (F.col("event_type") == "error") & ~refused
    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.when(change, 1).when(F.col("event_type") == "click", -1).otherwise(0).alias("step"), refused.alias("refused"))
    rows = rows.withColumn("height", F.sum("step").over(so_far))
    rows = rows.withColumn("depth", F.col("height") - F.least(F.lit(0), F.min("height").over(so_far)))
    last = rows.groupBy("user_id", "depth").agg(F.max("event_id").alias("event_id"), F.max(F.when(F.col("step") == 1, F.struct("event_id", "event_type"))).alias("change"), F.count_if("refused").alias("refused"))
    end = last.groupBy("user_id").agg(F.max(F.struct("event_id", "depth", "change")).alias("end"), F.sum("refused").alias("refused"))
    kind = F.col("end.change.event_type")
    state = F.when(F.col("end.depth") == 0, "inbox").when(kind == "purchase", "production").when(kind == "signup", "hold").otherwise("trash")
    return end.select("user_id", state.alias("state"), F.col("end.depth").alias("changes"), "refused")


@query(f"""WITH {LOG_SQL}, s AS (SELECT event_type AS kind, user_id, max(day) AS last_run FROM log GROUP BY ALL) SELECT kind, user_id, last_run FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY last_run, user_id) AS r FROM s) WHERE r <= 10""")
def least_recent_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten scopes of each kind that ran longest ago."""
    s = log(spark, sf_dir).groupBy(F.col("event_type").alias("kind"), "user_id").agg(F.max("day").alias("last_run"))
    r = F.row_number().over(Window.partitionBy("kind").orderBy("last_run", "user_id"))
    return s.withColumn("r", r).where("r <= 10").drop("r")


@query("""WITH c AS (SELECT n_nationkey, count(c_custkey) AS total, count(c_custkey) FILTER (WHERE c_acctbal > 0) AS active FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_nationkey, total, active, CASE WHEN total = 0 THEN 'not_started' WHEN active = 0 THEN 'stalled' WHEN active < total THEN 'in_progress' ELSE 'complete' END AS stage FROM c""")
def onboarding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("t"), F.count_if(F.col("c_acctbal") > 0).alias("a"))
    rows = load(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select("n_nationkey", F.coalesce("t", F.lit(0)).cast("long").alias("total"), F.coalesce("a", F.lit(0)).cast("long").alias("active"))
    return rows.select("*", first_match([("not_started", F.col("total") == 0), ("stalled", F.col("active") == 0), ("in_progress", F.col("active") < F.col("total"))], "complete").alias("stage"))


@query("""SELECT o_orderkey, o_custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'no_evidence' WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'source_blocked' ELSE 'complete' END AS link FROM orders""")
def evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose chain to a usable source is broken, and where."""
    l = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has", F.lit(True))  # noqa: E741
    c = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("usable"))
    rows = load(spark, sf_dir, "orders").join(l, "o_orderkey", "left").join(c, "o_custkey", "left")
    return rows.select("o_orderkey", "o_custkey", first_match([("no_evidence", F.col("has").isNull()), ("source_blocked", F.col("usable").isNull())], "complete").alias("link"))
