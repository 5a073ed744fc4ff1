"""What comes in: links, pages, days, feeds and trials checked at the door, and the work that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import case_sql, code_table, codes_sql, rule_table
from ..sources import markup, records
from ..sources.tables import DESK_SQL, EVENTS_AS_OF, ITEMS_AS_OF, LOG_SQL, desk, load, log
from .policy import _CASES_SQL, cases
from .registry import query

#: What speaks against a link as an article: length, words, navigation, notices and the depth of its path.
LINK_CHECKS = (
    ("short", "length(title) < 25"), ("few_words", "length(title) - length(replace(title, ' ', '')) + 1 < 4"), ("navigation", "title IN ('home', 'contact', 'about us', 'search', 'login')"), ("notice", "title LIKE 'notice%' OR title LIKE 'announcement%' OR title LIKE 'correction%'"),
    ("teaser", "title LIKE '%read more%' OR title LIKE '%...'"), ("shallow", "item_id % 7 = 0"), ("number", "translate(title, '0123456789 ', '') = ''"),
)


@query(f"WITH {DESK_SQL} SELECT item_id, {codes_sql(LINK_CHECKS)} AS codes FROM desk")
def link_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk(spark, sf_dir).select("item_id", code_table(LINK_CHECKS).alias("codes"))


DAY_VERDICT = (("UNDATED", "fetched IS NULL"), ("FRESH", f"published >= DATE '{ITEMS_AS_OF}' - INTERVAL '90' DAY"), ("ACTIVE", f"channel LIKE 'grant%' AND published >= DATE '{ITEMS_AS_OF}' - INTERVAL '180' DAY OR published >= DATE '{ITEMS_AS_OF}' - INTERVAL '120' DAY"))


@query(f"WITH {DESK_SQL} SELECT item_id, {case_sql(DAY_VERDICT, 'STALE')} AS verdict FROM desk")
def day_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh, still active, undated or stale."""
    return desk(spark, sf_dir).select("item_id", rule_table(DAY_VERDICT, "STALE").alias("verdict"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS day FROM orders WHERE year(o_orderdate) >= 2000")
def page_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of a page by what its markup says, in order, else by what its text prints; each page names another day further down."""
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    later = "<p>See also 01.01.2031.</p>"
    html = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("<meta property='article:published_time' content='"), day, F.lit(f"T00:00:00Z'><time datetime='2030-01-01'>x</time>{later}")))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("<p>01.01.2030</p><time datetime='"), day, F.lit(f"'>then</time>{later}")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit('<script type="application/ld+json">{"datePublished": "'), day, F.lit(f'"}}</script>{later}')))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("<script>var x = '01.01.2030'</script><p>Printed "), F.date_format(F.col("o_orderdate").cast("timestamp"), "dd.MM.yyyy"), F.lit(f"</p>{later}")))
        .otherwise("<p>no day</p>")
    )
    return load(spark, sf_dir, "orders").where(F.year("o_orderdate") >= 2000).select("o_orderkey", markup.page_day(html).alias("day"))


@query("SELECT s_suppkey, (s_suppkey * 7 + 19753) % 24 AS hour, CASE (s_suppkey + 19753) % 5 WHEN 0 THEN 'fetch' WHEN 1 THEN 'localise' WHEN 2 THEN 'score' WHEN 3 THEN 'sweep' ELSE 'rest' END AS job FROM supplier")
def slot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slot a day for each source and one job a tick, both turning with the number of the day."""
    today, i = F.unix_date(F.lit("2024-01-31").cast("date")), F.col("s_suppkey")
    job = F.element_at(F.array(*(F.lit(j) for j in ("fetch", "localise", "score", "sweep", "rest"))), (F.pmod(i + today, F.lit(5)) + 1).cast("int"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.pmod(i * 7 + today, F.lit(24)).alias("hour"), job.alias("job"))


#: Purity of the lanes: by route, what is refused, held or moved, and why.
PURITY = (
    ("reject:toxic", "toxic = 1"), ("reject:placeholder", "title = '' OR title LIKE 'test%'"), ("move:grant", "route = 'news' AND channel LIKE 'grant_%'"), ("hold:undated", "route = 'news' AND fetched IS NULL"), ("hold:old", f"route = 'news' AND published < DATE '{ITEMS_AS_OF}' - INTERVAL '250' DAY"),
    ("move:training", "route = 'research' AND channel = 'training'"), ("hold:unrated", "route = 'research' AND quality IS NULL"), ("reject:low", "route = 'research' AND quality = 0"), ("move:news", "route = 'notice' AND n_chars > 3000"), ("hold:short", "route = 'notice' AND length(title) < 15"), ("hold:no_route", "route IS NULL"),
)


@query(f"WITH {DESK_SQL}, p AS (SELECT item_id, route, coalesce({case_sql(PURITY)}, 'keep:clean') AS d FROM desk) SELECT item_id, split_part(d, ':', 1) AS kind, split_part(d, ':', 2) AS reason FROM p")
def lane_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each item in its lane, and why."""
    d = rule_table(PURITY, "keep:clean")
    return desk(spark, sf_dir).select("item_id", d.alias("d")).select("item_id", F.split_part("d", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("d", F.lit(":"), F.lit(2)).alias("reason"))


#: Codes of an item by category; those that reject, and those that hold it.
ITEM_CODES = (
    ("no_url", "url IS NULL"), ("expired", "deadline < today"), ("call_without_deadline", "kind = 'call' AND deadline IS NULL"), ("event_unverified", "kind IN ('congress', 'ceremony') AND NOT verified"), ("not_eligible", "token IN ('not eligible', 'closed')"), ("eligibility_unknown", "token IS NULL OR token IN ('', 'n/a')"),
    ("retracted", "retracted"), ("no_primary", "NOT primary_source AND kind = 'call'"), ("no_audience", "audience IS NULL"),
)
REJECTING = "deadline < today OR token IN ('not eligible', 'closed') OR retracted"
HOLDING = "url IS NULL OR kind = 'call' AND deadline IS NULL OR kind IN ('congress', 'ceremony') AND NOT verified OR token IS NULL OR token IN ('', 'n/a') OR NOT primary_source AND kind = 'call' OR audience IS NULL"
ITEM_DECISION = (("REJECT", REJECTING), ("HOLD", HOLDING))


@query(f"WITH {_CASES_SQL} SELECT i, {case_sql(ITEM_DECISION, 'PASS')} AS decision, {codes_sql(ITEM_CODES)} AS codes FROM c")
def item_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass, hold or reject by category, where eligibility has three states, with every code that counted."""
    return cases(spark, sf_dir).select("i", rule_table(ITEM_DECISION, "PASS").alias("decision"), code_table(ITEM_CODES).alias("codes"))


@query(f"""WITH {LOG_SQL}, w AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS attempts, max(day) AS last, min(day) AS first, bool_or(event_type = 'purchase') AS owner, max_by(event_type, (ts, event_id)) = 'error' AS failed, max_by(k, (ts, event_id)) % 3 AS reason FROM log WHERE day > DATE '{EVENTS_AS_OF}' - 21 GROUP BY user_id),
 d AS (SELECT *, CASE reason WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 6 END AS cap FROM w) SELECT user_id, owner, failed, attempts FROM d WHERE NOT failed OR attempts < cap AND last < DATE '{EVENTS_AS_OF}' ORDER BY owner DESC, failed, first DESC, user_id LIMIT 60""")
def enrichment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next sixty pieces of enrichment: what an owner asked for first, what failed last, new before old; failures wait and are capped by reason."""
    rows = log(spark, sf_dir).where(F.col("day") > F.date_sub(F.lit(EVENTS_AS_OF).cast("date"), 21))
    last = F.max(F.struct("ts", "event_id", "event_type", "k")).alias("l")
    w = rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("attempts"), F.max("day").alias("last"), F.min("day").alias("first"), F.bool_or(F.col("event_type") == "purchase").alias("owner"), last)
    cap = F.element_at(F.array(F.lit(20), F.lit(10), F.lit(6)), (F.col("l.k") % 3 + 1).cast("int"))
    w = w.withColumn("failed", F.col("l.event_type") == "error").where(~F.col("failed") | (F.col("attempts") < cap) & (F.col("last") < F.lit(EVENTS_AS_OF).cast("date")))
    return w.orderBy(F.desc("owner"), "failed", F.desc("first"), "user_id").limit(60).select("user_id", "owner", "failed", "attempts")


_LEVELS = (("BLOCK", "failure_rate > 0.5 OR peak_use > 1.5"), ("CAUTION", "failure_rate > 0.15 OR mean_use > 0.9 OR peak_use > 1.2"))


@query(f"""WITH {LOG_SQL}, c AS (SELECT day, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, row_number() OVER (ORDER BY day DESC) AS r FROM log GROUP BY day), t AS (SELECT round(avg(runs / 400.0), 4) AS mean_use, round(max(runs) / 400.0, 4) AS peak_use, round(CAST(sum(failed) AS DOUBLE) / sum(runs), 4) AS failure_rate, round(CAST(sum(accepted) AS DOUBLE) / sum(runs), 4) AS yield_rate, count(*) AS cycles FROM c WHERE r <= 14)
SELECT CAST(mean_use AS DOUBLE) AS mean_use, CAST(peak_use AS DOUBLE) AS peak_use, failure_rate, yield_rate, cycles, {case_sql(_LEVELS, 'SAFE')} AS level FROM t""")
def capacity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fourteen cycles: how much of the capacity they used on average and at most, what failed, what they yielded, and the level that follows."""
    c = log(spark, sf_dir).groupBy("day").agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("accepted")).orderBy(F.desc("day")).limit(14)
    share = lambda c_: F.round(F.sum(c_) / F.sum("runs"), 4)
    t = c.agg(F.round(F.avg(F.col("runs") / 400), 4).alias("mean_use"), F.round(F.max("runs") / 400, 4).alias("peak_use"), share("failed").alias("failure_rate"), share("accepted").alias("yield_rate"), F.count("*").alias("cycles"))
    return t.select("*", rule_table(_LEVELS, "SAFE").alias("level"))


@query(f"""WITH {LOG_SQL}, h AS (SELECT k % 12 AS heading, event_type, day, count(*) AS n FROM log GROUP BY ALL), r AS (SELECT heading, event_type, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL), m AS (SELECT heading, CAST(to_json(map_from_entries(list((event_type, n) ORDER BY event_type))) AS VARCHAR) AS revalidation FROM r GROUP BY 1)
SELECT heading, CAST(coalesce(sum(n) FILTER (WHERE day = DATE '{EVENTS_AS_OF}' - 1), 0) AS BIGINT) AS last_day, CAST(coalesce(sum(n) FILTER (WHERE day > DATE '{EVENTS_AS_OF}' - 7), 0) AS BIGINT) AS last_week, CAST(coalesce(sum(n) FILTER (WHERE day > DATE '{EVENTS_AS_OF}' - 7 AND event_type = 'error'), 0) AS BIGINT) AS rejects, any_value(revalidation) AS revalidation FROM h JOIN m USING (heading) GROUP BY heading""")
def heading_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each heading's items of a day and a week, its rejects, and how often each outcome came, as one map."""
    today = F.lit(EVENTS_AS_OF).cast("date")
    h = log(spark, sf_dir).groupBy((F.col("k") % 12).alias("heading"), "event_type", "day").agg(F.count("*").alias("n"))
    when = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    week = F.col("day") > F.date_sub(today, 7)
    r = h.groupBy("heading", "event_type").agg(F.sum("n").alias("total"), when(F.col("day") == F.date_sub(today, 1)).alias("d"), when(week).alias("w"))
    outcomes = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "total")))))
    return r.groupBy("heading").agg(F.sum("d").alias("last_day"), F.sum("w").alias("last_week"), F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.col("w"))), F.lit(0)).alias("rejects"), outcomes.alias("revalidation"))


@query("""SELECT concat('NCT', p_partkey) AS study_id, 'condition' AS family, p_type AS label, 'topic' AS role, DATE '2024-03-01' AS observed FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT concat('NCT', p_partkey), 'intervention', p_name, CASE WHEN p_partkey % 2 = 0 THEN 'control' ELSE 'topic' END, DATE '2024-03-01' FROM part WHERE p_partkey % 9 <> 0""")
def trial_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies written from the parts, as conditions and interventions; an intervention of control arms alone is a control, repeated labels count once, studies without an id go."""
    j = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    k, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    study = F.when(k % 9 != 0, F.concat(F.lit("NCT"), k)).otherwise("")
    arm = F.when(k % 2 == 0, "PLACEBO_COMPARATOR").otherwise("EXPERIMENTAL")
    json = j('{"studies":[{"protocolSection":{"identificationModule":{"nctId":"', study, '"},"statusModule":{"studyFirstPostDateStruct":{"date":"2024-03-01"}},"conditionsModule":{"conditions":["', kind, '"," ', kind, ' "]},"armsInterventionsModule":{"interventions":[{"type":"DRUG","name":"', name, '"}],"armGroups":[{"type":"', arm, '","interventionNames":["Drug: ', name, '"]}]}}}]}')
    return records.trial_signals(load(spark, sf_dir, "part").select(json.alias("json"))).select("study_id", "family", "label", "role", "observed")


@query("SELECT concat('https://x.org/', s_suppkey) AS url, CAST(0 AS BIGINT) AS page, concat('Entry ', s_suppkey) AS title FROM supplier WHERE s_suppkey % 3 <> 0")
def unseen_feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of paged feeds that were not seen before; an entry that moved on to the second page counts once."""
    i = F.col("s_suppkey")
    entry = F.concat(F.lit("<item><title>Entry "), i, F.lit("</title><link>https://x.org/"), i, F.lit("</link></item>"))
    rows = load(spark, sf_dir, "supplier")
    feeds = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("page"), entry.alias("xml"))
    return markup.unseen_entries(feeds, rows.where(i % 3 == 0).select(F.concat(F.lit("https://x.org/"), i).alias("url")))
