"""From point signals to windowed aggregates, candidates and their eligibility."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import all_matches, first_match
from ..operators.latest import spread
from ..operators.windows import WindowStore
from ..sources.shared import shared_dir, written
from ..sources.tables import EVENTS_AS_OF, ITEMS_SQL, LOG_SQL, items, log
from .registry import query

WINDOWS = (7, 30, 90)


def as_of() -> Column:
    """The reference day."""
    return F.lit(EVENTS_AS_OF).cast("date")
_WINDOWS_SQL = f"""w AS (SELECT l.*, k % 5 AS sub, d.days, CASE WHEN day > DATE '{EVENTS_AS_OF}' - d.days THEN 0 ELSE 1 END AS prior FROM log l CROSS JOIN (VALUES (7), (30), (90)) d(days) WHERE day > DATE '{EVENTS_AS_OF}' - 2 * d.days AND day <= DATE '{EVENTS_AS_OF}')"""


def windowed(observations: DataFrame, day: str = "day", today: Column | None = None) -> DataFrame:
    """Each observation once for every window (days) that it or the equal window before it holds; prior is 1 for the latter."""
    opened = observations.withColumn("days", F.explode(F.array(*(F.lit(d) for d in WINDOWS))))
    age = F.datediff(as_of() if today is None else today, day)
    return opened.where((age >= 0) & (age < 2 * F.col("days"))).withColumn("prior", F.when(age < F.col("days"), 0).otherwise(1))


def aggregated(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Volume, independence, momentum and persistence of each selector and window.

    Equal (selector, day, unit, actor) rows are counted first, so that windows and distinct counts open few of them.
    """
    now = lambda c: F.when(F.col("prior") == 0, c)
    sums = lambda prior: F.coalesce(F.sum(F.when(F.col("prior") == prior, F.col("rows"))), F.lit(0))
    n, before = sums(0), sums(1)
    few = observations.groupBy(*keys, "day", "k", "user_id").agg(F.count("*").alias("rows"))
    return windowed(few).groupBy(*keys, "days").agg(
        n.alias("n"), F.countDistinct(now(F.col("k"))).alias("units"), F.countDistinct(now(F.col("user_id"))).alias("actors"),
        (n - before).alias("momentum"), F.min(now(F.col("day"))).alias("first_day"), F.max(now(F.col("day"))).alias("last_day"), F.countDistinct(now(F.col("day"))).alias("active_days"),
    ).where("n > 0")


@query(f"""WITH {LOG_SQL}, {_WINDOWS_SQL} SELECT user_id % 40 AS concept, event_type AS family, sub, CAST(days AS INTEGER) AS days, count(*) FILTER (WHERE prior = 0) AS n, count(DISTINCT k) FILTER (WHERE prior = 0) AS units, count(DISTINCT user_id) FILTER (WHERE prior = 0) AS actors,
 count(*) FILTER (WHERE prior = 0) - count(*) FILTER (WHERE prior = 1) AS momentum, min(day) FILTER (WHERE prior = 0) AS first_day, max(day) FILTER (WHERE prior = 0) AS last_day, count(DISTINCT day) FILTER (WHERE prior = 0) AS active_days FROM w GROUP BY ALL HAVING count(*) FILTER (WHERE prior = 0) > 0""")
def signal_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).select((F.col("user_id") % 40).alias("concept"), F.col("event_type").alias("family"), (F.col("k") % 5).alias("sub"), "day", "k", "user_id")
    return aggregated(rows, ["concept", "family", "sub"])


@query(f"""WITH {LOG_SQL}, t AS (SELECT user_id % 40 AS concept, k % 3 AS sub, day, count(DISTINCT value) AS kinds, min(value) AS v, count(*) AS n FROM log GROUP BY ALL)
SELECT concept, sub, day, n, CASE WHEN kinds = 1 THEN 'measured' ELSE 'unknown' END AS state, CASE WHEN kinds = 1 THEN v END AS value FROM t""")
def unambiguous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value only where all observations agree; missing is never zero."""
    one = F.countDistinct("value") == 1
    return log(spark, sf_dir).groupBy((F.col("user_id") % 40).alias("concept"), (F.col("k") % 3).alias("sub"), "day").agg(F.count("*").alias("n"), F.when(one, "measured").otherwise("unknown").alias("state"), F.when(one, F.min("value")).alias("value"))


@query(f"""WITH {LOG_SQL}, f AS (SELECT user_id % 40 AS concept, event_type AS family, count(DISTINCT k) AS origins, count(DISTINCT day) AS days FROM log GROUP BY ALL),
 c AS (SELECT concept, CAST(sum(origins) AS BIGINT) AS origins, count(*) AS families, max(days) AS persistence, string_agg(family, ',' ORDER BY family) AS family_list FROM f GROUP BY concept)
SELECT *, CASE WHEN families >= 4 AND persistence >= 20 THEN 'strong' WHEN families >= 4 THEN 'emerging' WHEN persistence >= 20 THEN 'frontier' ELSE 'weak' END AS class FROM c""")
def candidate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per concept: origins over families, families, persistence, and the class that follows."""
    f = log(spark, sf_dir).groupBy((F.col("user_id") % 40).alias("concept"), F.col("event_type").alias("family")).agg(F.countDistinct("k").alias("origins"), F.countDistinct("day").alias("days"))
    c = f.groupBy("concept").agg(F.sum("origins").alias("origins"), F.count("*").alias("families"), F.max("days").alias("persistence"), F.array_join(F.array_sort(F.collect_list("family")), ",").alias("family_list"))
    wide, long = F.col("families") >= 4, F.col("persistence") >= 20
    return c.select("*", first_match([("strong", wide & long), ("emerging", wide), ("frontier", long)], "weak").alias("class"))


@query(f"""WITH {ITEMS_SQL} SELECT source_id, count(*) FILTER (WHERE quality = 1) AS eligible, count(*) FILTER (WHERE quality = 0) AS refused, count(*) FILTER (WHERE quality IS NULL) AS unknown,
 CASE WHEN count(*) FILTER (WHERE quality = 0) >= 3 THEN 'blocked' WHEN count(*) FILTER (WHERE quality = 1) >= 5 THEN 'eligible' WHEN count(*) FILTER (WHERE quality IS NULL) > 0 THEN 'review' ELSE 'not_eligible' END AS state FROM items GROUP BY source_id""")
def concept_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, no, open_ = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0), F.count_if(F.col("quality").isNull())
    state = first_match([("blocked", no >= 3), ("eligible", yes >= 5), ("review", open_ > 0)], "not_eligible")
    return items(spark, sf_dir).groupBy("source_id").agg(yes.alias("eligible"), no.alias("refused"), open_.alias("unknown"), state.alias("state"))


@query(f"""WITH {LOG_SQL} SELECT user_id, event_type AS family, max(day) AS last_day, max(day) + 7 < DATE '{EVENTS_AS_OF}' AS stale_7, max(day) + 30 < DATE '{EVENTS_AS_OF}' AS stale_30 FROM log GROUP BY ALL""")
def stale_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors whose newest observation is older than the window's own length."""
    last = F.max("day")
    return log(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("family")).agg(last.alias("last_day"), (F.date_add(last, 7) < as_of()).alias("stale_7"), (F.date_add(last, 30) < as_of()).alias("stale_30"))


@query(f"""WITH {LOG_SQL} SELECT user_id % 40 AS concept, count(*) AS mentions, count(DISTINCT k) AS units, count(DISTINCT user_id) AS actors, count(DISTINCT event_type) AS families, concat_ws(',', CASE WHEN count(DISTINCT event_type) > 3 THEN 'convergence' END, CASE WHEN count(DISTINCT k) > 60 THEN 'breadth' END, CASE WHEN count(*) > 250 THEN 'volume' END) AS reasons FROM log GROUP BY 1""")
def independence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions against independent units, and the codes of what speaks for a concept."""
    n, units, families = F.count("*"), F.countDistinct("k"), F.countDistinct("event_type")
    g = log(spark, sf_dir).groupBy((F.col("user_id") % 40).alias("concept")).agg(n.alias("mentions"), units.alias("units"), F.countDistinct("user_id").alias("actors"), families.alias("families"))
    codes = all_matches([("convergence", F.col("families") > 3), ("breadth", F.col("units") > 60), ("volume", F.col("mentions") > 250)])
    return g.select("*", F.array_join(codes, ",").alias("reasons"))


@query(f"""WITH {LOG_SQL}, c AS (SELECT user_id, event_type, count(*) AS n FROM log GROUP BY ALL) SELECT user_id, CAST(sum(n) AS BIGINT) AS total, to_json(map_from_entries(list((event_type, n) ORDER BY event_type))) AS histogram FROM c GROUP BY user_id""")
def commercial_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind in one map a key."""
    c = log(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.sum("n").alias("total"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("histogram"))


@query(f"""WITH {LOG_SQL}, s AS (SELECT user_id, k, event_type, day, event_id, row_number() OVER (PARTITION BY user_id, k ORDER BY day DESC, event_id DESC) AS u FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY day DESC, event_id DESC) AS f FROM s WHERE u = 1)
SELECT user_id, event_type AS family, event_id FROM r WHERE f <= 2""")
def family_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two observations of each family, at most one for each origin unit."""
    from ..operators.latest import latest_by, top_per_group

    order = [F.desc("day"), F.desc("event_id")]
    units = latest_by(log(spark, sf_dir), ["user_id", "k"], order)
    return top_per_group(units, ["user_id", "event_type"], order, 2).select("user_id", F.col("event_type").alias("family"), "event_id")


@query(f"""WITH {LOG_SQL}, l AS (SELECT user_id % 40 AS concept, list([{{'family': event_type, 'unit': k, 'event_id': event_id}}] ORDER BY day DESC, event_id) AS rows FROM log GROUP BY 1),
t AS (SELECT concept, unnest(list_reduce(rows, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.family = x[1].family)) < 3 AND len(list_filter(a, lambda y: y.unit = x[1].unit)) = 0 THEN list_concat(a, x) ELSE a END, list_filter(rows[1], lambda y: false))) AS r FROM l)
SELECT concept, r.family AS family, r.unit AS unit, r.event_id AS event_id FROM t""")
def spread_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three representatives of each family, newest first, none of them from an origin unit that another one has."""
    rows = log(spark, sf_dir).select((F.col("user_id") % 40).alias("concept"), F.col("event_type").alias("family"), F.col("k").alias("unit"), "day", "event_id")
    return spread(rows, "concept", "family", "unit", F.struct((-F.unix_date("day")).alias("age"), "event_id"), ("view", "signup", "click", "error", "purchase"), 3, ["event_id"])


@query(f"""WITH {LOG_SQL} SELECT CAST(7 AS INTEGER) AS days, day_start AS window_start, event_type AS family, count(*) AS n, count(DISTINCT user_id) AS actors FROM (SELECT *, DATE '2024-01-01' + CAST(7 * floor(date_diff('day', DATE '2024-01-01', day) / 7.0) AS INTEGER) AS day_start FROM log) GROUP BY ALL""")
def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly aggregate as a stream reads it: all files at once, then to the end."""
    from ..streaming.signals import weekly_signals

    return weekly_signals(spark, f"{sf_dir}/events.parquet")


_SELECTOR_SQL = "user_id % 40 AS concept, event_type AS family, k % 5 AS sub, CASE user_id % 3 WHEN 0 THEN 'TR' WHEN 1 THEN 'EU' ELSE '' END AS geo, CASE WHEN k % 2 = 0 THEN 'MEASURED' ELSE 'REPORTED' END AS provenance"


@query(f"""WITH {LOG_SQL}, s AS (SELECT {_SELECTOR_SQL}, day, k AS units, user_id AS actors FROM log), w AS (SELECT s.*, d.days, day > DATE '{EVENTS_AS_OF}' - d.days AS now FROM s CROSS JOIN (VALUES (7), (30), (90)) d(days) WHERE day > DATE '{EVENTS_AS_OF}' - 2 * d.days AND day <= DATE '{EVENTS_AS_OF}')
SELECT concept, family, sub, geo, provenance, CAST(days AS INTEGER) AS days, count(*) FILTER (WHERE now) AS n, count(DISTINCT units) FILTER (WHERE now) AS units, count(DISTINCT actors) FILTER (WHERE now) AS actors, count(*) FILTER (WHERE now) - count(*) FILTER (WHERE NOT now) AS momentum,
 min(day) FILTER (WHERE now) AS first_day, max(day) FILTER (WHERE now) AS last_day, count(DISTINCT day) FILTER (WHERE now) AS active_days FROM w GROUP BY ALL HAVING count(*) FILTER (WHERE now) > 0""")
def incremental_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by selector with geography and provenance, kept up to date over three batches of the log whose reference day moves on."""
    rows = log(spark, sf_dir).selectExpr(*_SELECTOR_SQL.split(", "), "day", "k AS units", "user_id AS actors", "event_id")
    folder = f"{shared_dir(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"
    store = WindowStore(spark, folder, ("concept", "family", "sub", "geo", "provenance"), ("units", "actors"))
    days = [(datetime.date.fromisoformat(EVENTS_AS_OF) - datetime.timedelta(days=d)).isoformat() for d in (12, 3, 0)]
    # what arrives late is in the last batch
    which = F.when((F.col("day") <= days[0]) & (F.col("event_id") % 9 > 0), 0).when((F.col("day") <= days[1]) & (F.col("event_id") % 9 > 0), 1).otherwise(2)
    for i, day in enumerate(days):
        store.apply(i, rows.where(which == i), day, days[i - 1] if i else None)
    out = written(store.current())
    store.clear()
    return out
