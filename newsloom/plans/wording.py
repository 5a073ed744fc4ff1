"""Names, titles, printed days and scores over the tables, and the decoders of sources over records written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wording as W
from ..functions.dates import deadline
from ..sources import cubes, listings, records
from ..sources.tables import LOG_SQL, load, log
from .registry import query

_NAME = "concat(CASE i % 4 WHEN 0 THEN 'Prof. Dr. ' WHEN 1 THEN 'Dr. ' ELSE '' END, 'Ayşe  Şahin-', i % 50, CASE WHEN i % 3 = 0 THEN ' (TR)' ELSE '' END)"


@query(f"""WITH n AS (SELECT user_id AS i, {_NAME.replace('i %', 'user_id %')} AS name FROM (SELECT DISTINCT user_id FROM events))
SELECT i, concat('ayse sahin ', i % 50, CASE WHEN i % 3 = 0 THEN ' tr' ELSE '' END) AS actor, concat(CASE i % 4 WHEN 0 THEN 'prof dr ' WHEN 1 THEN 'dr ' ELSE '' END, 'ayse sahin ', i % 50) AS alias, lower(regexp_replace(name, '\\s+', ' ', 'g')) AS label, concat(CASE i % 4 WHEN 0 THEN 'prof-dr-' WHEN 1 THEN 'dr-' ELSE '' END, 'ayse-sahin-', i % 50, CASE WHEN i % 3 = 0 THEN '-tr' ELSE '' END) AS slug FROM n""")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name by each of the three normalisers, and as a slug."""
    n = load(spark, sf_dir, "events").select(F.col("user_id").alias("i")).distinct().selectExpr("i", f"{_NAME} AS name")
    name = F.col("name")
    return n.select("i", W.actor_name(name).alias("actor"), W.alias_name(name).alias("alias"), W.label_name(name).alias("label"), W.slug(name).alias("slug"))


_CHANNEL = "CASE i % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'youtube' WHEN 2 THEN 'web' ELSE 'instagram' END"
_PLACE = "CASE i % 4 WHEN 0 THEN concat('@User', i) WHEN 1 THEN concat('https://www.youtube.com/@Chan', i) WHEN 2 THEN concat('https://www.Site', i, '.org/') ELSE concat('https://instagram.com/User', i, '/?hl=en') END"


@query("SELECT p_partkey AS i, CASE p_partkey % 4 WHEN 1 THEN concat('chan', p_partkey) WHEN 2 THEN concat('site', p_partkey, '.org') ELSE concat('user', p_partkey) END AS locator FROM part")
def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts and sites, however they are written, in one spelling for each channel."""
    rows = load(spark, sf_dir, "part").selectExpr("p_partkey AS i").selectExpr("i", f"{_CHANNEL} AS channel", f"{_PLACE} AS place")
    return rows.select("i", W.locator(F.col("channel"), F.col("place")).alias("locator"))


@query("SELECT o_orderkey, concat('Call for papers no ', o_orderkey) AS title, CAST(o_orderdate AS DATE) AS day, 1 AS days, strftime(o_orderdate, '%Y') = '2199' OR o_orderkey % 17 = 0 AS impossible FROM orders")
def dated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles freed from the day that a listing prints before or behind them, that day, and years that can't be."""
    day = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_orderkey")
    printed = F.when(k % 3 == 0, F.date_format(day, "dd.MM.yyyy")).when(k % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "d MMM yyyy"))
    title = F.concat(F.lit("Call for papers no "), k)
    # years before 2000 are printed four hundred years on, so that they begin with 20, and read back
    shifted = F.regexp_replace(printed, "(19)([0-9]{2})", "20$2")
    listed = F.when(k % 2 == 0, F.concat(shifted, F.lit(" - "), title)).otherwise(F.concat(title, F.lit(" ("), shifted, F.lit(")")))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", listed.alias("listed"), F.year("o_orderdate").alias("y"))
    found = W.printed_days(F.col("listed"))
    back = F.add_months(F.get(found, F.lit(0)), F.when(F.col("y") < 2000, -1200).otherwise(0))
    note = F.when(k % 17 == 0, "until 2150").otherwise("until 2030")
    return rows.select("o_orderkey", W.without_days(F.col("listed")).alias("title"), back.alias("day"), F.size(found).alias("days"), W.impossible_year(note).alias("impossible"))


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events WHERE event_id % 4 <> 3")
def offset_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with an offset, in any of three notations, as the instants they name; those without one are refused."""
    i, ts = F.col("event_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    at = lambda hours: F.date_format(ts + F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm:ss")
    printed = F.when(i % 4 == 0, F.concat(at(0), F.lit("Z"))).when(i % 4 == 1, F.concat(at(2), F.lit("+02:00"))).when(i % 4 == 2, F.concat(at(-5), F.lit("-0500"))).otherwise(at(0))
    rows = load(spark, sf_dir, "events").select("event_id", W.utc(printed).alias("at"))
    return rows.where("at is not null").select("event_id", F.col("at").cast("timestamp_ntz").alias("at"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS due FROM orders WHERE year(o_orderdate) >= 2000")
def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest day that a text names as its deadline."""
    day = F.col("o_orderdate").cast("timestamp")
    text = F.concat(F.lit("Published 01.01.1999. Applications close, deadline: "), F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "d MMM yyyy")), F.lit(". Winners follow."))
    rows = load(spark, sf_dir, "orders").where(F.year("o_orderdate") >= 2000).select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", deadline(F.col("text"), F.lit("1999-01-01").cast("date")).alias("due"))


@query("SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z]+://[^/?#]*/(?:(?:[a-z]{2}|[0-9]+)/)*([^/?#]+)', 1), '') AS topic FROM pages WHERE NOT regexp_matches(lower(url), '/([a-z]{2}|[0-9]+)/?([?#].*)?$')")
def url_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages").where(~F.lower("url").rlike("/([a-z]{2}|[0-9]+)/?([?#].*)?$"))
    return rows.select("page_id", W.url_topic(F.col("url")).alias("topic"))


@query("SELECT p_partkey, round(CAST(least(p_size, 40) AS DOUBLE) + CASE WHEN length(p_name) > 8 THEN 15 ELSE 5 END + 2 * (p_partkey % 10), 4) AS score FROM part")
def editorial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density, description, and novelty twice."""
    score = F.least(F.col("p_size"), F.lit(40)) * 1.0 + F.when(F.length("p_name") > 8, 15).otherwise(5) + 2 * (F.col("p_partkey") % 10)
    return load(spark, sf_dir, "part").select("p_partkey", F.round(score, 4).alias("score"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings written from suppliers: cards, dated rows, plain links or a title alone."""
    i = F.col("s_suppkey").cast("string")
    card = F.concat(F.lit("<article class='card'><h3>Card number "), i, F.lit("</h3><p>2024-03-04</p><a href='/c/"), i, F.lit("'>read more</a></article><article><p>no heading</p></article>"))
    row = F.concat(F.lit("<table><tr><td>05.06.2024</td><td><a href='/r/"), i, F.lit("'>Row number "), i, F.lit("</a></td></tr><tr><td>no day</td></tr></table>"))
    link = F.concat(F.lit("<h2>Heading of link "), i, F.lit("</h2><a href='/l/"), i, F.lit("'>Read more</a><a href='/'>Home</a>"))
    body = F.when(F.col("s_suppkey") % 4 == 0, card).when(F.col("s_suppkey") % 4 == 1, row).when(F.col("s_suppkey") % 4 == 2, link).otherwise("")
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("https://x.org/"), i).alias("url"), F.concat(F.lit("<html><title>Title "), i, F.lit("</title>"), body, F.lit("</html>")).alias("html"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'cards' WHEN 1 THEN 'dated_rows' WHEN 2 THEN 'links' ELSE 'title' END AS strategy, CASE s_suppkey % 4 WHEN 0 THEN concat('/c/', s_suppkey) WHEN 1 THEN concat('/r/', s_suppkey) WHEN 2 THEN concat('/l/', s_suppkey) END AS href,
 CASE s_suppkey % 4 WHEN 0 THEN concat('Card number ', s_suppkey) WHEN 1 THEN concat('Row number ', s_suppkey) WHEN 2 THEN concat('Heading of link ', s_suppkey) ELSE concat('Title ', s_suppkey) END AS title FROM supplier""")
def source_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing read by the first strategy that finds anything in it."""
    return listings.cascade(_pages(spark, sf_dir), "s_suppkey").select("s_suppkey", "strategy", "href", "title")


@query("SELECT s_nationkey AS source, s_suppkey AS key FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place, count(*) OVER (PARTITION BY s_nationkey) AS total FROM supplier) WHERE ((place - (3 * 7919) % total) % total + total) % total < 2")
def deep_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the third deep run takes of each source's pool."""
    pool = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_suppkey").alias("key"))
    return listings.prime_jump(pool, "key", run=3, size=2)


@query("""SELECT CAST(c_custkey % 3 AS INTEGER) AS kind, c_custkey AS i, CAST(c_custkey AS VARCHAR) AS external_id, concat('Paper ', c_custkey) AS title, CASE c_custkey % 3 WHEN 0 THEN 'A Journal' WHEN 1 THEN 'x.org' ELSE 'alert' END AS container, DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) AS published FROM customer""")
def api_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three services, written from the customers, read by their mappers into one form."""
    i = F.col("c_custkey").cast("string")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int"))
    kind = (F.col("c_custkey") % 3).cast("int")
    rows = load(spark, sf_dir, "customer").withColumn("kind", kind)
    json = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("json")
    one = rows.where("kind = 0").select(json('{"result":{"uids":["', i, '"],"', i, '":{"title":"Paper ', i, '","fulljournalname":"A Journal","sortpubdate":"', F.date_format(day, "yyyy/MM/dd"), ' 00:00"}}}'))
    two = rows.where("kind = 1").select(json('{"articles":[{"url":"', i, '","title":"Paper  ', i, '","domain":"x.org","seendate":"', F.date_format(day, "yyyyMMdd"), 'T000000Z"}]}'))
    three = rows.where("kind = 2").select(json('{"value":[{"UrlName":"', i, '","Title":"Paper ', i, '","PublicationDateAndTime":"', F.date_format(day, "yyyy-MM-dd"), 'T01:00:00Z","NewsType":"alert"}]}'))
    parts = [(0, records.pubmed(one)), (1, records.gdelt(two)), (2, records.who_news(three))]
    out = None
    for k, part in parts:
        part = part.select(F.lit(k).alias("kind"), F.col("external_id").cast("long").alias("i"), "external_id", "title", "container", "published")
        out = part if out is None else out.unionAll(part)
    return out


@query(f"WITH {LOG_SQL} SELECT concat('k', user_id % 300) AS key, concat('title ', user_id % 300) AS title, NULL AS reason FROM log WHERE event_type = 'view' AND user_id % 7 > 1 GROUP BY ALL UNION ALL SELECT NULL, NULL, CASE WHEN user_id % 7 = 0 THEN 'no_key' ELSE 'no_title' END FROM log WHERE event_type = 'view' AND user_id % 7 <= 1")
def push_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were pushed in: one of each key is taken, what can't be used is refused with its reason."""
    u = F.col("user_id")
    named = F.concat(F.lit('{"key":"k'), u % 300, F.lit('","title":"title '), u % 300, F.lit('"}'))
    raw = F.when(u % 7 == 0, F.lit('{"title":"x y z"}')).when(u % 7 == 1, F.concat(F.lit('{"key":"k'), u, F.lit('"}'))).otherwise(named)
    good, bad = records.pushed(log(spark, sf_dir).where("event_type = 'view'").select(raw.alias("json")))
    return good.select("key", "title", F.lit(None).cast("string").alias("reason")).unionAll(bad.select(F.lit(None).cast("string"), F.lit(None).cast("string"), "reason"))


@query("SELECT n_name AS coordinate, CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey AS DOUBLE) * 1.5 END AS value, CASE WHEN n_nationkey % 4 <> 0 THEN 'measured' ELSE 'missing' END AS state FROM nation")
def cube_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One free dimension of a published cube of three, checked before it is read; the nations are a table of fixed size."""
    names = load(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    kept = F.filter("n", lambda x: x["n_nationkey"] % 4 != 0)
    position = lambda x: (F.array_position(F.transform("n", lambda y: y["n_nationkey"]), x["n_nationkey"]) - 1) * 2 + 1
    value = F.map_from_entries(F.transform(kept, lambda x: F.struct(position(x).cast("long"), x["n_nationkey"].cast("double") * 1.5)))
    cube = names.select(F.array(F.lit(1), F.size("n"), F.lit(2)).alias("size"), F.array(F.array(F.lit("A")), F.transform("n", lambda x: x["n_name"]), F.array(F.lit("F"), F.lit("M"))).alias("categories"), value.alias("value"))
    return cubes.slice_of(cubes.checked(cube), {0: "A", 2: "M"})


@query("SELECT o_orderkey, n_name AS country, o_orderpriority AS priority, o_totalprice AS value FROM orders JOIN nation ON n_nationkey = o_custkey % 25")
def keyed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose key names positions in two category lists: ``i:j`` decoded for every order."""
    lists = load(spark, sf_dir, "nation").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("countries"))
    priorities = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    rows = load(spark, sf_dir, "orders").join(F.broadcast(lists))  # one row: the lists of a cube
    place = F.array_position(F.array(*(F.lit(p) for p in priorities)), F.col("o_orderpriority")) - 1
    rows = rows.select("o_orderkey", F.concat_ws(":", (F.col("o_custkey") % 25).cast("string"), place.cast("string")).alias("key"), F.array("countries", F.array(*(F.lit(p) for p in priorities))).alias("categories"), F.struct("o_orderkey", "o_totalprice").alias("value"))
    d = cubes.decode_keys(rows)
    return d.select("value.o_orderkey", F.col("coordinates")[0].alias("country"), F.col("coordinates")[1].alias("priority"), F.col("value.o_totalprice").alias("value"))
