"""Decoders, connectors and sinks applied to answers, listings and sitemaps that are written from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udtf
from ..functions import wording as W
from ..functions.rules import keyword_gate
from ..sources import listings, markup, records, sinks
from ..sources.tables import EVENTS_AS_OF, load
from ..streaming.signals import touched
from .registry import query


def _joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS k FROM supplier), many AS (SELECT s_suppkey, CAST(unnest(range(30)) AS INTEGER) AS j FROM s WHERE k = 3)
SELECT s_suppkey, 1 AS place, concat('/a/', s_suppkey) AS href, concat('Heading number ', s_suppkey) AS title FROM s WHERE k = 0
UNION ALL SELECT s_suppkey, 1, concat('https://www.x.org/b/', s_suppkey), concat('A longer title ', s_suppkey) FROM s WHERE k = 1
UNION ALL SELECT s_suppkey, 1, concat('/2024-05/', s_suppkey), 'The dated one of two' FROM s WHERE k = 2 UNION ALL SELECT s_suppkey, 2, concat('/u/', s_suppkey), 'The one without a day' FROM s WHERE k = 2
UNION ALL SELECT s_suppkey, j + 1, concat('/m/', j), concat('Many links, number ', j) FROM many WHERE j < 25""")
def listing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item links of listings: "read more" under a heading, navigation and other hosts left out, dated first, 25 of a page."""
    i, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    link = lambda href, label: _joined("<a class='l' href='", href, "'>", label, "</a>")
    more = F.concat(_joined("<h3>Heading <i>number</i> ", i, "</h3>"), link(_joined("/a/", i), F.lit("Read more »")), link(F.lit("/a/short"), F.lit("Short")))
    own = F.concat(link(F.lit("/contact"), F.lit("Contact")), link(F.lit("https://other.org/p"), F.lit("A title on another host")), link(_joined("https://www.x.org/b/", i), _joined("A longer title ", i)), link(_joined("https://www.x.org/b/", i), F.lit("The same target again")))
    dated = F.concat(link(_joined("/u/", i), F.lit("The one without a day")), link(_joined("/2024-05/", i), F.lit("The dated one of two")))
    many = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda j: link(_joined("/m/", j.cast("string")), _joined("Many links, number ", j.cast("string")))), "")
    html = F.when(k == 0, more).when(k == 1, own).when(k == 2, dated).otherwise(many)
    pages = load(spark, sf_dir, "supplier").select("s_suppkey", F.lit("https://x.org/list").alias("url"), html.alias("html"))
    return listings.listing_links(pages, "s_suppkey")


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps of at most 64 orders, entries in key order, behind an entry for the site's root."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    entry = _joined("<url><loc>https://x.org/o/", k.cast("string"), "</loc><lastmod>", day, "T05:00:00Z</lastmod>", F.when(k % 2 == 0, _joined("<news:title>Order &amp; ", k.cast("string"), "</news:title>")).otherwise(""), "</url>")
    rows = load(spark, sf_dir, "orders").select(F.floor(k / 64).alias("map"), F.struct(k.alias("k"), entry.alias("entry")).alias("e"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), "\n")
    return rows.groupBy("map").agg(_joined("<urlset><url><loc>https://x.org/</loc><lastmod>1998-03-01</lastmod></url>", body, "</urlset>").alias("xml"))


@query("SELECT CAST(floor(o_orderkey / 64) AS BIGINT) AS map, concat('https://x.org/o/', o_orderkey) AS url, CAST(o_orderdate AS DATE) AS last_modified FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-06-01' - 400 AND DATE '1998-06-02'")
def sitemap_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of sitemaps in a window of days, not more than one day ahead, without site roots."""
    return listings.recent_entries(markup.sitemap_urls(_maps(spark, sf_dir)), "1998-06-01", 400).select("map", "url", "last_modified")


@query("""WITH o AS (SELECT CAST(floor(o_orderkey / 64) AS BIGINT) AS map, o_orderkey, row_number() OVER (PARTITION BY floor(o_orderkey / 64) ORDER BY o_orderkey) AS n FROM orders)
SELECT map, concat('https://x.org/o/', o_orderkey) AS url, concat('Order & ', o_orderkey) AS news_title FROM o WHERE n <= 39 AND o_orderkey % 2 = 0""")
def news_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titled entries among the first forty of each news sitemap."""
    return markup.sitemap_urls(_maps(spark, sf_dir), most=40).where("news_title is not null").select("map", "url", "news_title")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place, count(*) OVER (PARTITION BY s_nationkey) AS total FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT s_nationkey AS source, s_suppkey AS key FROM p WHERE ((place - 1) % total + total) % total < 2""")
def rotation_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next two of each source's pool that have not been seen, from the second place on, around the end."""
    pool = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_suppkey").alias("key"))
    return listings.rotation_window(pool, "key", pool.where("key % 3 = 0"), start=1, size=2)


@query("""WITH c AS (SELECT c_custkey AS i, c_custkey % 3 AS k, DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) AS day FROM customer)
SELECT CASE k WHEN 0 THEN 'europe_pmc' WHEN 1 THEN 'crossref' ELSE 'openalex' END AS source, CASE k WHEN 0 THEN concat('M', i) WHEN 1 THEN concat('10.1000/X', i) ELSE concat('W', i) END AS external_id, concat('10.1000/x', i) AS doi,
 CASE k WHEN 0 THEN CAST(i AS VARCHAR) END AS pmid, concat('Title of ', i) AS title, CASE k WHEN 0 THEN 'Journal A' WHEN 1 THEN 'Journal B' END AS container, CASE WHEN k = 1 THEN date_trunc('month', day)::DATE ELSE day END AS published, CASE WHEN k = 0 AND i % 2 = 0 THEN i * 2 END AS citations FROM c""")
def literature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three literature services in one form, with the citations that a fourth knows."""
    c = load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")).alias("day"))
    i, day = F.col("c_custkey").cast("string"), F.date_format("day", "yyyy-MM-dd")
    one = c.where("k = 0").select(_joined('{"resultList":{"result":[{"id":"M', i, '","pmid":"', i, '","doi":"10.1000/X', i, '","title":"Title  of ', i, '","journalTitle":"Journal A","firstPublicationDate":"', day, '"}]}}').alias("json"))
    two = c.where("k = 1").select(_joined('{"message":{"items":[{"DOI":"10.1000/X', i, '","title":["Title of ', i, '","other"],"container-title":["Journal B"],"issued":{"date-parts":[[2024,1]]}}]}}').alias("json"))
    three = c.where("k = 2").select(_joined('{"results":[{"id":"https://openalex.org/W', i, '","doi":"https://doi.org/10.1000/X', i, '","title":"Title of ', i, '","publication_date":"', day, '","primary_location":null}]}').alias("json"))
    found = records.europe_pmc(one).unionByName(records.crossref(two)).unionByName(records.openalex(three))
    known = c.where("c_custkey % 2 = 0").select(_joined('{"data":[{"pmid":', i, ',"citation_count":', (F.col("c_custkey") * 2).cast("string"), ',"nih_percentile":1.5}]}').alias("json"))
    return records.enrich(found, records.icite(known)).drop("position", "percentile")


@query("SELECT p_partkey, DATE '2024-01-01' + CAST(p_size AS INTEGER) AS published FROM part WHERE p_brand = 'Brand#1' AND p_partkey % 3 <> 2 AND p_size BETWEEN 5 AND 30")
def journal_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of exactly one journal in a window of days: other spellings of its name count, its supplements don't."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.col("p_brand")).when(k == 1, F.upper(F.concat_ws(" ", F.split("p_brand", "#")))).otherwise(F.concat("p_brand", F.lit(": Supplement")))
    works = load(spark, sf_dir, "part").select("p_partkey", name.alias("container"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("published"))
    return records.journal_works(works, "Brand 1", "2024-01-06", "2024-01-31").select("p_partkey", "published")


@query("""WITH n AS (SELECT s_suppkey * 2 + j AS position, concat('signal ', s_suppkey, CASE j WHEN 0 THEN ' a' ELSE ' b' END) AS label FROM supplier, (VALUES (0), (1)) AS t(j)), capped AS (SELECT * FROM n ORDER BY position LIMIT 60)
SELECT position, label FROM capped WHERE position % 5 <> 0""")
def connector_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connector's run: each planned record gives two signals, the first sixty are the run, invalid ones are refused."""
    planned = load(spark, sf_dir, "supplier").select("s_suppkey")

    def normalise(rows: DataFrame) -> DataFrame:
        pairs = rows.select("s_suppkey", F.posexplode(F.array(F.lit(" a"), F.lit(" b"))).alias("j", "end"))
        return pairs.select((F.col("s_suppkey") * 2 + F.col("j")).alias("position"), _joined("signal ", F.col("s_suppkey").cast("string"), F.col("end")).alias("label"))

    return records.connector_run(planned, normalise, 60, "position % 5 <> 0")


@query("SELECT event_type AS source, CAST(max(ts) AS DATE) AS last_run FROM events GROUP BY event_type ORDER BY max(ts), event_type LIMIT 1")
def service_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one service whose turn it is: the one that ran longest ago."""
    runs = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last_run"))
    return records.least_recent(runs).select("source", F.to_date("last_run").alias("last_run"))


@query("SELECT concat('art_', sha256(text)) AS artifact_id, max(length(text)) AS chars FROM documents GROUP BY text")
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored by content: equal ones once, under an identity made of their bytes."""
    return sinks.with_artifact_id(load(spark, sf_dir, "documents").select("text"), "text").select("artifact_id", F.char_length("text").cast("long").alias("chars"))


@query("SELECT sha256(concat(event_type, '|', user_id)) AS dedupe_key FROM (SELECT DISTINCT event_type, user_id FROM events WHERE user_id % 5 <> 0)")
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages still to be sent: once for each kind and user, without those that went out before."""
    events = load(spark, sf_dir, "events").select("event_type", "user_id")
    nothing = events.sparkSession.createDataFrame([], "dedupe_key string")
    sent = sinks.outbox(events.where("user_id % 5 = 0"), nothing, ["event_type", "user_id"])
    return sinks.outbox(events, sent, ["event_type", "user_id"]).select("dedupe_key")


@query(f"""WITH n AS (SELECT user_id, count(*) AS views, count(*) FILTER (WHERE ts < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 5 DAY) AS before FROM events WHERE ts < TIMESTAMP '{EVENTS_AS_OF}' GROUP BY user_id) SELECT user_id, views FROM n WHERE views <> before""")
def snapshots_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that a run appends: those whose fingerprint differs from the one of five days before."""
    events = load(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))

    def taken(day: str) -> DataFrame:
        n = events.where(F.col("ts") < F.expr(day)).groupBy("user_id").agg(F.count("*").alias("views"))
        return n.withColumn("fp", T.fingerprint(F.col("user_id"), F.col("views")))

    now, before = taken(f"timestamp '{EVENTS_AS_OF}'"), taken(f"timestamp '{EVENTS_AS_OF}' - interval 5 day")
    return sinks.changed_snapshots(now, before, "user_id", "fp").select("user_id", "views")


@query("WITH b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 50 = 0) SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events SEMI JOIN b USING (user_id, event_type) GROUP BY ALL")
def touched_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental run computes again: the targets that a batch brings, over their whole history."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    history = touched(events.where("event_id % 50 = 0"), events, ["user_id", "event_type"])
    return history.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE concat('10.1234/ab', o_orderkey) END AS doi, CASE WHEN o_orderkey % 5 IN (1, 3) THEN CAST(1000000 + o_orderkey AS VARCHAR) END AS pmid,
 CASE o_orderkey % 5 WHEN 3 THEN concat('pmid:', 1000000 + o_orderkey) WHEN 4 THEN concat('title:a title no ', o_orderkey) ELSE concat('doi:10.1234/ab', o_orderkey) END AS work FROM orders""")
def work_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOI and PMID out of running text and addresses, and the key of the work: DOI before PMID before title."""
    i, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    number = (F.col("o_orderkey") + 1_000_000).cast("string")
    text = (
        F.when(k == 0, _joined("See https://doi.org/10.1234/AB", i, "."))
        .when(k == 1, _joined("(doi:10.1234/ab", i, "; PMID: ", number, ")"))
        .when(k == 2, _joined('<a href="https://dx.doi.org/10.1234/ab', i, '">x</a>'))
        .when(k == 3, _joined("https://pubmed.ncbi.nlm.nih.gov/", number, "/"))
        .otherwise("volume 10, 1234 pages")
    )
    rows = load(spark, sf_dir, "orders").select("o_orderkey", T.doi(text).alias("doi"), T.pmid(text).alias("pmid"), _joined("A Title: No. ", i).alias("title"))
    return rows.select("o_orderkey", "doi", "pmid", T.work_key(F.col("doi"), F.col("pmid"), F.col("title")).alias("work"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('site.org/p/', p_partkey, '?a=1&b=2') WHEN 3 THEN concat('goo.gl/p/', p_partkey) ELSE concat('site.org/p/', p_partkey) END AS key FROM part")
def dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key for every spelling of an address: redirects unwrapped, no scheme, www, fragment or tracking."""
    i, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    url = (
        F.when(k == 0, _joined("HTTPS://www.Site.org/p/", i, "?b=2&utm_source=x&a=1#top"))
        .when(k == 1, _joined("https://www.google.com/url?sa=t&url=https%3A%2F%2Fsite.org%2Fp%2F", i, "%2F&usg=x"))
        .when(k == 2, _joined("http://site.org/p/", i, "/?fbclid=1"))
        .otherwise(_joined("https://goo.gl/p/", i))
    )
    return load(spark, sf_dir, "part").select("p_partkey", T.url_key(T.redirect_target(url)).alias("key"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN concat('Ã© beside 漢 ', p_partkey) ELSE concat('Ayşe’nin “kitabı” – €5 ', p_partkey) END AS text FROM part")
def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read in a wrong encoding are read again; right ones, and those that no single byte could spell, stay."""
    good = _joined("Ayşe’nin “kitabı” – €5 ", F.col("p_partkey").cast("string"))
    latin = F.decode(F.encode(good, "UTF-8"), "ISO-8859-1")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, good).when(k == 1, latin).when(k == 2, F.translate(latin, T.C1, T.CP1252)).otherwise(_joined("Ã© beside 漢 ", F.col("p_partkey").cast("string")))
    return load(spark, sf_dir, "part").select("p_partkey", T.repaired(text).alias("text"))


@query("SELECT s_suppkey, concat('R&D <', chr(CAST(192 + s_suppkey % 60 AS INTEGER)), '> “', s_suppkey, '” &lt; &#xD800; 😀') AS text FROM supplier")
def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup to text: tags, CDATA and references by name and number, each decoded once."""
    i = F.col("s_suppkey").cast("string")
    number = (F.col("s_suppkey") % 60 + 192).cast("string")
    source = _joined("<p>R&#38;D</p> &lt;&#", number, ";&gt; <b><![CDATA[&#x201C;", i, "&#8221;]]></b>\n &amp;lt; &#xD800; &#x1F600;")
    return load(spark, sf_dir, "supplier").select("s_suppkey", markup.plain(source).alias("text"))


#: Rules of a gate by words: what is refused for which reason, what is taken as what; the first that fits counts.
REFUSED = (("sport", ("match", "league")), ("advert", ("sale", "discount")))
TAKEN = (("research", ("trial", "cohort")), ("call", ("grant", "fellowship")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 5) THEN 'discard:sport' WHEN p_partkey % 6 = 1 THEN 'discard:advert' WHEN p_partkey % 6 = 2 THEN 'accept:research' WHEN p_partkey % 6 = 3 THEN 'accept:call' ELSE 'discard:no_signal' END AS verdict FROM part""")
def keyword_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles through a gate by words: refusals go before what would be taken, parts of words don't count."""
    titles = ("The league opens", "A sale for a trial", "A cohort of nurses", "Grant and fellowship news", "Matchless granted salesmen", "Trial match tonight")
    title = F.get(F.array(*(F.lit(t) for t in titles)), (F.col("p_partkey") % 6).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", keyword_gate(F.lower(title), REFUSED, TAKEN).alias("verdict"))


@query("""WITH w AS (SELECT p_partkey, regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || p_name), '[^a-z0-9]+') AS w, p_name, p_type FROM part)
SELECT p_partkey, array_to_string(list_slice(list_filter(w, lambda x, j: length(x) >= 4 AND list_position(w, x) = j), 1, 3), ' AND ') AS terms, CASE p_partkey % 3 WHEN 0 THEN concat('We found ', p_partkey, ' parts.') WHEN 1 THEN 'More follows!' END AS takeaway FROM w""")
def search_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of a text, and the sentence that says what it found: by a cue, else the last one; none in an empty text."""
    text = F.when(F.col("p_partkey") % 3 == 0, _joined("It began. We found ", F.col("p_partkey").cast("string"), " parts. More follows!")).when(F.col("p_partkey") % 3 == 1, "It began. More follows!").otherwise("")
    words = F.concat_ws(" ", "p_name", "p_type", "p_name")
    return load(spark, sf_dir, "part").select("p_partkey", W.search_terms(words, 3).alias("terms"), W.takeaway(text).alias("takeaway"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>')) AS h FROM pages) SELECT page_id, CAST(substr(h, 3, 1) AS INTEGER) AS level, count(*) AS headings FROM a GROUP BY ALL""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of pages by level, through the table function that SQL users call."""
    udtf.register(spark)
    return spark.sql("SELECT page_id, level, count(*) AS headings FROM {pages}, LATERAL page_headings(html) GROUP BY page_id, level", pages=load(spark, sf_dir, "pages").select("page_id", "html"))
