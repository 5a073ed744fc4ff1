"""Which links of listing pages and sitemaps are items, and which of them to take next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .markup import plain

#: Labels that only continue an item named by the heading before, and labels that are no items.
MORE = "^(read more|more|continue( reading)?|details|devamı|devamını oku|detay(lar)?)[ .…»>]*$"
NAVIGATION = "^(home|contact|about( us)?|login|search|menu|next|previous|privacy( policy)?|cookies?|subscribe|english|türkçe|anasayfa|iletişim|hakkımızda)$"
_DATED = r"20[0-9]{2}[-/.][0-9]{1,2}"


def host(url: Column) -> Column:
    """Host without www, lower case; empty for relative links."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:www\.)?([^/?#:]+)", 1))


def listing_links(pages: DataFrame, key: str, html: str = "html", url: str = "url", *, scanned: int = 400, kept: int = 25) -> DataFrame:
    """(key, place, href, title) of the item links of listing pages, dated ones first.

    A link that says only "read more" takes the heading before it as its title. Titles have 8 to 300
    characters, no navigation words, and the link stays on the page's own host. A target counts once. The first
    ``scanned`` anchors are looked at and ``kept`` links kept for each page, as the definition of a listing says.
    """
    parts = F.regexp_extract_all(html, F.lit(r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]>|<a\b[^>]*href=[\"'][^\"']*[\"'][^>]*>.*?</a>)"), 1)
    rows = pages.select(key, F.col(url).alias("__page"), F.posexplode(parts).alias("at", "part"))
    rows = rows.withColumn("heading", F.when(F.lower("part").startswith("<h"), plain(F.col("part"))))
    rows = rows.withColumn("anchor", F.regexp_extract("part", r"(?is)(<a\b[^>]*href=[\"'][^\"']*[\"'][^>]*>.*?</a>)", 1)).withColumn("before", F.last("heading", ignorenulls=True).over(Window.partitionBy(key).orderBy("at")))
    links = rows.where("anchor <> ''").select(key, "__page", "at", "before", F.regexp_extract("anchor", r"(?is)href=[\"']([^\"'#]*)", 1).alias("href"), plain(F.col("anchor")).alias("label"))
    links = links.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("n") <= scanned)
    title = F.when(F.lower("label").rlike(MORE), F.col("before")).otherwise(F.col("label"))
    links = links.withColumn("title", title)
    own_host = host(F.col("href")).isin("") | (host(F.col("href")) == host(F.col("__page")))
    good = F.length("title").between(8, 300) & ~F.lower("title").rlike(NAVIGATION) & (F.col("href") != "") & own_host
    first = links.where(good).groupBy(key, "href").agg(F.min(F.struct("at", "title")).alias("f")).select(key, "href", F.col("f.at").alias("at"), F.col("f.title").alias("title"))
    dated = F.concat_ws(" ", "href", "title").rlike(_DATED)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.when(dated, 0).otherwise(1), "at"))
    return first.withColumn("place", place).where(F.col("place") <= kept).select(key, "place", "href", "title")


def recent_entries(entries: DataFrame, as_of: str, days: int) -> DataFrame:
    """Sitemap entries of the last ``days`` days, not more than one day ahead, without site roots."""
    today = F.lit(as_of).cast("date")
    path = F.regexp_replace(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return entries.where((path != "") & F.col("last_modified").between(F.date_sub(today, days), F.date_add(today, 1)))


def rotation_window(pool: DataFrame, key: str, seen: DataFrame, *, start: int, size: int) -> DataFrame:
    """The next ``size`` unseen rows of each source's pool in key order from place ``start`` on, around the end.

    pool has (source, key). Places are ranks within a source; the window is a modular range of them.
    """
    left = pool.join(seen.select("source", key), ["source", key], "left_anti").dropDuplicates(["source", key])
    w = Window.partitionBy("source")
    ranked = left.withColumn("place", F.row_number().over(w.orderBy(key)) - 1).withColumn("total", F.count("*").over(w))
    return ranked.where(F.pmod(F.col("place") - F.lit(start), F.col("total")) < size).select("source", key)


def best_strategy(found: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the first strategy (column ``strategy``) in ``order`` that found anything for its keys."""
    rank = F.array_position(F.array(*(F.lit(s) for s in order)), F.col("strategy"))
    ranked = found.withColumn("__rank", rank).where("__rank > 0")
    best = ranked.groupBy(*keys).agg(F.min("__rank").alias("__best"))
    return ranked.join(best, list(keys)).where("__rank = __best").drop("__rank", "__best")


def cards(pages: DataFrame, key: str, html: str = "html", *, card: str = "article", most: int = 30) -> DataFrame:
    """(key, place, href, title, printed) of the first ``most`` cards of a listing: each card element's heading, first link and printed day.

    Cards without a heading or a link are no items; an address counts once for each page.
    """
    parts = F.slice(F.regexp_extract_all(html, F.lit(rf"(?is)(<{card}\b[^>]*>.*?</{card}>)"), 1), 1, most)
    rows = pages.select(key, F.posexplode(parts).alias("place", "part"))
    title = plain(F.regexp_extract("part", r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>", 1))
    rows = rows.select(key, "place", F.regexp_extract("part", r"(?is)<a\b[^>]*href=[\"']([^\"'#]+)", 1).alias("href"), title.alias("title"), F.regexp_extract("part", _DATED + r"[-/.][0-9]{1,2}", 0).alias("printed"))
    first = rows.where("href <> '' and title <> ''").groupBy(key, "href").agg(F.min(F.struct("place", "title", "printed")).alias("f"))
    return first.select(key, "f.place", "href", "f.title", F.when(F.col("f.printed") != "", F.col("f.printed")).alias("printed"))


def dated_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, place, printed, href, title) of table rows or list entries that print a day and hold a link."""
    parts = F.regexp_extract_all(html, F.lit(r"(?is)(<tr\b[^>]*>.*?</tr>|<li\b[^>]*>.*?</li>)"), 1)
    rows = pages.select(key, F.posexplode(parts).alias("place", "part"))
    rows = rows.select(key, "place", F.regexp_extract("part", r"([0-9]{1,2}[./][0-9]{1,2}[./]20[0-9]{2}|20[0-9]{2}-[0-9]{2}-[0-9]{2})", 1).alias("printed"), F.regexp_extract("part", r"(?is)<a\b[^>]*href=[\"']([^\"'#]+)", 1).alias("href"), plain(F.regexp_extract("part", r"(?is)<a\b[^>]*>(.*?)</a>", 1)).alias("title"))
    return rows.where("printed <> '' and href <> '' and title <> ''")


def prime_jump(pool: DataFrame, key: str, *, run: int, size: int, jump: int = 7919) -> DataFrame:
    """The rows of each source's pool that a deep run takes: ``size`` places from run times a prime on, around the end."""
    w = Window.partitionBy("source")
    ranked = pool.withColumn("__place", F.row_number().over(w.orderBy(key)) - 1).withColumn("__total", F.count("*").over(w))
    return ranked.where(F.pmod(F.col("__place") - F.pmod(F.lit(run * jump), F.col("__total")), F.col("__total")) < size).drop("__place", "__total")


def cascade(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, strategy, href, title): what the first strategy that finds anything finds: cards, dated rows, plain links, the page's title."""
    title = plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    found = cards(pages, key, html).select(key, F.lit("cards").alias("strategy"), "href", "title")
    found = found.unionAll(dated_rows(pages, key, html).select(key, F.lit("dated_rows"), "href", "title"))
    found = found.unionAll(listing_links(pages, key, html).select(key, F.lit("links"), "href", "title"))
    found = found.unionAll(pages.select(key, F.lit("title"), F.lit(None).cast("string"), title.alias("t")).where("t <> ''"))
    return best_strategy(found, [key], ["cards", "dated_rows", "links", "title"])
