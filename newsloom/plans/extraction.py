"""Pages and feeds to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import first_match
from ..sources import markup
from ..sources.tables import load
from .registry import query


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS title, length(html) AS chars FROM pages""")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", markup.title(F.col("html")).alias("title"), F.char_length("html").cast("long").alias("chars"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>')) AS b FROM pages) SELECT page_id, regexp_extract(b, 'href="([^"]*)"', 1) AS href, count(*) AS n FROM a GROUP BY ALL""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the anchors of each page lead, counted."""
    return markup.links(load(spark, sf_dir, "pages").select("page_id", "html")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, CASE WHEN host = '' THEN 'no_host' WHEN path IN ('', '/') THEN 'root' WHEN len(string_split(path, '/')) > 4 THEN 'deep' ELSE 'article' END AS quality FROM u""")
def link_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    rules = [("no_host", F.col("host") == ""), ("root", F.col("path").isin("", "/")), ("deep", F.size(F.split("path", "/")) > 4)]
    return u.select("page_id", "host", first_match(rules, "article").alias("quality"))


_STRIPPED = "html"
for _tag in ("script", "style", "noscript"):
    _STRIPPED = rf"regexp_replace({_STRIPPED}, '(?is)<{_tag}\b.*?</{_tag}>', ' ', 'g')"
_STRIPPED = rf"regexp_replace(regexp_replace({_STRIPPED}, '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _sign in markup.ENTITIES.items():
    _STRIPPED = f"replace({_STRIPPED}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"


@query(rf"SELECT page_id, trim(regexp_replace({_STRIPPED}, '\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text of each page without scripts and styles."""
    return load(spark, sf_dir, "pages").select("page_id", markup.body_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, 0 AS position, concat('Item ', doc_id, ' – é') AS title, concat('https://example.com/f/', doc_id) AS url, concat('Summary of ', doc_id) AS summary FROM documents WHERE doc_id % 3 <> 2
UNION ALL SELECT doc_id, 1, 'A & B', CASE doc_id % 3 WHEN 0 THEN 'https://example.org/x' WHEN 1 THEN 'https://example.com/root' ELSE 'https://cdn.example.com/y' END, NULL FROM documents
UNION ALL SELECT doc_id, 3, 'By identity', concat('urn:', doc_id), NULL FROM documents""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of feeds in both dialects, written from the documents: links of every kind, entries without title or link, references by number."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    first = F.concat(F.lit("<item>"), F.when(k != 2, F.concat(F.lit("<title><![CDATA[Item "), i, F.lit(" &#8211; &#xe9;]]></title>"))).otherwise(""), F.lit("<link>"), i, F.lit("</link><description>Summary of <b>"), i, F.lit("</b></description></item>"))
    href = F.when(k == 0, "https://example.org/x").when(k == 1, "/root").otherwise("//cdn.example.com/y")
    second = F.concat(F.lit("<entry><title>A &amp; B</title><link rel='alternate' href='"), href, F.lit("'/><id>urn:no</id></entry><item><title>No link</title></item>"))
    third = F.concat(F.lit("<item><title>By identity</title><guid>urn:"), i, F.lit("</guid></item>"))
    feeds = load(spark, sf_dir, "documents").select("doc_id", F.lit("https://example.com/f/feed.xml?all=1").alias("base"), F.concat(F.lit("<rss>"), first, second, third, F.lit("</rss>")).alias("xml"))
    return markup.feed_items(feeds, base="base").select("doc_id", "position", "title", "url", "summary")
