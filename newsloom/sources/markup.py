"""Feeds, sitemaps and pages as rows; regular expressions of the JVM throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The named character references that feeds and pages use most.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def numbered(c: Column) -> Column:
    """Numeric character references decoded, in either base; numbers that name no character stay as they are."""

    def one(part: Column) -> Column:
        digits, base16 = F.regexp_extract(part, "^([0-9]{1,7});", 1), F.regexp_extract(part, "^[xX]([0-9a-fA-F]{1,6});", 1)
        n = F.when(digits != "", digits.cast("int")).when(base16 != "", F.conv(base16, 16, 10).cast("int"))
        sign = F.when(n == 38, "&amp;").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        named = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        return F.when(named, F.concat(sign, F.regexp_replace(part, "^[0-9a-fA-FxX]+;", ""))).otherwise(F.concat(F.lit("&#"), part))

    def whole(text: Column) -> Column:
        parts = F.split(text, "&#")
        decoded = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
        return F.when(F.contains(text, F.lit("&#")), decoded).otherwise(text)

    return F.get(F.transform(F.array(c), whole), F.lit(0))  # the text stands in the plan once


def plain(c: Column) -> Column:
    """Markup to text: CDATA opened, tags to spaces, references by number and the common ones by name decoded once, white space single."""
    out = F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    out = numbered(F.regexp_replace(out, r"(?s)<[^>]*>", " "))
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _first(block: Column, *tags: str) -> Column:
    """Content of the first of the tags that is there and not empty."""
    found = [plain(F.regexp_extract(block, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1)) for t in tags]
    return F.get(F.filter(F.array(*found), lambda f: f != ""), F.lit(0))


def absolute(base: Column, href: Column) -> Column:
    """A link as an absolute address; null without a link, and where neither it nor the base has a scheme."""
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<![:/])/[^/]*$", "")
    found = (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(root == "", None)
        .when(href.startswith("//"), F.concat(F.regexp_extract(root, "^([a-zA-Z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )
    return F.when(href != "", found)


def feed_items(feeds: DataFrame, xml: str = "xml", most: int = 30, base: str | None = None) -> DataFrame:
    """(other columns, position, title, url, summary, published) of the first ``most`` entries of RSS and Atom feeds.

    The address is a link's href, else its text, else the entry's identity; with ``base`` (a column), relative ones are
    completed. Entries without a title or an address are no items. 30 entries and 500 characters are fixed values.
    """
    entries = F.slice(F.regexp_extract_all(xml, F.lit(r"(?is)(<(?:item|entry)\b.*?</(?:item|entry)>)"), 1), 1, most)
    rows = feeds.select(*(c for c in feeds.columns if c != xml), F.posexplode(entries).alias("position", "block"))
    b = F.col("block")
    href = F.regexp_extract(b, r"""(?is)<link\b[^>]*href=["']([^"']+)["']""", 1)
    url = F.coalesce(F.when(href != "", href), _first(b, "link"), _first(b, "guid", "id"))
    url = absolute(F.col(base), url) if base else url
    out = rows.select(*(c for c in rows.columns if c != "block"), _first(b, "title").alias("title"), url.alias("url"), F.substring(_first(b, "description", "summary", "content"), 1, 500).alias("summary"), _first(b, "pubDate", "published", "updated", "dc:date").alias("published"))
    return out.where("title is not null and url is not null")


def sitemap_urls(maps: DataFrame, xml: str = "xml", most: int | None = None) -> DataFrame:
    """(other columns, url, last_modified, news_title) of the entries of sitemaps; of news sitemaps the first ``most`` are wanted (40 as a rule)."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)(<url>.*?</url>)"), 1)
    rows = maps.select(*(c for c in maps.columns if c != xml), F.explode(F.slice(blocks, 1, most) if most else blocks).alias("block"))
    b = F.col("block")
    return rows.select(*(c for c in rows.columns if c != "block"), _first(b, "loc").alias("url"), F.to_date(F.substring(_first(b, "lastmod", "news:publication_date"), 1, 10)).alias("last_modified"), _first(b, "news:title").alias("news_title"))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(other columns, position, href, label) of the anchors of pages, in their order."""
    rows = pages.select(*(c for c in pages.columns if c != html), F.posexplode(F.regexp_extract_all(html, F.lit(r"""(?is)(<a\b[^>]*href=["'][^"']*["'][^>]*>.*?</a>)"""), 1)).alias("position", "block"))
    b = F.col("block")
    return rows.select(*(c for c in rows.columns if c != "block"), F.regexp_extract(b, r"""(?is)href=["']([^"']*)["']""", 1).alias("href"), plain(b).alias("label"))


def title(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def meta_date(html: Column) -> Column:
    """The publication date of a page: meta, then time element, then JSON-LD; null if none."""
    found = [F.regexp_extract(html, p, 1) for p in (r"""(?is)<meta\b[^>]*(?:published_time|datePublished)[^>]*content=["']([0-9]{4}-[0-9]{2}-[0-9]{2})""", r"""(?is)<time\b[^>]*datetime=["']([0-9]{4}-[0-9]{2}-[0-9]{2})""", r"""(?is)"datePublished"\s*:\s*"([0-9]{4}-[0-9]{2}-[0-9]{2})""")]
    return F.to_date(F.coalesce(*(F.when(f != "", f) for f in found)))


def body_text(html: Column) -> Column:
    """All text of a page without scripts and styles."""
    return plain(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", " "))


def page_day(html: Column) -> Column:
    """The day of a page: what its markup says (meta, time element, JSON-LD), else the first day that its text prints."""
    from ..functions.wording import printed_days

    return F.coalesce(meta_date(html), F.get(printed_days(body_text(html)), F.lit(0)))


def unseen_entries(feeds: DataFrame, seen: DataFrame, xml: str = "xml", most: int = 30) -> DataFrame:
    """Entries of paged feeds whose address is not among the seen ones (url): the first page that shows an entry has it."""
    rows = feed_items(feeds, xml, most).where("url is not null and url <> ''")
    first = rows.groupBy("url").agg(F.min(F.struct("page", "position", "title")).alias("f"))
    return first.join(seen.select("url").distinct(), "url", "left_anti").select("url", F.col("f.page").alias("page"), F.col("f.title").alias("title"))
