"""Table functions for SQL: rows from one page, in Python because their input is one value and their output rows."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_ANCHOR = re.compile(r"(?is)<a\b[^>]*href=[\"']([^\"'#]+)[^>]*>(.*?)</a>")
_HEADING = re.compile(r"(?is)<(h[1-6])\b[^>]*>(.*?)</\1>")


def _plain(markup: str) -> str:
    return " ".join(html.unescape(re.sub(r"(?s)<[^>]*>", " ", markup)).split())


@udtf(returnType="place int, href string, label string")
class PageLinks:
    """(place, href, label) of a page's anchors; a null page has none."""

    def eval(self, page: str) -> Iterator[tuple[int, str, str]]:
        for i, m in enumerate(_ANCHOR.finditer(page or "")):
            yield i, m[1], _plain(m[2])


@udtf(returnType="place int, level int, title string")
class PageHeadings:
    """(place, level, title) of a page's headings."""

    def eval(self, page: str) -> Iterator[tuple[int, int, str]]:
        for i, m in enumerate(_HEADING.finditer(page or "")):
            yield i, int(m[1][1]), _plain(m[2])


def register(spark: SparkSession) -> None:
    """Make ``page_links`` and ``page_headings`` known to SQL: ``SELECT ... FROM pages, LATERAL page_links(html)``."""
    spark.udtf.register("page_links", PageLinks)
    spark.udtf.register("page_headings", PageHeadings)
