"""A paged, dated source as a stream: the offset is where its next page begins.

An offset names a date bound, the token of the next page of the chain that began at that bound (or none), and the newest date seen in the chain. A read
takes up to ``pages`` pages. At the end of a chain the newest date becomes the bound, that day included: its records come again and are told apart by
their id, by ``once`` over what was written. A token that the source no longer knows is dropped, and the chain begins
again at the newest date seen, so no record at or after that date is missed and none before it is read again.

Spark keeps the offset in the stream's checkpoint, so a run continues where the last one ended.
"""

from __future__ import annotations

import datetime
import json
import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "id string, day string, body string"


class TokenRejected(Exception):
    """The source no longer knows a page's token."""


class FolderPages:
    """Pages as files: ``first.json`` and ``<token>.json``, each with records (id, day, body), the oldest first, and the next page's token.

    A bound leaves out older records, as a service's filter would; a token without a file is rejected.
    """

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)

    def fetch(self, since: str, token: str | None) -> tuple[list[dict], str | None]:
        path = f"{self.root}/{token or 'first'}.json"
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            if token:
                raise TokenRejected(token)
            return [], None
        with self.fs.open_input_stream(path) as f:
            page = json.loads(f.read())
        return [r for r in page["records"] if r["day"] >= since], page.get("next")


class PageStream(SimpleDataSourceStreamReader):
    """The stream of a source with ``fetch(since, token)``."""

    def __init__(self, source: FolderPages, since: str, pages: int):
        self.source, self.since, self.pages = source, since, pages

    def initialOffset(self) -> dict:
        return {"since": self.since, "token": None, "newest": None, "seen": 0}

    def _step(self, at: dict) -> tuple[list[dict], dict]:
        """The records of one page and the offset after it."""
        try:
            records, token = self.source.fetch(at["since"], at["token"])
        except TokenRejected:
            at = {"since": at["newest"] or at["since"], "token": None, "newest": None, "seen": 0}
            records, token = self.source.fetch(at["since"], None)
        newest, seen = at["newest"], at["seen"] if at["token"] else 0
        for r in records:
            if newest is None or r["day"] > newest:
                newest, seen = r["day"], 0
            if r["day"] == newest:  # a sum over the newest day's ids tells whether it has changed when it comes again
                seen = (seen + zlib.crc32(str(r["id"]).encode())) % 2**32
        if token:
            return records, {"since": at["since"], "token": token, "newest": newest, "seen": seen}
        return records, {"since": newest or at["since"], "token": None, "newest": None, "seen": seen}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, at, idle, taken = [], start, start["token"] is None, 0
        # a chain that has just begun goes on until it shows something newer than its bound, or ends: else it would begin again for ever
        while taken == 0 or at["token"] is not None and (taken < self.pages or idle and (at["newest"] or "") <= start["since"]):
            records, at = self._step(at)
            out, taken = out + records, taken + 1
        if idle and at == start:  # nothing but the bound's own day, as it was
            out = []
        return iter([(str(r["id"]), r["day"], json.dumps(r.get("body"))) for r in out]), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        out, at = [], start
        while at != end:
            records, at = self._step(at)
            out += records
            if at["token"] is None:
                break
        return iter([(str(r["id"]), r["day"], json.dumps(r.get("body"))) for r in out])


class PagedRecords(DataSource):
    """``spark.readStream.format("paged_records")`` with options path, since (a date) or as_of and lookback (days), and pages (a read)."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> PageStream:
        o = self.options
        since = o.get("since") or (datetime.date.fromisoformat(o["as_of"]) - datetime.timedelta(days=int(o.get("lookback", "3")))).isoformat()
        return PageStream(FolderPages(o["path"]), since, int(o.get("pages", "20")))


def cursor_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(id, day, body) of a folder of pages as a stream."""
    spark.dataSource.register(PagedRecords)
    return spark.readStream.format("paged_records").options(path=folder, **options).load()


def advance(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append what the source has that is new, and stop."""
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()


def once(records: DataFrame) -> DataFrame:
    """Each record once: the days that chains share come again with equal ids."""
    return records.dropDuplicates(["id"])


def next_cursors(runs: DataFrame, now: str, lookback: int = 3) -> DataFrame:
    """(reader, since, page_token, newest): where each incremental reader goes on, from the log of its runs.

    runs: (reader, status, created_at, finished_at, since, token_out, newest, error). A token left by the last completed run is taken up with its bound, unless the
    newest completed or failed run was refused with a 400; then, as without a token, the bound is the newest date seen, else the old bound. A reader
    without a completed run looks back some days.
    """
    done = runs.where("status = 'COMPLETED'").groupBy("reader").agg(F.max_by(F.struct("since", "token_out", "newest"), F.struct("finished_at", "created_at")).alias("c"))
    last = runs.where(F.col("status").isin("COMPLETED", "FAILED")).groupBy("reader").agg(F.max_by(F.struct("status", "error"), F.struct("created_at", "finished_at")).alias("l"))
    refused = (F.col("l.status") == "FAILED") & F.coalesce(F.col("l.error").rlike(r"request failed: 400\b"), F.lit(False))
    goes_on = F.col("c.token_out").isNotNull() & ~F.coalesce(refused, F.lit(False))
    bound = F.coalesce("c.newest", "c.since", F.date_sub(F.lit(now).cast("date"), lookback))
    rows = runs.select("reader").distinct().join(done, "reader", "left").join(last, "reader", "left")
    return rows.select("reader", F.when(goes_on, F.col("c.since")).otherwise(bound).alias("since"), F.when(goes_on, F.col("c.token_out")).alias("page_token"), F.when(goes_on, F.col("c.newest")).alias("newest"))
