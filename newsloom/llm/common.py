"""What the operators of this subpackage share: reading, checkpoints, splits, batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; texts may be long, and a batch is held whole by a worker.
BATCH_ROWS = 256
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's default batch of 10,000 rows; a value that the user chose stays.

    Spark reads this setting when a plan runs, so it stays lowered for the session.
    """
    if spark.conf.get(_BATCH_KEY, "10000") == "10000":
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse; a temporary one in local mode only."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        local = tempfile.mkdtemp(prefix="newsloom-") if context.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/newsloom-checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or local)
    return context._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files in whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder and go on from there: lineage ends, lost executors don't matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 0 by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A name for rows of the same id and text, also where either is null."""
    text = lambda name: F.col(name).cast("string")
    named = F.when(F.col(id_col).isNull(), F.lit("-")).otherwise(F.concat(F.char_length(text(id_col)).cast("string"), F.lit(":"), text(id_col)))
    held = F.when(F.col(text_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), text(text_col)))
    return F.md5(F.concat(named, held).cast("binary"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have; Spark reads names without regard to case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sampled(df: DataFrame, key: str | Column, bound: int) -> DataFrame:
    """About ``bound`` rows, chosen by a hash of ``key``; all rows if there are no more than that."""
    rows = df.count()
    if rows <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key) if isinstance(key, str) else key), F.lit(1_000_000)) < int(1_000_000 * bound / rows))


def pieces(texts: Iterable[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``most`` characters each; a longer text stands alone."""
    start = held = end = 0
    for end, text in enumerate(texts, 1):
        size = len(text)
        if held and held + size > most:
            yield start, end - 1
            start, held = end - 1, 0
        held += size
    if end > start:
        yield start, end


class Remembered(dict):
    """A function of words, remembered until ``trim`` finds too many of them."""

    def __init__(self, function, room: int = 200_000):
        super().__init__()
        self.function, self.room = function, room

    def __missing__(self, word):
        out = self[word] = self.function(word)
        return out

    def trim(self) -> None:
        if len(self) > self.room:
            self.clear()
