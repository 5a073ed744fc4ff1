"""Token counts from flat token files by a separator scan.

``write_flat`` tokenises documents into files of bare little-endian identifiers, each document ended
by one end-of-document identifier, with no index; it returns which document is the how-manieth of
which file. ``scan`` needs only such files: they are cut into blocks of bytes, each task searches its
blocks for the identifier with one vector comparison, and a prefix scan over the blocks of a file
(last separator before the block, separators so far) stitches documents that span blocks.

Null and empty texts have 0 tokens. Tokens behind the last separator count as one more, unended
document. Repeated rows are separate documents. An empty folder or table gives an empty result. Control strings in a text are
ordinary text. Files are written under a task's own name and moved when whole, so a task that runs
again replaces its file by the same one. The folder must be shared, and readable by ``pyarrow.fs``.
The vocabulary file is read by the driver alone and sent to the tasks.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, remove, shared_dir, small_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50_256
#: A vocabulary file of up to so many bytes may be sent to every executor.
VOCABULARY_BYTES = 64 << 20
#: Up to so many counts (some 3 MB) may be sent to every executor.
BROADCAST_ROWS = 100_000
#: Fixed value: how this public vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@cache
def _encoding(file: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(path: str) -> bytes:
    """The vocabulary file, read where the driver runs."""
    with open(path, "rb") as f:
        file = f.read(VOCABULARY_BYTES + 1)
    if len(file) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return file


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _uri(path: str) -> str:
    """``file:/x`` as ``file:///x``; other places as they are."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def write_flat(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, eod: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, id) of every row, after the files are written."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = _encoding(shared.value).encode_ordinary, TaskContext.get()
        part = context.partitionId()
        system, path = _system(folder)
        name, end = f"{path}/part-{part:06d}.bin", np.array([eod], dtype)
        own = f"{path}/.task-{part}-{uuid.uuid4().hex}"
        system.create_dir(path, recursive=True)
        ordinal = 0
        with system.open_output_stream(own) as out:
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    if text:
                        out.write(np.array(encode(text), dtype).tobytes())
                    out.write(end.tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], names=["file", "ordinal", "id"])
                ordinal += n
        system.move(own, name)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return checkpoint(rows.mapInArrow(run, f"file int, ordinal long, id {dict(rows.dtypes)['id']}"))


def scan(spark: SparkSession, folder: str, *, eod: int = END_OF_DOCUMENT, dtype: str = "<u2", block_bytes: int = 8 << 20) -> DataFrame:
    """(path, ordinal, start, n_tokens) of every document in the flat files of a folder; start counts tokens."""
    size = np.dtype(dtype).itemsize
    per_block = block_bytes // size
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length").where("length > 0")
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / (per_block * size)))).alias("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system, own = _system(_uri(path))
                with system.open_input_file(own) as f:
                    at = block * per_block * size
                    ids = np.frombuffer(f.read_at(min(per_block * size, length - at) // size * size, at), dtype)
                found = np.flatnonzero(ids == eod) + block * per_block
                last = (at + len(ids) * size) >= length // size * size
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block]), pa.array([found.tolist()], pa.list_(pa.int64())), pa.array([length // size if last else None], pa.int64())], names=["path", "block", "ends", "total"])

    found = checkpoint(blocks.repartition("path", "block").mapInArrow(search, "path string, block long, ends array<long>, total long"))
    # the prefix scan sees three numbers a block; the separators themselves stay where they are
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.select("path", "block", F.try_element_at("ends", F.lit(-1)).alias("last"), F.size("ends").alias("n"))
    carries = sizes.select("path", "block", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    stitched = found.join(carries, ["path", "block"])
    # behind the last separator of the file there may be an unended document
    final = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("carry"))
    ends = F.when(F.col("total") > final + 1, F.concat("ends", F.array("total"))).otherwise(F.col("ends"))
    rows = stitched.select("path", "carry", "base", ends.alias("ends"))
    spans = F.transform("ends", lambda e, i: F.struct(F.when(i == 0, F.col("carry")).otherwise(F.get("ends", i - 1)).alias("previous"), e.alias("end")))
    return rows.select("path", "base", F.posexplode(spans).alias("i", "span")).select("path", (F.col("base") + F.col("i")).alias("ordinal"), (F.col("span.previous") + 1).alias("start"), (F.col("span.end") - F.col("span.previous") - 1).alias("n_tokens"))


def count(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """(id, n_tokens) of every row, counted from flat files in the shared folder, which are removed then."""
    spark = docs.sparkSession
    folder = f"{_uri(shared_dir(spark))}/tokens-{uuid.uuid4().hex}"
    written = write_flat(docs, folder, id_col=id_col, text_col=text_col, ranks=ranks)
    rows = written.count()
    if not rows:
        return written.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_tokens"))
    counted = scan(spark, folder).withColumn("file", F.regexp_extract("path", r"part-(\d+)\.bin$", 1).cast("int"))
    # the planner cannot know how much the scan finds: a few documents are broadcast by their count, more are merged
    counted = counted.hint("broadcast" if rows <= BROADCAST_ROWS else "merge")
    out = checkpoint(written.join(counted, ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens"))
    remove(spark, folder)
    return out


def lengths(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """(id, n_tokens) of every row without files, for operators that only need lengths: the same numbers as ``count``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_ordinary
        for batch in batches:
            n = np.array([len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=[id_col, "n_tokens"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_tokens long")
