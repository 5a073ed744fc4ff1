"""Ranked lexical search: each task runs WAND over shards of its documents, and the shards' heaps are merged.

A term's weight is w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document's length factor m = 100 - 50 + (50 n N) div L; a document scores
sum of w ((10^9 tf) div (1000 tf + 20 m)) over the item's terms, once each. N counts documents with a term, L their terms.

Two passes over the whole texts. The first counts N, L and the document frequency of the items' terms. In the second
a task gathers postings of those terms until a shard is full, cuts it into parts of documents of like length, and
takes each part's largest impact of each term. Every item then walks its terms' postings, all kept in document order: the lists
are ordered by the document they stand at, and the first list at which the largest impacts add up to the worst score in the heap
names the pivot. No document before it can enter the heap, so all lists before it jump there; if the first
list stands there already, the document is scored. Heaps go on from shard to shard of a task. The best of all tasks are merged in two steps, by
item and part, then by item.

Items are taken in lots of at most ``lot`` rows and ``lot_chars`` characters (a longer item is a lot), so tasks hold a bounded number
of terms however many items there are. Null texts have no terms; items without terms and items that share no term with a
document have no rows; repeated document rows are ranked each, repeated item rows answer each for itself; a document without
an id is ranked after others of its score; equal scores go by id. Empty tables give no rows.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_batches
from .terms import WORDS, lists, raw

_FOUND = "item int, doc_id long, score long, scored long, task int"
#: A shard holds so many documents or postings, whichever comes first, and is cut into so many parts by length.
SHARD_ROWS, SHARD_POSTINGS, SHARD_PARTS = 16_384, 4_000_000, 32
_END = 1 << 62
#: Stands for a missing id: after every other.
_NO_ID = 1 << 63


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def walk(postings: list[tuple[list[int], list[int], int]], ids: list[int], heap: list[tuple[int, int]], k: int) -> int:
    """Add a part's best documents to a heap of (score, -id) by WAND; how many documents were scored.

    postings: for each term its documents in order, their impacts and the largest of these.
    """
    live = sorted(([docs[0], top, docs, impacts, 0, len(docs)] for docs, impacts, top in postings), key=itemgetter(0))
    scored = 0
    while live:
        least, reach = heap[0][0] if len(heap) == k else 1, 0
        for at, term in enumerate(live):
            reach += term[1]
            if reach >= least:
                break
        else:
            break
        pivot, ended = term[0], False
        if live[0][0] == pivot:
            score = 0
            for term in live:
                if term[0] != pivot:
                    break
                score += term[3][term[4]]
                term[4] += 1
                if term[4] < term[5]:
                    term[0] = term[2][term[4]]
                else:
                    term[0], ended = _END, True
            scored += 1
            if score >= least:
                entry = (score, -ids[pivot])
                if len(heap) < k:
                    heappush(heap, entry)
                elif entry > heap[0]:
                    heapreplace(heap, entry)
        else:
            for term in live[:at]:
                if term[0] < pivot:
                    term[4] = bisect_left(term[2], pivot, term[4] + 1, term[5])
                    if term[4] < term[5]:
                        term[0] = term[2][term[4]]
                    else:
                        term[0], ended = _END, True
        live.sort(key=itemgetter(0))
        while ended and live and live[-1][0] == _END:
            live.pop()
    return scored


class _Shard:
    """Postings of the items' terms in the documents gathered so far."""

    def __init__(self, weights: np.ndarray, n_docs: int, n_terms: int):
        self.weights, self.n_docs, self.n_terms = weights, n_docs, n_terms
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.sizes = [], [], []
        self.terms, self.counts = array("i"), array("q")
        self.n = 0

    def add(self, doc_id: int | None, length: int, found: dict[int, int]) -> None:
        self.ids.append(_NO_ID if doc_id is None else doc_id)
        self.lengths.append(length)
        self.terms.extend(found)
        self.counts.extend(found.values())
        self.sizes.append(len(found))
        self.n += len(found)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_ROWS or self.n >= SHARD_POSTINGS

    def parts(self) -> Iterator[tuple[list[int], dict[int, tuple[list[int], list[int], int]]]]:
        """(ids, postings by term) of the documents of like length, the longest first: they fill the heaps with good scores."""
        order = sorted(range(len(self.ids)), key=lambda i: (-self.lengths[i], self.ids[i]))
        cuts = np.concatenate([[0], np.cumsum(self.sizes)])
        terms, counts = np.array(self.terms, np.int32), np.array(self.counts, np.int64)
        step = max(1, -(-len(order) // SHARD_PARTS))
        for a in range(0, len(order), step):
            own = order[a : a + step]
            at = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in own])
            doc = np.repeat(np.arange(len(own)), [self.sizes[i] for i in own])
            m = np.array([50 + 50 * self.lengths[i] * self.n_docs // self.n_terms for i in own], np.int64)
            term, tf = terms[at], counts[at]
            impact = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
            by_term = np.argsort(term, kind="stable")
            term, doc, impact = term[by_term], doc[by_term], impact[by_term]
            start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))[: len(term)]
            tops = np.maximum.reduceat(impact, start).tolist() if len(start) else []
            ends = [*start[1:].tolist(), len(term)]
            yield [self.ids[i] for i in own], {t: (doc[b:e].tolist(), impact[b:e].tolist(), top) for t, b, e, top in zip(term[start].tolist(), start.tolist(), ends, tops, strict=True) if top}


def _statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequencies of the vocabulary."""
    width = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms, known = Counter(), 0, 0, vocabulary.keys()
        for batch in batches:
            for text in raw(batch.column(0)):
                n, own = 0, set()
                for words in lists(text, WORDS):
                    n += len(words)
                    own.update(filter(known.__contains__, words))
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                df.update(own)
        yield pa.RecordBatch.from_arrays([pa.array([width, width + 1, *map(vocabulary.__getitem__, df)], pa.int32()), pa.array([n_docs, n_terms, *df.values()], pa.int64())], names=["term", "n"])

    out = np.zeros(width + 2, np.int64)
    for r in docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the lot
        out[r["term"]] = r["n"]
    return int(out[width]), int(out[width + 1]), out[:width]


def _searched(docs: DataFrame, items: list[list[bytes]], k: int) -> DataFrame:
    """(item, doc_id, score, scored, task): the k best documents of each task for each of a lot's items."""
    vocabulary: dict[bytes, int] = {}
    asked = [[vocabulary.setdefault(t, len(vocabulary)) for t in terms] for terms in items]
    n_docs, n_terms, df = _statistics(docs, vocabulary)
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, heaps, scored, known = _Shard(weights, n_docs, n_terms), [[] for _ in asked], [0] * len(asked), vocabulary.keys()

        def search() -> None:
            for ids, postings in shard.parts():
                for i, terms in enumerate(asked):
                    if own := [postings[t] for t in terms if t in postings]:
                        scored[i] += walk(own, ids, heaps[i], k)
            shard.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                n, found = 0, Counter()
                for words in lists(text, WORDS):
                    n += len(words)
                    found.update(filter(known.__contains__, words))
                if found:
                    shard.add(doc_id, n, {vocabulary[t]: c for t, c in found.items()})
                    if shard.full():
                        search()
        if shard.ids:
            search()
        task = TaskContext.get().partitionId()
        for i, heap in enumerate(heaps):
            if heap:
                own = [None if -x == _NO_ID else -x for _, x in heap]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(heap), pa.int32()), pa.array(own, pa.int64()), pa.array([s for s, _ in heap], pa.int64()), pa.array([scored[i]] * len(heap), pa.int64()), pa.array([task] * len(heap), pa.int32())], names=["item", "doc_id", "score", "scored", "task"])

    return docs.mapInArrow(run, _FOUND)


def _lots(items: DataFrame, lot: int, chars: int) -> Iterator[list]:
    """The items with terms in lots, as rows; one lot at a time is held by the driver."""
    held, size = [], 0
    for r in items.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        if held and (len(held) >= lot or size + len(r["text"]) > chars):
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r["text"])
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, *, k: int = 50, lot: int = 4000, lot_chars: int = 8_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    kind = dict(items.dtypes)["item_id"]
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for rows in _lots(items, lot, lot_chars):
        asked = [list(dict.fromkeys(t for part in lists(r["text"].encode(), WORDS) for t in part)) for r in rows]
        found = _searched(texts, asked, k)
        # many tasks' heaps of an item meet in parts first, so no single task reads them all
        some = found.withColumn("rank", F.row_number().over(best("item", F.col("task") % 64))).where(F.col("rank") <= k)
        ranked = some.withColumn("rank", F.row_number().over(best("item"))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        out = out.unionAll(checkpoint(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
    return out
