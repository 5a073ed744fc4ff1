"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text becomes lower-cased words and runs of signs. Features are hashed unigrams and bigrams, and
trigrams of word classes (case, digits, signs, equal to the word before), each family a vector of
length one. ``fit`` deals a bounded sample of labelled rows over shards; each shard makes a few
passes of per-coordinate FTRL-proximal updates, and the shards' weights are averaged. ``score`` is
one sparse dot product a text, in the scan's own tasks: no shuffle.

Null and empty texts have the bias alone. Rows with a null label are not learnt from. With no
labelled rows, or none of one class, scores come from the bias learnt so far (0.5 without any row).
Repeated rows count as often as they occur; columns other than those named are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, held_out, pieces, sampled, small_batches

BITS = 18
SIZE = 1 << BITS
BIAS = SIZE  # the last weight
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class Tokens:
    """Hash and class of each token of a text."""

    def __init__(self):
        self.known = Remembered(lambda w: zlib.crc32(w.lower().encode("utf-8", "replace")) << 3 | self.kind(w))

    def __call__(self, text: str) -> np.ndarray:
        self.known.trim()
        words = _TOKEN.findall(text)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    @staticmethod
    def kind(word: str) -> int:
        if word.isdigit():
            return 1
        if not word[0].isalnum():
            return 2 if len(word) == 1 else 3
        if word.isupper():
            return 4 if len(word) > 1 else 5
        return 6 if word[0].isupper() else 7


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[str], tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all texts, by row; each family of a row has length one."""
    packed = [tokens(t) for t in texts]
    sizes = np.fromiter(map(len, packed), np.int64, len(packed))
    all_ = np.concatenate([*packed, np.zeros(0, np.int64)])
    row = np.repeat(np.arange(len(texts)), sizes)
    word, kind = all_ >> 3, all_ & 7
    pair = row[1:] == row[:-1]
    same = np.zeros(len(word), np.int64)
    same[1:] = pair & (word[1:] == word[:-1])
    kind = kind * 2 + same
    two = (word[:-1] * 31 + word[1:] * 1_000_003)[pair]
    triple = row[2:] == row[:-2]
    three = (kind[:-2] * 256 + kind[1:-1] * 16 + kind[2:])[triple]
    out = []
    for rows, ids in ((np.concatenate([row, row[1:][pair]]), np.concatenate([_mix(word, 1), _mix(two, 2)])), (row[2:][triple], _mix(three, 3))):
        key, counts = np.unique(rows << BITS | ids, return_counts=True)
        at, value = key >> BITS, np.log1p(counts)
        norm = np.sqrt(np.bincount(at, value * value, len(texts)))
        out.append((at, key & (SIZE - 1), value / norm[at]))
    row, feature, value = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order]


@dataclass(frozen=True)
class Rates:
    """FTRL-proximal parameters and passes over a shard."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.005
    l2: float = 0.01
    passes: int = 16


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rates: Rates) -> np.ndarray:
    """Weights after ``passes`` over the rows in their order; the last one is the bias."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(i):
        zi = z[i]
        return -np.sign(zi) * np.maximum(np.abs(zi) - rates.l1, 0) / ((rates.beta + np.sqrt(n[i])) / rates.alpha + rates.l2)

    for _ in range(rates.passes):
        for (ids, x), y in zip(rows, labels, strict=True):
            w = weights(ids)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / rates.alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    return weights(np.arange(SIZE + 1))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = 20_000, shards: int = 4, rates: Rates | None = None) -> np.ndarray:
    """Weights from about ``bound`` labelled rows at most; only they (2^18 + 1 numbers) reach the driver."""
    rates = rates or Rates()
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("double").alias("y"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(shards)).cast("int"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "y"], kind="stable")
        order = np.random.default_rng(7).permutation(len(group))
        tokens, out = Tokens(), []
        texts = group["text"].tolist()
        for a, b in pieces(texts):
            row, ids, x = features(texts[a:b], tokens)
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            out += [(np.append(ids[i:j], BIAS), np.append(x[i:j], 1.0)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        w = ftrl([out[i] for i in order], group["y"].to_numpy()[order], rates)
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": at.astype(np.int64), "weight": w[at]})

    got = rows.groupBy("shard").applyInPandas(learn, "feature long, weight double").groupBy("feature").agg((F.sum("weight") / shards).alias("weight")).toPandas()
    model = np.zeros(SIZE + 1)
    model[got["feature"].to_numpy(np.int64)] = got["weight"].to_numpy()
    return model


def score(docs: DataFrame, model: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the chance that its label is 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, tokens = shared.value, Tokens()
        for batch in batches:
            texts, parts = [t or "" for t in batch.column(1).to_pylist()], []
            for a, b in pieces(texts):
                row, ids, x = features(texts[a:b], tokens)
                parts.append(np.bincount(row, w[ids] * x, b - a) + w[BIAS])
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([*parts, np.zeros(0)]), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=[id_col, "score"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, score double")


def training_rows(docs: DataFrame, labels: DataFrame, *, bound: int = 20_000, label_col: str = "quality") -> DataFrame:
    """Labelled rows outside the held-out fifth, about ``bound`` at most.

    Equal label rows are one. The bound holds for rows, not for ids: an id with many labels, or many documents, is
    sampled row by row, so what is broadcast and learnt from stays bounded.
    """
    learn = labels.where(~held_out() & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label_col).distinct()
    few = sampled(learn, F.xxhash64("doc_id", label_col), bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").withColumn("__at", F.monotonically_increasing_id())
    return sampled(rows, "__at", 2 * bound).drop("__at")
