"""Language identification by hyperdimensional profiles.

Every letter of any script, and the space between words, has a random vector of +1
and -1, drawn by its code point. A letter trigram binds them: the first rotated twice, the second once, the third as it is,
multiplied. A text or a language bundles (adds) its trigrams' vectors. A text is given the language
whose centred prototype has the largest cosine. Because bundling is a sum, prototypes are learnt from
every labelled text in one pass: tasks add trigram counts by language, and a few vectors remain.

``admit`` keeps what is written in a learnt language: unrelated bundles have cosines of
about 1 / sqrt(DIM) with any prototype by chance, so a text whose cosine with every plain prototype is below ``chance`` times that is in none.
Texts of fewer than ``BRIEF`` distinct trigrams (a few words) tell too little to be refused.

A text that is null or has no letter is ``und`` with score 0, as is every text when nothing was
learnt. Rows with a null label are not learnt from. Equal cosines go to the first language by name.
Texts are read whole, in pieces; repeated rows and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches

DIM = 1024
PIECE = 1_000_000
HELD = 4_096  # sums by language that a task holds before it hands them on
BRIEF = 50


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), bool, 0x110000)


@lru_cache(1 << 14)
def letter(code_point: int) -> np.ndarray:
    """The vector of a letter; 0 stands for what lies between words."""
    return np.random.default_rng([20, code_point]).choice(np.array([-1, 1], np.int8), DIM)


def symbols(text: str) -> np.ndarray:
    """Letters of a whole text between two spaces; what lies between words is one space."""
    parts = [np.zeros(1, np.uint32)]
    for i in range(0, len(text), PIECE):
        raw = np.frombuffer(text[i : i + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        parts.append(raw * _is_letter()[raw])
    all_ = np.concatenate([*parts, np.zeros(1, np.uint32)])
    return all_[np.append(True, (all_[1:] != 0) | (all_[:-1] != 0))]


@dataclass(frozen=True)
class Trigrams:
    """Counts [row, code] of the trigrams of some rows; a code is three places in the alphabet, which is sorted."""

    alphabet: np.ndarray
    codes: np.ndarray
    counts: np.ndarray


def trigram_counts(texts: list[str], rows: np.ndarray, n: int) -> Trigrams:
    """Trigrams by the row, of n, that each text belongs to."""
    read = [symbols(t) for t in texts]
    alphabet = np.unique(np.concatenate([*read, np.zeros(1, np.uint32)]))
    k = len(alphabet)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def add() -> None:
        """Distinct (code, row) of what is held, with counts."""
        code, row = (np.concatenate(x) for x in zip(*held, strict=True))
        if k**3 * n < 2**62:  # sorting one number each is several times as fast
            key = np.sort(code * n + row)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            code, row = np.divmod(key[first], n)
            found.append((code, row, np.diff(np.append(first, len(key)))))
        else:
            order = np.lexsort((row, code))
            code, row = code[order], row[order]
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])))
            found.append((code[first], row[first], np.diff(np.append(first, len(code)))))
        held.clear()

    for s, row in zip(read, rows, strict=True):
        p = np.searchsorted(alphabet, s).astype(np.int64) if k > 256 else _place(alphabet, s)
        for i in range(0, max(0, len(p) - 2), PIECE):
            q = p[i : i + PIECE + 2]
            held.append(((q[:-2] * k + q[1:-1]) * k + q[2:], np.full(len(q) - 2, row)))
            if sum(len(x) for x, _ in held) >= PIECE:
                add()
    if held:
        add()
    if not found:
        return Trigrams(alphabet, np.zeros(0, np.int64), np.zeros((n, 0), np.float32))
    code, row, count = (np.concatenate(x) for x in zip(*found, strict=True))
    codes, at = np.unique(code, return_inverse=True)
    counts = np.bincount(row * len(codes) + at, count, n * len(codes)).reshape(n, -1).astype(np.float32)
    return Trigrams(alphabet, codes, counts)


def _place(alphabet: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Places in a small alphabet, by a table as long as its largest letter."""
    table = np.zeros(int(alphabet[-1]) + 1, np.int64)
    table[alphabet] = np.arange(len(alphabet))
    return table[s]


def bundle(t: Trigrams) -> np.ndarray:
    """[row, DIM]: the sum of each row's bound trigrams."""
    out, k = np.zeros((len(t.counts), DIM), np.float32), len(t.alphabet)
    base = np.stack([letter(int(x)) for x in t.alphabet])
    first, second = np.roll(base, 2, 1), np.roll(base, 1, 1)
    for i in range(0, len(t.codes), 4096):
        c = t.codes[i : i + 4096]
        out += t.counts[:, i : i + 4096] @ (first[c // k**2] * second[c // k % k] * base[c % k]).astype(np.float32)
    return out


@dataclass(frozen=True)
class Profiles:
    names: tuple[str, ...]
    centre: np.ndarray
    prototypes: np.ndarray  # centred, of length one
    plain: np.ndarray  # of length one


def fit(labelled: DataFrame, *, text_col: str = "text", label_col: str = "lang") -> Profiles:
    """Prototypes from all rows with a label; one vector of 1,024 numbers for each language reaches the driver and every task."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("name"), F.col(text_col).alias("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def emitted() -> Iterator[pa.RecordBatch]:
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["name", "v"])
            sums.clear()

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            known = sorted(set(names))
            for k in range(0, len(known), 16):
                some = {x: i for i, x in enumerate(known[k : k + 16])}
                picked = [i for i, x in enumerate(names) if x in some]
                got = bundle(trigram_counts([texts[i] for i in picked], np.array([some[names[i]] for i in picked]), len(some)))
                for x, i in some.items():
                    sums[x] = sums.get(x, 0) + got[i].astype(np.float64)
                if len(sums) > HELD:
                    yield from emitted()
        yield from emitted()

    sums = rows.mapInArrow(add, "name string, v array<double>")
    got = sums.select("name", F.posexplode("v").alias("i", "x")).groupBy("name", "i").agg(F.sum("x").alias("x"))
    vectors = {r["name"]: r["v"] for r in got.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v")).collect()}
    names = tuple(sorted(x for x, v in vectors.items() if any(v)))
    if not names:
        return Profiles((), np.zeros(DIM), np.zeros((0, DIM)), np.zeros((0, DIM)))
    p = np.array([vectors[x] for x in names])
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    centre = p.mean(0) if len(names) > 1 else np.zeros(DIM)
    own = p - centre
    return Profiles(names, centre, own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12), p)


def label(texts: list[str], p: Profiles) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, margin over the second language, and largest cosine with a plain prototype of each text (2 where nothing was learnt, or the text is brief)."""
    t = trigram_counts(texts, np.arange(len(texts)), len(texts))
    none = t.counts.sum(1) == 0
    if not p.names:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.where(none, 0.0, 2.0)
    v = bundle(t)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    like = np.where((t.counts > 0).sum(1) < BRIEF, 2.0, (v @ p.plain.T).max(1))
    v = v - p.centre
    cos = (v @ p.prototypes.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    top = np.sort(cos, axis=1)
    margin = top[:, -1] - (top[:, -2] if len(p.names) > 1 else -1)
    names = ["und" if x else p.names[i] for x, i in zip(none, cos.argmax(1), strict=True)]
    return names, np.where(none, 0, np.clip((1 + top[:, -1]) / 2, 0, 1)), np.where(none, 0, margin), np.where(none, 0, like)


def _labelled(column: pa.Array, p: Profiles) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    texts, names, figures = [t or "" for t in column.to_pylist()], [], [np.zeros((3, 0))]
    for a, b in pieces(texts, 200_000):
        for i in range(a, b, 64):
            x, *own = label(texts[i : min(b, i + 64)], p)
            names += x
            figures.append(np.stack(own))
    return names, *np.concatenate(figures, 1)


def predict(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, margin) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, margins, _ = _labelled(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(margins)], names=[id_col, "lang_pred", "score", "margin"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, lang_pred string, score double, margin double")


def admit(docs: DataFrame, profiles: Profiles, *, text_col: str = "text", languages: tuple[str, ...] | None = None, chance: float = 3.5) -> DataFrame:
    """The rows, with all columns, whose text is in a learnt language: in one of ``languages``, if given.

    Where nothing could be learnt, texts with a letter stay.
    """
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(profiles), docs.columns.index(text_col)
    least = chance / DIM**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, _, like = _labelled(batch.column(at), shared.value)
            good = [s >= least and (languages is None or x in languages) for x, s in zip(names, like, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
