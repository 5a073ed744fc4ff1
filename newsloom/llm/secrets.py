"""Secret scans: fixed shapes, and a randomness test battery with false-discovery control.

Base spans are the matches of three fixed shapes. The battery looks at every other long run of key
characters, whole and in the parts between its separators, and at what is left of runs around base spans. The encoding of a
part is inferred (digits, hex, base32, base36, base62, base64, or one of them in groups set off by hyphens or underscores)
from the characters that occur. Under the hypothesis of independent uniform characters it computes
a chi-squared test of the alphabet, a runs test about the median and a serial-correlation test, and combines the
three p-values by Fisher's method. Passing says little about a short run,
so the p-value of a discovery is a bound on how often ordinary text looks so random: the likelihood ratio of letters
and digits as they come in text to uniform characters, which shrinks with the length, divided by the battery's
combined p-value, as what fails the battery is not random however unlike text it is. All parts of all documents go through Benjamini and Hochberg's
procedure on these p-values, weighted by length: one pass counts them in narrow classes, a second applies the limit
that follows. Of parts that overlap the least p-value stays. Findings are spans of kind ``random``.

Null texts are empty; texts of any length are scanned whole; spans are code points, end exclusive.
Repeated rows count as often as they occur; empty tables and further columns need no care.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PART = re.compile(r"[A-Za-z0-9+/_-]{20,}")
LEAST = 20  # characters of a part
EXACT = 128  # characters up to which the runs test counts all orders
#: Separators at which a run is also read in parts, coarse ones first.
_SPLITS = (re.compile(r"[^/]+"), re.compile(r"[^/+]+"), re.compile(r"[^_/+]+"), re.compile(r"[^-/+]+"), re.compile(r"[^-_/+]+"))
_GROUPED = re.compile(r"[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)+")
#: Width of the classes of log p-values in which parts are counted.
CLASS = 0.1
FDR = 0.001
#: Rough shares of a to z in running text of European languages, in per mille.
_LETTERS = (80, 12, 30, 38, 125, 18, 20, 35, 75, 3, 6, 45, 26, 72, 70, 22, 5, 68, 68, 80, 30, 12, 14, 2, 15, 4)
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three fixed shapes, leftmost and non-overlapping within each kind."""
    out = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    for run in _LONG.finditer(text):
        for kind, shape in (("access", _ACCESS), ("hex", _HEX)):
            out += [(*m.span(), kind) for m in shape.finditer(text, *run.span())]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding(run: str) -> str | None:
    """The smallest alphabet that holds every character; None if none does."""
    own = set(run)
    return next((k for k, a in ALPHABETS.items() if own <= set(a)), None)


def _chi2_upper(x: float, k: int) -> float:
    """Upper tail of chi-squared by Wilson and Hilferty's cube root."""
    z = ((x / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(1 << 16)
def _runs_tail(a: int, b: int, runs: int) -> float:
    """Chance that ``a`` high and ``b`` low characters in random order have runs at least so far from their mean: exact up to EXACT characters, else normal."""
    n = a + b
    if not (a and b):
        return 2.0 ** (1 - n)  # all on one side of the median
    mean = 1 + 2 * a * b / n
    if n > EXACT:
        var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        return math.erfc(abs(runs - mean) / math.sqrt(2 * max(var, 1e-9)))
    ways = 0
    for r in range(2, n + 1):
        if abs(r - mean) >= abs(runs - mean) - 1e-9:
            k, odd = divmod(r, 2)
            ways += math.comb(a - 1, k) * math.comb(b - 1, k - 1) + math.comb(a - 1, k - 1) * math.comb(b - 1, k) if odd else 2 * math.comb(a - 1, k - 1) * math.comb(b - 1, k - 1)
    return ways / math.comb(n, a)


def battery(run: str, alphabet: str) -> tuple[float, float, float]:
    """Two-sided for runs and serial correlation, upper tail for chi-squared: three p-values under uniform characters."""
    x = np.array([alphabet.index(c) for c in run], float)
    n, k = len(x), len(alphabet)
    counts = np.bincount(x.astype(int), minlength=k)
    chi = _chi2_upper(float(((counts - n / k) ** 2).sum() * k / n), k - 1)
    high = x >= k / 2
    p_runs = _runs_tail(int(high.sum()), int(n - high.sum()), 1 + int((high[1:] != high[:-1]).sum()))
    y = x - x.mean()
    spread = float(y @ y)
    r = float(y[1:] @ y[:-1]) / spread if spread else 1.0
    p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    return chi, min(1.0, p_runs), min(1.0, p_serial)


def combined(p: tuple[float, ...]) -> float:
    """Fisher's method: upper tail of chi-squared with two degrees of freedom for each p-value."""
    x = -sum(math.log(max(v, 1e-300)) for v in p)
    term = total = 1.0
    for i in range(1, len(p)):
        term *= x / i
        total += term
    return min(1.0, math.exp(-x) * total)


def text_log_bound(run: str, alphabet: str) -> float:
    """Log of a bound on how often a word-like run looks so much more uniform than text: one over the likelihood ratio.

    The model of text: runs of letters, digits and signs seldom change into each other, letters come
    with their usual shares, vowels and consonants alternate, and capitals open words.
    """
    ratio, kind, before = 0.0, "", ""
    total = sum(_LETTERS)
    for c in run:
        now = "a" if c.isalpha() else "0" if c.isdigit() else "-"
        if now == "a":
            p = _LETTERS[ord(c.lower()) - 97] / total
            if kind == "a":
                vowel = c.lower() in "aeiouy"
                p *= {(True, True): 0.5, (True, False): 1.3, (False, True): 1.4, (False, False): 0.75}[before.lower() in "aeiouy", vowel]
                p *= (0.05 if c.isupper() else 0.95) if before.islower() else (0.4 if c.isupper() else 0.6)
            else:
                p *= 0.5
        else:
            p = 0.1 if now == "0" else 0.25
        if kind:
            p *= {("a", "a"): 0.93, ("a", "0"): 0.02, ("a", "-"): 0.05, ("0", "0"): 0.85, ("0", "a"): 0.08, ("0", "-"): 0.07, ("-", "a"): 0.75, ("-", "0"): 0.2, ("-", "-"): 0.05}[kind, now]
        else:
            p *= 1 / 3
        ratio -= math.log(p * len(alphabet))
        kind, before = now, c
    return -max(0.0, ratio)


def parts(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans of runs outside ``taken``, whole and between separators."""
    out = set()
    closed: list[list[int]] = []  # what is taken, in order and without overlaps
    for a, b, _ in sorted(taken):
        if closed and a <= closed[-1][1]:
            closed[-1][1] = max(closed[-1][1], b)
        else:
            closed.append([a, b])
    first = 0
    for m in _PART.finditer(text):
        free, at = [], m.start()
        while first < len(closed) and closed[first][1] <= at:
            first += 1
        for i in range(first, len(closed)):
            a, b = closed[i]
            if a >= m.end():
                break
            free.append((at, a))
            at = max(at, b)
        for a, b in [*free, (at, m.end())]:
            if b - a >= LEAST:
                out.add((a, b))
                for split in _SPLITS:
                    out |= {p.span() for p in split.finditer(text, a, b) if p.end() - p.start() >= LEAST}
    return sorted(out)


def discovery(run: str) -> float | None:
    """Log p-value of a part as a discovery, the least over its readings times their number; None if it has no encoding."""
    readings = [run]
    if _GROUPED.fullmatch(run):
        readings.append(re.sub("[-_]", "", run))
    found = []
    for own in readings:
        name = encoding(own)
        if len(own) >= LEAST and name not in (None, "digits"):
            found.append(min(0.0, text_log_bound(own, ALPHABETS[name]) - math.log(max(combined(battery(own, ALPHABETS[name])), 1e-300))))
    return min(0.0, min(found) + math.log(len(found))) if found else None


def tested(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[float, int, int]]:
    """(log p, start, end) of all parts with an encoding."""
    return [(p, a, b) for a, b in parts(text, taken) for p in [discovery(text[a:b])] if p is not None]


def _class(p: float, length: int) -> int:
    return math.floor((p - math.log(length)) / CLASS)


@dataclass(frozen=True)
class Limit:
    """The last class of p-values by length that passes."""

    last: float = -math.inf

    @staticmethod
    def of(counts: dict[int, int], length: int, fdr: float = FDR) -> Limit:
        """By counts of parts in classes, and their length together; a class counts with its upper end."""
        n, seen, last = sum(counts.values()), 0, -math.inf
        for k in sorted(counts):
            seen += counts[k]
            if (k + 1) * CLASS + math.log(length / n) <= math.log(fdr * seen / n):
                last = k
        return Limit(last)


def limit(docs: DataFrame, *, text_col: str = "text", fdr: float = FDR) -> Limit:
    """The limit for all parts of all texts; a few thousand classes at most reach the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, list[int]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and _PART.search(text):
                    for p, a, b in tested(text, base_spans(text)):
                        own = counts.setdefault(max(_class(p, b - a), -100_000), [0, 0])
                        own[0] += 1
                        own[1] += b - a
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), *(pa.array([v[i] for v in counts.values()], pa.int64()) for i in (0, 1))], names=["class", "n", "length"])

    got = docs.select(F.col(text_col).cast("string").alias("__text")).mapInArrow(run, "class long, n long, length long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()
    return Limit.of({r["class"]: r["n"] for r in got}, sum(r["length"] for r in got), fdr) if got else Limit()


def random_spans(text: str, taken: list[tuple[int, int, str]], passed: Limit | None = None) -> list[tuple[int, int, str]]:
    """Spans of kind ``random`` outside ``taken`` that pass the limit, else the one of this text alone."""
    found = tested(text, taken)
    if not found:
        return []
    if passed is None:
        passed = Limit.of(Counter(_class(p, b - a) for p, a, b in found), sum(b - a for _, a, b in found))
    out: list[tuple[int, int, str]] = []
    covered = bytearray(len(text))
    for p, a, b in sorted(found):
        if max(_class(p, b - a), -100_000) <= passed.last and covered.find(1, a, b) < 0:
            covered[a:b] = b"\1" * (b - a)
            out.append((a, b, "random"))
    return sorted(out)


def scan_text(text: str | None, passed: Limit | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    text = text or ""
    base = base_spans(text)
    return base, random_spans(text, base, passed)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def redact_text(text: str | None, passed: Limit | None = None) -> str | None:
    """The text with every finding replaced by a mark that names its kind; overlapping spans become one."""
    if not text:
        return text
    base, more = scan_text(text, passed)
    spans = sorted(base + more)
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind} removed]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts by kind, base_sha256, joined spans) of every row."""
    passed = limit(docs, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan_text(t, passed) for t in batch.column(1).to_pylist()]
            n = {k: [sum(s[2] == k for s in base + more) for base, more in got] for k in KINDS}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got], pa.string()), pa.array([joined(b + m) for b, m in got], pa.string())],
                names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redact(docs: DataFrame, *, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with findings replaced in the text, and ``size_col`` renewed where it changed."""
    passed = limit(docs, text_col=text_col)
    order = [c for c in docs.columns if c != text_col] + [text_col]
    rows = docs.select(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([redact_text(t, passed) for t in batch.column(batch.num_columns - 1).to_pylist()], batch.schema.field(batch.num_columns - 1).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], schema=batch.schema)

    out = rows.mapInArrow(run, rows.schema).select(*docs.columns)
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.coalesce(F.char_length(text_col).cast(dict(docs.dtypes)[size_col]), F.col(size_col)))
    return out
