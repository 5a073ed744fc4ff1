"""How far apart the sources of a language are, term by term, by a baseline-corrected inverted index.

Each language keeps the terms that at least ``least`` of its documents hold. A group (language, source) gives
every kept term, with n occurrences there, the smoothed share p(n) = 1 + floor(10^9 (n + 5) / (N + 5 V)); V is the number of kept
terms, N the group's occurrences of them. Two sources differ by the sum of \\|p - q\\| over all kept terms.

That sum is never taken over terms that neither source has. Each pair starts at V times the difference of its zero
shares z = p(0). What a posting (term, source) changes against a source without the term depends on its count alone, so
postings are folded into classes (source, n) first. Terms that several sources hold then
emit, pair by pair, what is still missing: \\|p - q\\| - \\|p - z_q\\| - \\|z_p - q\\| + \\|z_p - z_q\\|, summed in each task before
anything is shuffled. The terms that mark a source against its language are ranked by windows.

All arithmetic is exact. Terms are counted once, in the tasks that read the texts, and shuffled as sums.
Null texts, languages and sources count as empty; a document without terms still makes its group; repeated rows and
ids count as they stand; a group alone in its language has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_batches
from .terms import LETTERS, lists, raw

_COUNTS = "lang string, source string, term binary, n long, docs long"
#: Counts (source, term) and sums of pairs that a task holds before it hands them on.
HELD_TERMS, HELD_PAIRS = 400_000, 1_000_000
#: Pairs of postings that are worked out at once.
LOT = 500_000


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term by source, once from each task that met it."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def emitted() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in held.items():
                names = list(n)
                for a in range(0, len(names), 65_536):
                    own = names[a : a + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.binary()), pa.array([n[t] for t in own], pa.int64()), pa.array([seen[t] for t in own], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for words in lists(text, LETTERS):
                    n.update(words)
                    own.update(words)
                seen.update(own)
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from emitted()
                    size = 0
        yield from emitted()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text")).mapInArrow(run, _COUNTS)


def share(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """p of a term with n occurrences among ``total`` of ``kept`` terms."""
    n, total, kept = (F.col(x) if isinstance(x, str) else x for x in (n, total, kept))
    whole = lambda c: c.cast("decimal(19,0)")
    above, below = whole(n + 5) * F.lit(1_000_000_000).cast("decimal(10,0)"), whole(total + 5 * kept)
    # `div` of decimals is exact: the quotient, at most 10^9, has far fewer digits than the 38 it is worked out with
    return F.call_function("div", above, F.when(below > 0, below)).cast("long") + 1


def _shared(lists_: DataFrame) -> DataFrame:
    """(lang, source, other, value): what terms of two sources or more still correct, by pair and task; source is before other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        codes, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def emitted(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal codes, sums
            own, at = np.unique(np.concatenate(codes), return_inverse=True)
            value = np.zeros(len(own), np.int64)
            np.add.at(value, at, np.concatenate(sums))
            codes, sums = [own], [value]
            if not last and len(own) <= HELD_PAIRS // 2:
                return
            who = list(names)
            for a in range(0, len(own), 65_536):
                left, right = ([who[i] for i in side.tolist()] for side in np.divmod(own[a : a + 65_536], 1 << 31))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in left]), pa.array([x[1] for x in left]), pa.array([x[1] for x in right]), pa.array(value[a : a + 65_536])], names=["lang", "source", "other", "value"])
            names.clear()
            codes, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        held = 0
        for batch in batches:
            cuts = batch.column(1).offsets.to_numpy()
            entries = batch.column(1).values
            source, p, z = entries.field("source").to_pylist(), entries.field("p").to_numpy(), entries.field("z").to_numpy()
            lang = batch.column(0).to_pylist()
            sizes = np.diff(cuts)
            for k in np.unique(sizes):
                rows = np.flatnonzero(sizes == k)
                step = max(1, LOT // int(k))
                for a in range(0, len(rows), step):
                    at = cuts[rows[a : a + step], None] + np.arange(k)
                    who = np.array([[names.setdefault((lang[r], source[i]), len(names)) for i in line] for r, line in zip(rows[a : a + step], at.tolist(), strict=True)], np.int64).reshape(at.shape)
                    ps, zs = p[at], z[at]
                    for d in range(1, int(k)):
                        pa_, pb, za, zb = ps[:, :-d], ps[:, d:], zs[:, :-d], zs[:, d:]
                        value = np.abs(pa_ - pb) - np.abs(pa_ - zb) - np.abs(za - pb) + np.abs(za - zb)
                        some = value != 0
                        codes.append(((who[:, :-d] << 31) | who[:, d:])[some])
                        sums.append(value[some])
                        held += len(codes[-1])
                        if held > 2 * HELD_PAIRS:
                            codes, sums = [np.concatenate(codes)], [np.concatenate(sums)]
                            own, inverse = np.unique(codes[0], return_inverse=True)
                            total = np.zeros(len(own), np.int64)
                            np.add.at(total, inverse, sums[0])
                            codes, sums, held = [own], [total], len(own)
            if held > HELD_PAIRS:
                yield from emitted(last=False)
                held = sum(map(len, codes))
        yield from emitted(last=True)

    return lists_.mapInArrow(run, "lang string, source string, other string, value long")


def audit(docs: DataFrame, *, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language with the distance to it, the farthest first. Part ``term``: the ``top``
    terms that the source uses more than its language does, by how much.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(text("lang").alias("lang"), text("source").alias("source")).distinct()
    by_term = Window.partitionBy("lang", "term")
    # one shuffle: a term's counts meet by (lang, term), and stay there for its documents and its total
    found = counts(docs).withColumn("term", F.col("term").cast("string")).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = found.withColumns({"docs": F.sum("docs").over(by_term), "all_n": F.sum("n").over(by_term), "first": F.min("source").over(by_term)}).where(F.col("docs") >= least)
    postings = checkpoint(found.select("lang", "term", "source", "n", "all_n", (F.col("first") == F.col("source")).alias("head")))

    languages = postings.groupBy("lang").agg(F.count_if("head").alias("kept"), F.sum("n").alias("lang_total"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(languages, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = checkpoint(groups.withColumn("z", F.coalesce(share(F.lit(0), "total", "kept"), F.lit(0))))
    held = postings.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "kept"))

    marked = held.withColumn("value", F.col("p") - share("all_n", "lang_total", "kept")).where(F.col("value") > 0)
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = marked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("other_z"))
    pairs = groups.select("lang", "source", "kept", "z").join(other, "lang").where(F.col("source") != F.col("other"))
    base = pairs.select("lang", "source", "other", (F.col("kept") * F.abs(F.col("z") - F.col("other_z"))).alias("value"))
    classes = checkpoint(held.groupBy("lang", "source", "n", "p", "z").agg(F.count("*").alias("m")))
    alone = classes.join(other, "lang").where(F.col("source") != F.col("other")).withColumn("value", F.col("m") * (F.abs(F.col("p") - F.col("other_z")) - F.abs(F.col("z") - F.col("other_z"))))
    alone = alone.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    several = held.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "z"))).alias("sources")).where(F.size("sources") > 1)
    both = checkpoint(_shared(several.select("lang", "sources")).groupBy("lang", "source", "other").agg(F.sum("value").alias("value")))
    flipped = lambda df: df.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    alone = checkpoint(alone)
    value = base.unionAll(alone).unionAll(flipped(alone)).unionAll(both.select(base.columns)).unionAll(flipped(both)).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    distances = value.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(by_group))
    return distances.unionByName(terms)
