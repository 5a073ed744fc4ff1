"""SimHash near-duplicates: fingerprints, then a binary trie joined with itself.

Fingerprints are the majority bits of the 64-bit hashes of all word shingles. Two of them within
``budget`` = 2 bits differ in at most two of six blocks of 10 or 11 bits, so they agree on four.
For each of the 15 choices of four blocks a binary trie over the bits, the chosen blocks first, is
cut below those blocks: pairs under different nodes there have spent their error budget on this
trie, and another of the 15 has them. (The cut is what distributes the tries: 42 to 44 bits are settled by the
node's key, and the traversal of pairs decides the other 20 to 22.) The subtrees (at most 2^22 fingerprints, as they are distinct)
are dealt over the cluster; in each, node pairs are traversed together, one bit a step, adding the
bits in which they differ and dropping pairs over the budget. A subtree reports at most one link for
each of its fingerprints, to the root of a local union, so that no group is expanded into pairs.
Components of the links give the groups.

Exact copies meet as one fingerprint before the join, counted on the map side. Null and empty texts
have fingerprint zero, and are linked by it like any other. A null id is in its group but never names
it, unless all ids of the group are null. Very long texts are hashed in pieces of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, row_key, small_batches, unused
from .components import components

SEED = 42
WORDS = 3
BUDGET = 2
#: First bit and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TRIES = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - BUDGET))


def _mask(block: int) -> int:
    at, width = BLOCKS[block]
    return ((1 << width) - 1) << at


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 majority bits over the XXH64 (seed 42) of the shingles of one text; repeats count."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    whole = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    start = np.cumsum(size + 1) - size - 1
    stop = start[words - 1 :] + size[words - 1 :]
    digest, n, step = xxhash.xxh64_intdigest, len(stop), 1 << 16
    ones = np.zeros(64, np.int64)
    for i in range(0, n, step):
        spans = zip(start[i : i + step].tolist(), stop[i : i + step].tolist(), strict=False)
        h = np.array([digest(whole[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or "", words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int8)


def trie_links(fps: np.ndarray, budget: int = BUDGET, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) links among distinct ``fps`` by traversing pairs of trie nodes together.

    A node is a run of the sorted fingerprints with a common prefix. A pair of nodes (a node with
    itself too) becomes the pairs of their children one bit lower; bits that differ are added to the
    pair's errors, and pairs over ``budget`` go. Bits in which no fingerprint differs are passed over. Pairs wait
    on a stack in lots of at most ``most``, so memory stays bounded however many pairs there are.
    """
    fps = np.sort(fps)
    n = len(fps)
    parent = np.arange(n)

    def union(a: np.ndarray, b: np.ndarray) -> None:
        """Least label to both ends of each pair until nothing changes."""
        while True:
            ra, rb = parent[a], parent[b]
            if (ra == rb).all():
                return
            low = np.minimum(ra, rb)
            np.minimum.at(parent, ra, low)
            np.minimum.at(parent, rb, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up

    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in range(63, -1, -1) if differ >> b & 1]
    stack = [(0, *(np.array([x]) for x in (0, n, 0, n)), np.zeros(1, np.int8))]
    while stack:
        level, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > most:
            for i in range(0, len(a0), most):
                stack.append((level, *(x[i : i + most] for x in (a0, a1, b0, b1, spent))))
            continue
        if level == len(bits):
            union(a0, b0)
            continue
        bit = np.uint64(1 << bits[level])
        # where each run turns from 0 to 1 in this bit: the count of zeros before, as the run is sorted in it
        zeros = np.concatenate([[0], np.cumsum((fps & bit) == 0)])
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        own = (a0 == b0) & (a1 == b1)
        down = [
            (a0, am, b0, bm, spent, np.ones(len(own), bool)),
            (am, a1, bm, b1, spent, np.ones(len(own), bool)),
            (a0, am, bm, b1, spent + 1, spent < budget),
            (am, a1, b0, bm, spent + 1, (spent < budget) & ~own),
        ]
        kept = [[x[k] for x in (c0, c1, d0, d1, s)] for c0, c1, d0, d1, s, ok in down for k in [ok & (c0 < c1) & (d0 < d1)]]
        nxt = [np.concatenate(x) for x in zip(*kept, strict=True)]
        one = (nxt[1] - nxt[0] == 1) & (nxt[3] - nxt[2] == 1)  # two leaves: the rest at once
        if one.any():
            x, y = nxt[0][one], nxt[2][one]
            near = (x != y) & (_popcount(fps[x] ^ fps[y]) <= budget)
            union(x[near], y[near])
            nxt = [v[~one] for v in nxt]
        if len(nxt[0]):
            stack.append((level + 1, *nxt))
    at = np.flatnonzero(parent != np.arange(n))
    return fps[at], fps[parent[at]]


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v) links that connect all fingerprints (column fp, distinct) within ``budget`` bits of each other."""
    if budget != BUDGET:
        raise ValueError(f"the blocks are laid out for a budget of {BUDGET}")
    keys: list[Column] = [F.struct(F.lit(i).alias("trie"), F.col("fp").bitwiseAND(F.lit(_signed(sum(map(_mask, t))))).alias("prefix")) for i, t in enumerate(TRIES)]
    trees = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).groupBy("k").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            cuts, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
            got = [trie_links(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            u, v = (np.concatenate([*x]).view(np.int64) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return trees.select("fps").mapInArrow(run, "u long, v long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp, fingerprint, component_id) of every row; the component is named by its least id."""
    prints = checkpoint(fingerprints(docs, id_col=id_col, text_col=text_col, words=words))
    classes = checkpoint(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    rooted = components(links(classes.select("fp"))).select(F.col("node").alias("fp"), "root")
    named = classes.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # only linked fingerprints need their group's least id; the others have their own
    linked = named.join(rooted.select("fp"), "fp", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(linked, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(ids, "fp").select(id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each group with all columns: the one with the least id, one without an id only where the group has no other."""
    name = unused(docs, "row_key")
    keyed = docs.withColumn(name, row_key(id_col, text_col))
    order = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(name).alias("row"))
    found = groups(keyed.select(order.alias("order_key"), F.col(text_col).alias("whole")), id_col="order_key", text_col="whole", words=words)
    kept = found.where(F.col("order_key.row") == F.col("component_id.row")).select(F.col("order_key.row").alias(name))
    counts = kept.groupBy(name).count().agg(F.max("count")).first()[0]
    rows = keyed.join(kept.distinct(), name, "left_semi")
    if counts and counts > 1:  # equal id and text more than once: the first by all its columns; elsewhere this would change nothing
        whole = F.struct(*docs.columns)
        return rows.groupBy(name).agg(F.min_by(whole, F.to_json(whole)).alias("one")).select("one.*")
    return rows.select(*docs.columns)
