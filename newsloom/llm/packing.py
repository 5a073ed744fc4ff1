"""Variable-capacity best-fit packing of token sequences.

A sequence of c tokens costs ``overhead`` + c + c^2 / ``quadratic``: attention makes long sequences dearer
for each token, set-up makes short ones dearer, so no size is best for all contents. Pieces are dealt
over shards by a hash of a number that every row gets before, so a task holds a bounded number of (id, length) rows,
whatever their ids, and never a text.

Each shard is packed longest first: a piece goes to the open bin with the least room that holds it, else
a bin is opened; at the end each bin is downsized to the smallest capacity that holds its contents. The
permitted capacities are optimised jointly. One plan opens the size of least cost for each token that
it can be filled with, by the pieces that are still to come and fit the room (they come in falling order),
less what open bins will take. Others name a size for each class of pieces (those that fit the smallest capacity, those that need
the next ...): from every plan with one size, one class at a time is given the size that lowers the cost of the whole
shard most, until no change does. The shard keeps the plan of least cost, so it is never worse than any one size.

Lengths that are null or negative count as 0 and are kept; longer ones than the largest capacity
are cut into full pieces and a rest, nothing is dropped. Ties go to the smaller id, null ids first.
Repeated rows are packed each time they occur. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

CAPACITIES = (512, 1024, 2048, 4096)
#: Tokens that a sequence costs besides its length (padding to the batch, attention set-up).
OVERHEAD = 128
#: Length at which attention costs as much as all the rest.
QUADRATIC = 8192
#: How much of the estimated filling the joint plans count on.
TRUST = (1.0, 0.75)


def cost(capacity: float, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> float:
    return overhead + capacity + capacity * capacity / quadratic


def _best_fit(lengths: list[int], open_size: Callable[[int, int, int], int], largest: int) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece, offset in it, and contents of each bin; lengths in falling order. ``open_size`` gets place, length, room open so far."""
    room: list[list[int]] = [[] for _ in range(largest + 1)]
    mask = free = 0  # mask: bit r is set if some bin has room r; free: their rooms together
    bins: list[int] = []
    where, offset = [], []
    for i, n in enumerate(lengths):
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            b, r = len(bins), open_size(i, n, free)
            bins.append(0)
            free += r
        where.append(b)
        offset.append(bins[b])
        bins[b] += n
        r -= n
        free -= n
        room[r].append(b)
        mask |= 1 << r
    return where, offset, bins


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> tuple[list[int], list[int], list[int], list[int]]:
    """(bin of each piece, offset, contents of each bin, capacity of each bin) of the cheapest plan; lengths fall."""
    caps = tuple(sorted(capacities))
    price = {c: cost(c, overhead, quadratic) for c in caps}
    rising = lengths[::-1]
    below = np.concatenate([[0], np.cumsum(rising, dtype=np.int64)]).tolist()  # tokens in the shortest pieces

    def fitting(n: int) -> int:
        return next(c for c in caps if c >= n)

    def joint(trust: float) -> Callable[[int, int, int], int]:
        def choose(i: int, n: int, free: int) -> int:
            left = len(lengths) - i - 1  # pieces still to come: the shortest ``left`` ones
            best = None
            for c in caps:
                if c < n:
                    continue
                fits = below[min(left, bisect_right(rising, c - n))]
                fill = n + trust * min(c - n, max(0, fits - free))
                end = fitting(fill)  # what is not filled will be cut away
                each = price[end] / max(1, fill)
                if best is None or each < best[0]:
                    best = (each, c)
            return best[1]

        return choose

    best: tuple | None = None

    def tried(plan: Callable[[int, int, int], int]) -> float:
        nonlocal best
        where, offset, bins = _best_fit(lengths, plan, caps[-1])
        size = [fitting(x) for x in bins]
        total = sum(price[c] for c in size)
        if best is None or total < best[0]:
            best = (total, where, offset, bins, size)
        return total

    known: dict[tuple[int, ...], float] = {}

    def by_class(sizes: tuple[int, ...]) -> float:
        if sizes not in known:
            known[sizes] = tried(lambda i, n, free: sizes[bisect_left(caps, n)])
        return known[sizes]

    for trust in TRUST:
        tried(joint(trust))
    for c in caps:
        now = tuple(max(c, own) for own in caps)
        while True:
            steps = [now[:k] + (other,) + now[k + 1 :] for k in range(len(caps)) for other in caps[k:]]
            least = min(steps, key=by_class)
            if by_class(least) >= by_class(now):
                break
            now = least
    return best[1:]


def pack(items: DataFrame, *, id_col: str = "doc_id", length_col: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, quadratic: int = QUADRATIC, shard_rows: int = 8_192) -> DataFrame:
    """(id, piece, start, length, bin_id, offset, capacity, used): where each piece of each item goes."""
    largest = max(capacities)
    length = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))
    # numbers are written down with their rows, so a task that runs again deals them alike
    rows = checkpoint(items.select(F.col(id_col).alias("id"), length.alias("n"), F.monotonically_increasing_id().alias("row")))
    last = F.greatest(F.ceil(F.col("n") / largest).cast("int") - 1, F.lit(0))
    pieces = rows.agg(F.sum((last + 1).cast("long"))).first()[0] or 0
    shards = max(1, math.ceil(pieces / shard_rows))
    cut = rows.select("id", "row", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    cut = cut.select("id", "row", "piece", (F.col("piece") * F.lit(largest).cast("long")).alias("start"), F.least(F.col("n") - F.col("piece") * F.lit(largest), F.lit(largest)).cast("int").alias("length"), F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int").alias("shard"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id", "piece", "row"], ascending=[False, True, True, True], kind="stable", na_position="first")
        where, offset, used, size = pack_lengths(group["length"].tolist(), capacities, overhead, quadratic)
        at = np.array(where)
        return pd.DataFrame({"id": group["id"].array, "piece": group["piece"].array, "start": group["start"].array, "length": group["length"].array, "bin_id": [f"{key[0]}-{b}" for b in where], "offset": np.array(offset, np.int32), "capacity": np.array(size, np.int32)[at], "used": np.array(used, np.int32)[at]})

    kind = dict(rows.dtypes)["id"]
    out = cut.groupBy("shard").applyInPandas(run, f"id {kind}, piece int, start long, length int, bin_id string, offset int, capacity int, used int")
    return out.withColumnRenamed("id", id_col)
