"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors get one more component so that all have the largest norm M; then the largest inner product
is the least distance. A table hashes by functions floor((a.x - b) / w) with Gaussian a, made orthogonal over all tables as
far as the dimension allows; b is the middle of a sample and w wide, so a function tells two sides with an outer cell each, and
a handful of functions name a bucket of a few rows. A query visits, in each table, buckets in the order of their estimated
success, the chance that a neighbour's projections fall there, down to a least success and at most ``most_probes`` of them. Rows
are found by their bucket's name: a row of a bucket that is not visited is not read. Rows of visited buckets are scored
against the vector itself; the ``k`` best of each query and task are merged by query.

How to hash and how far to probe is measured, not guessed: the nearest rows of a bounded sample of ``fitted``
queries are found by brute force. How their projections follow the query's, how many tables and functions there are, and the least
success are those that find ``target`` of them with the fewest rows visited, by a bounded sample of rows. Column ``visited`` counts
the rows read for a query over all tables, a row once for each table that reads it.

Index rows and probes are dealt by (table, leading functions), so a query is sent once to each of few cells with the names
of its buckets there; a cell counted above ``chunk_rows`` (a vector that many
rows share) is cut by a hash of the id, and only its probes are copied to each of its chunks. Queries that
found fewer than ``k`` then go against all rows in blocks.

Scores are recomputed row by row in double precision from the original numbers, so equal vectors
have equal scores; ties go to the smaller id. Vectors that are null, zero, of another than the most
common dimension or hold nulls, NaN or infinities take no part, nor do rows without an id. Repeated rows count once: they
are merged before they are dealt. An id with several vectors takes one place, by its best score. An
empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

_PART = "query_id long, ids array<long>, scores array<double>, visited long"
_RESULT = "query_id long, rank int, vec_id long, score double, visited long"
#: Up to so many names of large cells are sent to every executor.
BROADCAST_ROWS = 200_000
#: Pairs of vectors that are multiplied at once: three copies of so many are held.
LOT = 16_384
#: Cells that a function tells apart: two sides of its middle, each with an outer cell.
CELLS = 4


@dataclass(frozen=True)
class Settings:
    k: int = 20
    most_tables: int = 8
    most_functions: int = 16
    bucket_rows: int = 4  # rows that a bucket holds at least, on average
    width: float = 3.0  # in standard deviations of a projection
    cell_rows: int = 16_384
    chunk_rows: int = 32_768
    most_probes: int = 512
    fitted: int = 64
    sampled: int = 2048
    target: float = 0.92
    seed: int = 11


@dataclass(frozen=True)
class Hashing:
    """The hash functions of all tables for one dimension and norm, and how far queries probe."""

    settings: Settings
    dim: int
    norm: float
    tables: int = 1
    functions: int = 0
    middle: np.ndarray | None = None  # [table * functions]
    width: np.ndarray | None = None
    slope: float = 1.0  # of a neighbour's projections over the query's
    spread: float = 1.0  # of a neighbour's projections around that
    least: float = -math.inf  # log success that a bucket must promise to be visited
    lead: int = 0

    def directions(self) -> np.ndarray:
        """[dim + 1, table * functions]"""
        d, n = self.dim + 1, self.tables * self.functions
        rng = np.random.default_rng([self.settings.seed, self.dim])
        groups = [np.linalg.qr(rng.normal(size=(d, d)))[0][:, : n - i] for i in range(0, n, d)]
        return np.concatenate([np.zeros((d, 0)), *groups], 1)

    def projected(self, x: np.ndarray, query: bool) -> np.ndarray:
        """[row, table * functions]"""
        square, a = (x * x).sum(1), self.directions()
        if query:
            return (x / np.sqrt(square)[:, None]) @ a[:-1]
        return (x / self.norm) @ a[:-1] + np.sqrt(np.maximum(0, 1 - square / self.norm**2))[:, None] * a[-1]

    def cells(self, p: np.ndarray) -> np.ndarray:
        """[row, table, function]: 0 to CELLS - 1"""
        own = np.clip(np.floor((p - self.middle) / self.width), -CELLS // 2, CELLS // 2 - 1).astype(np.int64) + CELLS // 2
        return own.reshape(len(p), self.tables, self.functions)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """[row, table]: names of the buckets of rows x; the leading functions come last in a name."""
        return self.cells(self.projected(x, False)) @ CELLS ** np.arange(self.functions, dtype=np.int64)

    def success(self, x: np.ndarray) -> np.ndarray:
        """[query, table, function, cell]: log chances of a neighbour's cell; the normal law by a logistic one."""
        at = (self.slope * (self.projected(x, True) - self.middle))[:, :, None]
        edges = (np.arange(1, CELLS) - CELLS // 2) * self.width[:, None] - at
        below = 1 / (1 + np.exp(np.clip(-1.702 * edges / self.spread, -60, 60)))
        ends = np.zeros((*below.shape[:2], 1))
        chance = np.diff(np.concatenate([ends, below, ends + 1], 2), axis=2)
        return np.log(np.maximum(chance, 1e-9)).reshape(len(x), self.tables, self.functions, CELLS)

    def sequence(self, success: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """[query, probe] of one table's ``success`` [query, function, cell]: names of buckets and their log success, the best first.

        Log chances add up over the functions, so the best of some functions extend to the best of one more.
        """
        total, name = np.zeros((len(success), 1)), np.zeros((len(success), 1), np.int64)
        for j in range(self.functions):
            total = (total[:, :, None] + success[:, j, None, :]).reshape(len(success), -1)
            name = (name[:, :, None] + np.arange(CELLS) * CELLS**j).reshape(len(success), -1)
            if total.shape[1] > probes:
                best = np.argpartition(-total, probes - 1, axis=1)[:, :probes]
                total, name = np.take_along_axis(total, best, 1), np.take_along_axis(name, best, 1)
        order = np.argsort(-total, axis=1, kind="stable")
        return np.take_along_axis(name, order, 1), np.take_along_axis(total, order, 1)

    def probed(self, x: np.ndarray) -> list[list[np.ndarray]]:
        """The visited buckets of each query in each table, in order of success."""
        success, out = self.success(x), [[] for _ in x]
        for t in range(self.tables):
            for a in range(0, len(x), 64):
                names, total = self.sequence(success[a : a + 64, t], self.settings.most_probes)
                for i, n in enumerate((total >= self.least).sum(1)):
                    out[a + i].append(names[i, : max(1, n)])
        return out

    def cell(self, bucket: np.ndarray) -> np.ndarray:
        """The leading functions of buckets."""
        return bucket % CELLS**self.lead


def _fitted(base: Hashing, q: np.ndarray, found: list[np.ndarray], sample: np.ndarray, n: int) -> Hashing:
    """The tables, functions and least success that find the target share of ``found``, the vectors nearest to each row of q, with the fewest rows visited."""
    s = base.settings
    owner = np.repeat(np.arange(len(q)), [len(x) for x in found])
    x = np.concatenate([*found, np.zeros((0, base.dim))])
    if not len(x):
        return base
    best, share = base, math.inf
    for functions in range(1, min(s.most_functions, max(1, round(math.log2(max(2, n / s.bucket_rows))) + 1)) + 1):
        for tables in {1, max(1, min(s.most_tables, (base.dim + 1) // functions))}:
            own = replace(base, tables=tables, functions=functions)
            rows = own.projected(sample, False)
            own = replace(own, middle=np.median(rows, 0), width=s.width * np.maximum(rows.std(0), 1e-9))
            at, to = (own.projected(q, True)[owner] - own.middle).ravel(), (own.projected(x, False) - own.middle).ravel()
            slope = float((at * to).sum() / max((at * at).sum(), 1e-12))
            own = replace(own, slope=slope, spread=max(float((to - slope * at).std()), 1e-9))
            success = own.success(q)
            chance = lambda some, cells: np.take_along_axis(some, cells[..., None], 3)[..., 0].sum(2)  # noqa: E731, B023
            reach = np.sort(chance(success[owner], own.cells(own.projected(x, False))).max(1))
            least = float(reach[min(len(reach) - 1, int((1 - s.target) * len(reach)))]) - 1e-9
            probes = max(int((own.sequence(success[:, t], s.most_probes + 1)[1] >= least).sum(1).max()) for t in range(tables))
            if probes > s.most_probes and share < math.inf:
                continue
            cells = own.cells(rows)
            visited = float(np.mean([(chance(np.broadcast_to(success[i], (len(cells), *success.shape[1:])), cells) >= least).sum() / len(cells) for i in range(len(q))]))
            if visited < share:
                best, share = replace(own, least=least), visited
    return replace(best, lead=min(best.functions, max(0, math.ceil(math.log2(n / s.cell_rows)))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64, copy=False)


_NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(query, id, score) of each query's k best ids in one chunk, sorted by id, and how many rows each query was scored with; blocks keep the matrices small."""
    out = []
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))[: len(ids)]
    step = max(1, 1_000_000 // max(1, len(ids)))
    for a in range(0, len(q_ids), step):
        rough = q[a : a + step] @ x.T
        rough[q_ids[a : a + step, None] == ids[None, :]] = -np.inf
        if len(first) > k:
            each = rough if len(first) == len(ids) else np.maximum.reduceat(rough, first, axis=1)
            least = np.partition(each, len(first) - k, axis=1)[:, len(first) - k]
            margin = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
            i, j = np.nonzero((rough >= (least - margin)[:, None]) & np.isfinite(rough))
        else:
            i, j = np.nonzero(np.isfinite(rough))
        out += [_cut(q_ids[a + i[b : b + LOT]], ids[j[b : b + LOT]], (q[a + i[b : b + LOT]] * x[j[b : b + LOT]]).sum(1), k) for b in range(0, len(i), LOT)]
    return (tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else _NOTHING), np.full(len(q_ids), len(ids), np.int64)


class _Buckets:
    """A chunk's rows in the order of their buckets."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bucket: np.ndarray):
        order = np.lexsort((ids, bucket))
        self.ids, self.x = ids[order], x[order]
        self.names, self.start = np.unique(bucket[order], return_index=True)
        self.end = np.append(self.start[1:], len(ids))

    def best(self, q_ids: np.ndarray, q: np.ndarray, asked: list[np.ndarray], k: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """As ``_best``, with the rows of the asked buckets alone."""
        out, visited = [], np.zeros(len(q_ids), np.int64)
        for i, names in enumerate(asked):
            at = np.searchsorted(self.names, names)
            at = at[(at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == names)]
            if not len(at):
                continue
            size = self.end[at] - self.start[at]
            rows = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            visited[i] = len(rows)
            x, ids = self.x[rows], self.ids[rows]
            rough = np.where(ids == q_ids[i], -np.inf, x @ q[i])
            if len(rows) > 4 * k:  # an id may stand more than once: the least of its best rows bounds only distinct ids
                least = np.partition(rough, len(rough) - k)[len(rough) - k]
                if len(np.unique(ids[rough >= least])) >= k:
                    some = rough >= least - 1e-9 * (1 + abs(least))
                    rough, x, ids = rough[some], x[some], ids[some]
            some = np.isfinite(rough)
            out.append(_cut(np.full(int(some.sum()), q_ids[i]), ids[some], (q[i] * x[some]).sum(1), k))
        return (tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else _NOTHING), visited


def _cut(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best rows, every id once, by its best score."""
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    new = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))[: len(q)]
    q, v, s = q[new], v[new], s[new]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    start = np.searchsorted(q, q)
    top = np.arange(len(q)) - start < k
    return q[top], v[top], s[top]


class _Finds:
    """What a task has found so far: the k best rows and the number of rows visited of each query."""

    def __init__(self, k: int):
        self.k, self.rows, self.counts = k, [], []
        self.n = 0

    def add(self, found: tuple, q_ids: np.ndarray, visited: np.ndarray) -> None:
        self.rows.append(found)
        self.counts.append((q_ids, visited))
        self.n += len(found[0]) + len(q_ids)

    def emitted(self, most: int) -> Iterator[pa.RecordBatch]:
        """Nothing while no more than ``most`` numbers are held after a cut; else one row a query."""
        if self.n <= most:
            return
        q, v, s = _cut(*(np.concatenate(x) for x in zip(*self.rows, strict=True)), self.k)
        who, visited = (np.concatenate(x) for x in zip(*self.counts, strict=True))
        names, at = np.unique(who, return_inverse=True)
        visited = np.bincount(at, visited, len(names)).astype(np.int64)
        self.rows, self.counts, self.n = [(q, v, s)], [(names, visited)], len(q) + len(names)
        if self.n > most // 2:
            self.rows, self.counts, self.n = [], [], 0
            cuts = np.append(np.searchsorted(q, names), len(q)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (v, s)]
            yield pa.RecordBatch.from_arrays([pa.array(names), *lists, pa.array(visited)], names=["query_id", "ids", "scores", "visited"])


def _ranked_in_blocks(rows: DataFrame, dim: int, k: int, whole: bool = False) -> DataFrame:
    """The k best (query_id, ids, scores, visited) that each task finds among rows (key, place, id, v, buckets) that meet under a key.

    ``place`` is 0 for index rows, with their bucket, and 1 for queries, with those they visit; a ``whole`` chunk is visited by all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        finds = _Finds(k)
        for batch in batches:
            key, place, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            v, buckets = _matrix(batch.column(3), dim), batch.column(4)
            flat, ends = buckets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(buckets.value_lengths().to_numpy())])
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (place[1:] != place[:-1])) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key[a] != now:
                    now, held, index = key[a], [], None
                if place[a] == 0:
                    held.append((at[a:b], v[a:b], flat[ends[a] : ends[b]]))
                elif held or index:
                    if index is None:
                        ids, x, own = (np.concatenate(c) for c in zip(*held, strict=True))
                        index, held = (ids, x) if whole else _Buckets(ids, x, own), []
                    found, visited = _best(at[a:b], v[a:b], *index, k) if whole else index.best(at[a:b], v[a:b], [flat[ends[i] : ends[i + 1]] for i in range(a, b)], k)
                    finds.add(found, at[a:b], visited)
                    yield from finds.emitted(200_000)
        if finds.n:
            yield from finds.emitted(-1)

    return rows.repartition("key").sortWithinPartitions("key", "place", "id").mapInArrow(run, _PART)


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, rank, vec_id, score, visited) of all tasks' finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last, total = None, 0  # the query that may go on in the next batch, and its rows visited so far

        def ranked(q: np.ndarray, v: np.ndarray, s: np.ndarray, names: np.ndarray, visited: np.ndarray) -> pa.RecordBatch:
            rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
            own = visited[np.searchsorted(names, q)] if len(q) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank.astype(np.int32)), pa.array(v), pa.array(s), pa.array(own)], names=["query_id", "rank", "vec_id", "score", "visited"])

        for batch in batches:
            if not batch.num_rows:
                continue
            who, sizes = batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
            names, at = np.unique(who, return_inverse=True)
            visited = np.bincount(at, batch.column(3).to_numpy(), len(names)).astype(np.int64)
            if last is not None and names[0] != last:
                names, visited = np.append(last, names), np.append(total, visited)
            elif last is not None:
                visited[0] += total
            held.append((np.repeat(who, sizes), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()))
            q, v, s = _cut(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
            last, total = names[-1], visited[-1]  # rows are sorted: only the last query can go on
            open_ = q == last
            held = [(q[open_], v[open_], s[open_])]
            yield ranked(q[~open_], v[~open_], s[~open_], names, visited)
        if held:
            yield ranked(*held[0], np.array([last], np.int64), np.array([total], np.int64))

    return parts.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, _RESULT)


def _nearest_of(few: list, rows: DataFrame, dim: int, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The vectors of the k rows nearest to each of a few queries (id, v), by brute force in the rows' own tasks; and the queries."""
    q_ids, q = np.array([r["id"] for r in few], np.int64), np.array([r["v"] for r in few], np.float64)
    order = np.argsort(q_ids, kind="stable")
    q_ids, q = q_ids[order], q[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finds = _Finds(k)
        for batch in batches:
            at = batch.column(0).to_numpy()
            own = np.argsort(at, kind="stable")
            found, visited = _best(q_ids, q, at[own], _matrix(batch.column(1), dim)[own], k)
            finds.add(found, q_ids, visited)
            yield from finds.emitted(200_000)
        if finds.n:
            yield from finds.emitted(-1)

    near = _merged(rows.select("id", "v").mapInArrow(run, _PART), k).select("query_id", F.col("vec_id").alias("id"))
    got: dict[int, list] = {}
    for r in near.join(rows, "id").select("query_id", "v").collect():  # k rows for each of the few
        got.setdefault(r["query_id"], []).append(r["v"])
    return [np.array(got.get(i, []), np.float64).reshape(-1, dim) for i in q_ids.tolist()], q


def fit(rows: DataFrame, dim: int, norm: float, n: int, s: Settings) -> Hashing:
    """Hash functions for n rows (id, query, v), measured on ``fitted`` of their queries and ``sampled`` rows, chosen by a hash of the id."""
    base = Hashing(s, dim, norm, middle=np.zeros(0), width=np.zeros(0))
    some = lambda df, most: df.select("id", "v").orderBy(F.xxhash64(F.lit("fit"), "id"), "id", "v").limit(most).collect()
    few = some(rows.where("query"), s.fitted)
    if not few:
        return base
    found, q = _nearest_of(few, rows, dim, s.k)
    return _fitted(base, q, found, np.array([r["v"] for r in some(rows, s.sampled)], np.float64), n)


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, visited): the nearest rows found for each row that ``is_query`` holds for."""
    s = settings or Settings()
    v = F.col(vec_col)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), v.alias("v"))
    rows = checkpoint(rows.groupBy("id", "v").agg(F.bool_or("query").alias("query")))
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("square"), F.count_if("query").alias("queries")).orderBy(F.desc("n"), "dim").first()
    if common is None or not common["queries"]:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    dim, n = common["dim"], common["n"]
    rows = rows.where(F.size("v") == dim)
    hashing = fit(rows, dim, math.sqrt(common["square"]), n, s)
    kind = dict(rows.dtypes)["v"]
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    one = F.pmod(F.xxhash64("id"), F.col("chunks"))

    def dealt_to(some: DataFrame, probe: bool) -> DataFrame:
        """(id, v, cell, buckets): one row for each table, or for each cell that has visited buckets."""

        def cells(x: np.ndarray) -> Iterator[list[tuple[int, np.ndarray]]]:
            if not probe:
                names = hashing.buckets(x)
                for row, leads in zip(names, hashing.cell(names), strict=True):
                    yield [(t << 40 | int(c), row[t : t + 1]) for t, c in enumerate(leads)]
                return
            for tables in hashing.probed(x):
                out = []
                for t, names in enumerate(tables):
                    own = hashing.cell(names)
                    order = np.argsort(own, kind="stable")
                    cuts = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
                    out += [(t << 40 | int(own[part[0]]), names[part]) for part in np.split(order, cuts[1:])]
                yield out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    own = batch.slice(a, 256)
                    got = list(cells(_matrix(own.column(1), dim)))
                    at = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
                    pairs = [c for g in got for c in g]
                    ends = np.concatenate([[0], np.cumsum([len(names) for _, names in pairs])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *(names for _, names in pairs)])))
                    yield pa.RecordBatch.from_arrays([own.column(0).take(at), own.column(1).take(at), pa.array([c for c, _ in pairs], pa.int64()), lists], names=["id", "v", "cell", "buckets"])

        return some.select("id", "v").mapInArrow(run, f"id long, v {kind}, cell long, buckets array<long>")

    index = checkpoint(dealt_to(rows, False))
    large = checkpoint(index.groupBy("cell").count().where(F.col("count") > s.chunk_rows).select("cell", F.ceil(F.col("count") / s.chunk_rows).cast("int").alias("chunks")))
    hint = "broadcast" if large.count() <= BROADCAST_ROWS else "merge"

    def keyed(some: DataFrame, probe: bool) -> DataFrame:
        own = some.join(large.hint(hint), "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        own = own.select("cell", "id", "v", "buckets", (every if probe else one).alias("chunk"))
        return own.select(F.xxhash64("cell", F.col("chunk").cast("long")).alias("key"), F.lit(int(probe)).alias("place"), "id", "v", "buckets")

    found = _ranked_in_blocks(keyed(index, False).unionAll(keyed(dealt_to(rows.where("query"), True), True)), dim, s.k)
    found = checkpoint(_merged(found, s.k))
    enough = found.where(F.col("rank") == s.k).select(F.col("query_id").alias("id"))
    short = checkpoint(rows.where("query").join(enough, "id", "left_anti").select("id", "v"))
    if short.isEmpty():
        return found
    chunked = lambda some: some.withColumns({"chunks": F.lit(math.ceil(n / s.chunk_rows)), "buckets": F.array().cast("array<long>")})
    whole = chunked(rows).select(F.xxhash64(one.cast("long")).alias("key"), F.lit(0).alias("place"), "id", "v", "buckets")
    rest = chunked(short).select(every.alias("chunk"), "id", "v", "buckets").select(F.xxhash64(F.col("chunk").cast("long")).alias("key"), F.lit(1).alias("place"), "id", "v", "buckets")
    exact = _merged(_ranked_in_blocks(whole.unionAll(rest), dim, s.k, whole=True), s.k)
    return found.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionAll(exact)
