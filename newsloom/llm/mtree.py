"""Exact search for the largest integer inner products with M-trees, best first.

Each component x becomes floor(256 x). With one more component sqrt(M^2 - \\|v\\|^2), M the largest norm, all rows have norm M, and the
largest inner product with a query (whose further component is 0) is the least distance, in which the triangle inequality
holds; queries are drawn out to norm M, which changes no order. Equal vectors are one entry, named by its ``k + 1`` smallest ids: more of them can never be among the ``k`` best.

Entries are dealt to trees of about ``tree_rows`` by the nearest of a bounded number of pivots; a crowded cell is cut by a hash. A task
builds a tree from pages of ``page`` entries: halves by two far entries until a page is filled, then pages of pages. A page
keeps its routing object, covering radius and, for each entry, the distance to the routing object and (inner pages) the child's radius.
Pages are rows of a table in the shared folder.

A query starts in the tree that holds its own vector, with pages in order of their least possible distance. An entry whose
stored distance to the routing object differs from the query's by more than the worst distance among the best so far (and
the child's radius) is passed over without a product; a page whose least distance exceeds it ends the search. With that worst distance
the query then visits every other tree that its root's covering radius does not exclude. All bounds leave room for rounding;
scores are whole numbers and exact while products add up to 64 bits. ``computed`` counts the products taken for a query's vector, over all trees.

Vectors that are null, empty, of another than the most common length, or hold nulls, NaN or infinities take no part, nor do rows
without an id; zero vectors do. Repeated rows count once; an id with several vectors takes one place, by its best
score, and as a query is answered for all of them. Equal scores go to the smaller id. An empty table or one without queries gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

_PAGE = "tree long, page int, level int, centre binary, cover double, vectors binary, reach binary, apart binary, children binary, ids array<array<long>>"
_FOUND = "v array<long>, tree long, ids array<long>, scores array<long>, computed long"
_RESULT = "query_id long, rank int, vec_id long, score long, computed long"


@dataclass(frozen=True)
class Settings:
    k: int = 5
    page: int = 64
    tree_rows: int = 8192
    most_pivots: int = 4096
    root_block: int = 4096  # roots that queries are compared with at once
    query_block: int = 32_768  # queries that visit one copy of a tree


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))


@dataclass(frozen=True)
class Space:
    """Integer vectors of one length whose largest squared norm is known."""

    dim: int
    square: float

    def lifted(self, v: np.ndarray) -> np.ndarray:
        """[row, dim + 1]: all of norm M."""
        x = v.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(0, self.square - (x * x).sum(1)))[:, None]])

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries drawn out to norm M, which changes no order, and the factors; a zero query stays."""
        q = q.astype(np.float64)
        norm = np.sqrt((q * q).sum(1))
        factor = np.divide(math.sqrt(self.square), norm, out=np.zeros(len(q)), where=norm > 0)
        return q * factor[:, None], factor

    def distances(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """[query, row] of rows v to drawn out queries q."""
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + self.square - 2 * (q @ v.T)))

    @property
    def slack(self) -> float:
        """More than rounding can change a distance by."""
        return 2e-6 * math.sqrt(self.square) + 1e-9


@dataclass
class Page:
    level: int
    centre: np.ndarray
    cover: float
    vectors: np.ndarray  # whole numbers
    reach: np.ndarray  # covering radii of the children; 0 in leaves
    apart: np.ndarray  # distances of the entries to the centre
    children: np.ndarray  # pages; none in leaves
    ids: list[list[int]]  # of the entries of leaves

    def __post_init__(self):
        self.numbers = self.vectors.astype(np.float64)


def _halved(x: np.ndarray, page: int) -> Iterator[np.ndarray]:
    """Rows of x in pages of neighbours, all full but one."""
    stack = [np.arange(len(x))]
    while stack:
        own = stack.pop()
        if len(own) <= page:
            yield own
            continue
        far = lambda c, own=own: x[own[((x[own] - c) ** 2).sum(1).argmax()]]
        a = far(x[own[0]])
        half = -(-len(own) // page) // 2 * page
        side = np.argpartition(x[own] @ (far(a) - a), half - 1)
        stack += [own[side[half:]], own[side[:half]]]


def build(space: Space, v: np.ndarray, ids: list[list[int]], page: int) -> list[Page]:
    """The pages of a tree over distinct vectors v; the root comes last."""
    x = space.lifted(v)
    pages: list[Page] = []

    def central(rows: np.ndarray) -> tuple[int, float]:
        """The row next to the middle of some rows, and how far they reach from it."""
        own = x[rows]
        c = rows[((own - own.mean(0)) ** 2).sum(1).argmin()]
        return int(c), float(np.sqrt(((own - x[c]) ** 2).sum(1).max()))

    level, under = 0, [(rows, -1, -1, 0.0) for rows in _halved(x, page)]  # rows below, page, centre, radius
    groups: list[list] = [[g] for g in under]
    while True:
        made = []
        for group in groups:
            rows = np.concatenate([g[0] for g in group])
            c, cover = central(rows)
            entries = rows if level == 0 else np.array([g[2] for g in group])
            apart = np.sqrt(((x[entries] - x[c]) ** 2).sum(1))
            reach = np.zeros(len(entries)) if level == 0 else np.array([g[3] for g in group])
            children = np.array([g[1] for g in group] if level else [], np.int32)
            pages.append(Page(level, v[c], cover, v[entries], reach, apart, children, [ids[i] for i in rows] if level == 0 else []))
            made.append((rows, len(pages) - 1, c, cover))
        if len(made) == 1:
            return pages
        groups, level = [made[i : i + page] for i in range(0, len(made), page)], level + 1


def best_first(space: Space, pages: list[Page], q: np.ndarray, k: int, floor: int | None = None) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) in a tree of those that score ``floor`` or more, equal ones by id, and the number of products taken."""
    (numbers,), (factor,) = space.asked(q[None])
    square = float(numbers @ numbers) + space.square
    best: dict[int, int] = {}  # id -> score
    reach = lambda s: math.sqrt(max(0.0, square - 2.0 * factor * s)) + space.slack
    bound = math.inf if floor is None else reach(floor)
    root = len(pages) - 1
    start = float(space.distances(pages[root].centre[None].astype(np.float64), numbers[None])[0, 0])
    heap, computed = [(0.0, root, start)], 1
    while heap:
        least, at, to_centre = heapq.heappop(heap)
        if least > bound:
            break
        page = pages[at]
        some = np.flatnonzero(np.abs(page.apart - to_centre) - page.reach <= bound + space.slack)
        computed += len(some)
        away = np.sqrt(np.maximum(0, square - 2 * (page.numbers[some] @ numbers)))
        low = away - page.reach[some]
        near = np.flatnonzero(low <= bound)
        if page.level:
            for i in near.tolist():
                heapq.heappush(heap, (max(least, float(low[i])), int(page.children[some[i]]), float(away[i])))
            continue
        scores = page.vectors[some[near]] @ q
        for j in np.argsort(-scores, kind="stable").tolist():
            score = int(scores[j])
            if floor is not None and score < floor:
                break
            for i in page.ids[some[near[j]]]:
                if score > best.get(i, score - 1):
                    best[i] = score
        if len(best) >= k:
            top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            best = dict(top)
            floor = top[-1][1]
            bound = reach(floor)
    return sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:k], computed


def _built(entries: DataFrame, space: Space, page: int) -> DataFrame:
    """The pages of every tree of entries (tree, v, ids)."""

    def rows(tree: int, v: list[np.ndarray], ids: list[list[int]]) -> Iterator[pa.RecordBatch]:
        pages = build(space, np.concatenate(v), ids, page)
        for a in range(0, len(pages), 64):
            own = pages[a : a + 64]
            columns = [[tree] * len(own), list(range(a, a + len(own))), [p.level for p in own], [p.centre.tobytes() for p in own], [p.cover for p in own], *([getattr(p, f).tobytes() for p in own] for f in ("vectors", "reach", "apart", "children")), [p.ids for p in own]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), *[pa.binary()] * 4, pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _PAGE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, v, ids = None, [], []
        for batch in batches:
            trees = batch.column(0).to_numpy()
            x, names = _matrix(batch.column(1), space.dim), batch.column(2).to_pylist()
            cuts = [0, *(np.flatnonzero(trees[1:] != trees[:-1]) + 1).tolist(), len(trees)] if len(trees) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if ids and trees[a] != now:
                    yield from rows(now, v, ids)
                    v, ids = [], []
                now = int(trees[a])
                v.append(x[a:b].astype(np.int64))
                ids += names[a:b]
        if ids:
            yield from rows(now, v, ids)

    return entries.select("tree", "v", "ids").repartition("tree").sortWithinPartitions("tree").mapInArrow(run, _PAGE)


def _visited(pages: DataFrame, asked: DataFrame, space: Space, k: int, blocks: int) -> DataFrame:
    """What queries (tree, v, floor) find in the trees that they visit; each of ``blocks`` groups of queries has its own copy of a tree."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        qs = _matrix(right.column("v"), space.dim).astype(np.int64) if right.num_rows else np.zeros((0, space.dim), np.int64)
        if len(qs):
            tree = []
            for r in left.sort_by("page").select([c.split()[0] for c in _PAGE.split(", ")[2:]]).to_pylist():
                number = lambda name, kind, r=r: np.frombuffer(r[name], kind)
                tree.append(Page(r["level"], number("centre", np.int64), r["cover"], number("vectors", np.int64).reshape(-1, space.dim), number("reach", np.float64), number("apart", np.float64), number("children", np.int32), r["ids"]))
            for q, floor in zip(qs, right.column("floor").to_pylist(), strict=True):
                found, computed = best_first(space, tree, q, k, floor)
                for column, x in zip(out, (q.tolist(), [i for _, i in found], [s for s, _ in found], computed), strict=True):
                    column.append(x)
        of = pa.list_(pa.int64())
        columns = [pa.array(out[0], of), pa.array([key[0].as_py()] * len(out[0]), pa.int64()), pa.array(out[1], of), pa.array(out[2], of), pa.array(out[3], pa.int64())]
        return pa.Table.from_arrays(columns, names=["v", "tree", "ids", "scores", "computed"])

    block = F.pmod(F.xxhash64(F.lit("block"), "v"), F.lit(blocks)).cast("int")
    copies = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else pages.withColumn("block", F.lit(0))
    return copies.groupBy("tree", "block").cogroup(asked.withColumn("block", block).groupBy("tree", "block")).applyInArrow(run, _FOUND)


def _elsewhere(found: DataFrame, roots: list, space: Space, k: int) -> DataFrame:
    """(tree, v, floor): the other trees of some roots in which a query may still find something."""
    trees = np.array([r["tree"] for r in roots], np.int64)
    centres = np.stack([np.frombuffer(r["centre"], np.int64) for r in roots]).astype(np.float64)
    cover = np.array([r["cover"] for r in roots])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, own = _matrix(batch.column(0), space.dim), batch.column(1).to_numpy()
            floors = np.array([s[k - 1] if len(s) >= k else None for s in batch.column(2).to_pylist()], object)
            q, factor = space.asked(v)
            square = (q * q).sum(1) + space.square
            bound = np.array([math.inf if f is None else math.sqrt(max(0.0, s - 2.0 * x * f)) for f, s, x in zip(floors, square, factor, strict=True)]) + 2 * space.slack
            i, j = np.nonzero((space.distances(centres, q) - cover <= bound[:, None]) & (trees[None, :] != own[:, None]))
            for a in range(0, len(i), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(trees[j[a : a + 8192]]), _lists(v[i[a : a + 8192]]), pa.array(floors[i[a : a + 8192]].tolist(), pa.int64())], names=["tree", "v", "floor"])

    return found.select("v", "tree", "scores").mapInArrow(run, "tree long, v array<long>, floor long")


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, computed): the best rows for each row that ``is_query`` holds for."""
    s, spark = settings or Settings(), vectors.sparkSession
    v = F.col(vec_col)
    finite = F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))), F.lit(False)) & (F.size(v) > 0)
    whole = F.transform(v, lambda e: F.floor(e.cast("double") * 256).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), whole.alias("v"))
    rows = checkpoint(rows.groupBy("id", "v").agg(F.bool_or("query").alias("query")))
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))).alias("square"), F.count_if("query").alias("queries")).orderBy(F.desc("n"), "dim").first()
    if common is None or not common["queries"]:
        return spark.createDataFrame([], _RESULT)
    space = Space(common["dim"], common["square"])
    rows = rows.where(F.size("v") == space.dim)
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= s.k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = few.join(rows.groupBy("v").agg(F.bool_or("query").alias("asked")), "v")

    n = common["n"]
    some = rows.select("v").orderBy(F.xxhash64(F.lit("pivot"), "v"), "v").limit(max(1, min(s.most_pivots, round(n / s.tree_rows)))).collect()
    pivots = space.lifted(np.unique(np.array([r["v"] for r in some], np.int64), axis=0))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = space.lifted(_matrix(batch.column(0), space.dim))
            cell = ((pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], names=["v", "ids", "asked", "cell"])

    entries = checkpoint(entries.mapInArrow(dealt, "v array<long>, ids array<long>, asked boolean, cell long"))
    crowded = entries.groupBy("cell").count().select("cell", F.greatest(F.lit(1), F.round(F.col("count") / s.tree_rows)).cast("long").alias("parts"))  # a row for each of the bounded pivots
    tree = F.shiftleft(F.col("cell"), 32) + F.pmod(F.xxhash64("v"), F.col("parts"))
    entries = checkpoint(entries.join(F.broadcast(crowded), "cell").select(tree.alias("tree"), "v", "ids", "asked"))
    pages = checkpoint(_built(entries, space, s.page))
    asked = entries.where("asked").select("tree", "v", F.lit(None).cast("long").alias("floor"))
    found = checkpoint(_visited(pages, asked, space, s.k + 1, 1))

    blocks = max(1, math.ceil(found.count() / s.query_block))
    parts, block = [found], []
    roots = pages.groupBy("tree").agg(F.max_by(F.struct("centre", "cover"), "page").alias("root")).select("tree", "root.*")
    for r in (*roots.toLocalIterator(), None):
        block += [r] if r else []
        if len(block) == s.root_block or block and r is None:
            parts.append(checkpoint(_visited(pages, _elsewhere(found, block, space, s.k + 1), space, s.k + 1, blocks)))
            block = []
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionAll(p)
    by_vector = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")
    each = merged.select("v", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("v", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    each = each.groupBy("v", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by_vector)).where(F.col("rank") <= s.k + 1)
    best = each.groupBy("v").agg(F.collect_list(F.struct("vec_id", "score")).alias("best")).join(merged.groupBy("v").agg(F.sum("computed").alias("computed")), "v")
    answers = rows.where("query").select(F.col("id").alias("query_id"), "v").join(best, "v").select("query_id", "computed", F.explode("best").alias("x")).select("query_id", "computed", "x.*").where(F.col("vec_id") != F.col("query_id"))
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("computed").alias("computed"))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score", "computed")
