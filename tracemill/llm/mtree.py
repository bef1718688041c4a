"""Exact top-k by inner product with best-first search in M-trees.

An inner product becomes a distance by one more coordinate: with y' = (y, sqrt(M^2 - |y|^2)) and q' = (q, 0),
|q' - y'|^2 = |q|^2 + M^2 - 2 q.y, M the largest norm in a tree. Vectors are dealt over trees of bounded size by their
nearest pivot and, where a pivot has more than a tree holds, by a hash; equal vectors go to one tree, where they are one
object with as many ids as a result can hold. A tree's nodes are stored pages of entries: centre, covering radius, and
distance to the node's own centre. Queries are put into blocks by the same pivots. A block goes to the trees of which the
root's ball can hold something better than what each of its queries is known to reach, and walks a tree together, nodes
in order of the best bound of any query: a page is read when its turn comes, and a query takes part in an entry unless
the stored distances and the triangle inequality show that nothing below can enter its result. Bounds are widened by
more than the rounding of doubles, scores are exact integers.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import Scratch

#: Objects in a tree, in a leaf, entries of an inner node, queries in a block, vectors that give queries a first bound, and pivots chosen among them.
TREE, LEAF, FANOUT, BLOCK, SAMPLE, PIVOTS = 8192, 64, 16, 256, 2048, 256
#: Scaled components and scores are below this, or there is no result: what doesn't fit a long is an error, as in SQL.
LARGEST = 1 << 63
_NEVER = np.iinfo(np.int64).min
_NO_ID = np.iinfo(np.int64).max


def _integers(batches: Iterator[pa.RecordBatch], scale: float, k: int, every: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, dim, name, v, query): integer vectors as bytes; of equal vectors in a batch, those that can be results, and all queries."""
    for batch in batches:
        ids, lists = ta.column(batch, "vec_id"), ta.column(batch, "embedding")
        out = []
        for i, (vec_id, vector) in enumerate(zip(ids.to_pylist(), lists, strict=True)):
            if vec_id is None or not vector.is_valid or vector.values.null_count:
                continue
            x = np.floor(vector.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if (np.abs(x) < LARGEST).all():  # finite too
                out.append((x.astype(np.int64).tobytes(), vec_id, len(x)))
        kept, last, n = [], None, 0
        for v, vec_id, dim in sorted(set(out)):
            n = n + 1 if v == last else 0
            last, query = v, vec_id % every == 0
            if n <= k or query:
                kept.append((vec_id, dim, hash_bytes(v), v, query, n <= k))
        if kept:
            yield pa.record_batch(list(map(pa.array, zip(*kept, strict=True))), schema=pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("name", pa.int64()), ("v", pa.binary()), ("query", pa.bool_()), ("object", pa.bool_())]))


def _dot(q: np.ndarray, points: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Inner products of 64-bit integers; _NEVER for those that don't fit a long. own: pairs of queries with their own rows, which nobody reads."""
    a, b = q.astype(np.float64), points.astype(np.float64)
    size = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None]
    beyond = []
    if size.max(initial=0.0) >= 2.0**62:
        for i, j in zip(*np.nonzero(~own & (np.abs(a @ b.T) + 1e-9 * size >= 2.0**62)), strict=True):
            if abs(sum(x * y for x, y in zip(q[i].tolist(), points[j].tolist(), strict=True))) >= LARGEST:
                beyond.append((i, j))
    out = q @ points.T  # sums that fit are right even where a part of them wrapped
    for i, j in beyond:
        out[i, j] = _NEVER
    return out


def hash_bytes(v: bytes) -> int:
    x = np.frombuffer(v, dtype=np.uint32).astype(np.uint64)
    return int(ta.signed(ta.mix(np.array([ta.mix(x + np.arange(1, len(x) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)])))[0])


class Page(NamedTuple):
    """A node. Leaf: vectors, their distances to the node's centre, how many ids each has, and the ids. Inner: centres, distances, covering radii, and the pages below."""

    leaf: bool
    points: np.ndarray
    stored: np.ndarray
    radii: np.ndarray
    numbers: np.ndarray  # children, or counts of ids
    ids: np.ndarray

    def dump(self) -> bytes:
        np.savez(to := io.BytesIO(), leaf=self.leaf, points=self.points, stored=self.stored, radii=self.radii, numbers=self.numbers, ids=self.ids)
        return to.getvalue()

    @classmethod
    def load(cls, packed: bytes) -> Page:
        held = np.load(io.BytesIO(packed))
        return cls(bool(held["leaf"]), *(held[k] for k in ("points", "stored", "radii", "numbers", "ids")))


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Indices of n points, or of all different ones, each the farthest from those before it."""
    chosen = [0]
    d = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < n and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return np.array(chosen)


def grow(points: np.ndarray, ids: list[np.ndarray]) -> tuple[list[Page], np.ndarray, float, float]:
    """points: distinct integer vectors; ids: for each, its smallest ids -> (pages, the root last; its centre; its covering radius; the largest squared norm)."""
    y = points.astype(np.float64)
    norm = (y * y).sum(axis=1)
    m2 = float(norm.max(initial=0.0))
    lifted = np.concatenate([y, np.sqrt(np.maximum(0.0, m2 - norm))[:, None]], axis=1)
    pages: list[Page] = []
    random = np.random.default_rng(5)

    def page(at: np.ndarray, centre: int) -> int:
        if len(at) <= LEAF:
            own = [ids[i] for i in at]
            pages.append(Page(True, points[at], np.linalg.norm(lifted[at] - lifted[centre], axis=1), np.zeros(len(at)), np.array([len(x) for x in own]), np.concatenate(own)))
            return len(pages) - 1
        some = random.choice(at, min(len(at), 16 * FANOUT), replace=False)
        pivots = some[farthest_first(lifted[some], FANOUT)]
        d2 = (lifted[at] ** 2).sum(1)[:, None] + (lifted[pivots] ** 2).sum(1)[None] - 2 * lifted[at] @ lifted[pivots].T
        group = d2.argmin(axis=1)
        if np.bincount(group).max() == len(at):
            group = np.arange(len(at)) % len(pivots) if len(pivots) > 1 else np.arange(len(at)) * FANOUT // len(at)
            pivots = pivots if len(pivots) > 1 else np.repeat(pivots, FANOUT)
        used, radii, children = [], [], []
        for g in np.unique(group):
            own = at[group == g]
            radii.append(float(np.linalg.norm(lifted[own] - lifted[pivots[g]], axis=1).max()))
            children.append(page(own, int(pivots[g])))
            used.append(pivots[g])
        used = np.array(used)
        pages.append(Page(False, points[used], np.linalg.norm(lifted[used] - lifted[centre], axis=1), np.array(radii), np.array(children), np.zeros(0, np.int64)))
        return len(pages) - 1

    centre = int(np.linalg.norm(lifted - lifted.mean(axis=0), axis=1).argmin())
    page(np.arange(len(points)), centre)
    return pages, points[centre], float(np.linalg.norm(lifted - lifted[centre], axis=1).max()), m2


class Tree:
    """A stored tree. pages: bytes of each page, read when a search comes to it. computed: distances and scores worked out so far."""

    def __init__(self, pages: list[bytes], centre: np.ndarray, m2: float, repeats: bool = True):
        self.packed, self.centre, self.m2, self.repeats = pages, centre, m2, repeats  # repeats: an id may have several vectors
        self.open: dict[int, Page] = {}
        self.computed = 0

    def page(self, k: int) -> Page:
        if k not in self.open:
            self.open[k] = Page.load(self.packed[k])
        return self.open[k]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of each query's best, best first, missing ones with the smallest score. floor: a score that each query is known to reach k times."""
        q = queries.astype(np.float64)
        q2 = (q * q).sum(axis=1)
        exact = float(np.sqrt(q2.max(initial=0.0) * self.m2)) < 2.0**52
        slack = 1e-9 * (q2 + self.m2) + 0.5
        margin = 1e-6 + 1e-7 * np.sqrt(q2 + self.m2)
        best_id, best = np.full((len(q), k), _NO_ID), np.full((len(q), k), _NEVER)

        def farthest(rows: np.ndarray) -> np.ndarray:
            """Distance beyond which nothing can enter a result."""
            need = np.maximum(best[rows, -1], floor[rows]).astype(np.float64)
            return np.where(need <= float(_NEVER), np.inf, np.sqrt(np.maximum(0.0, q2[rows] + self.m2 - 2 * (need - slack[rows]))))

        def distance(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
            self.computed += len(rows) * len(points)
            return np.sqrt(np.maximum(0.0, q2[rows][:, None] + self.m2 - 2 * (q[rows] @ points.T.astype(np.float64))))

        every = np.arange(len(q))
        heap = [(0.0, len(self.packed) - 1, every, distance(every, self.centre[None])[:, 0], np.zeros(len(q)))]
        while heap:
            _, number, rows, to_centre, low = heapq.heappop(heap)
            reach = farthest(rows)
            alive = low <= reach
            rows, to_centre, reach = rows[alive], to_centre[alive], reach[alive]
            if not len(rows):
                continue
            page = self.page(number)
            # by the stored distances alone; the rounding of distances near 0 is covered by a margin
            near = np.abs(to_centre[:, None] - page.stored[None]) - page.radii[None] <= reach[:, None] + margin[rows][:, None] + 1e-6 * to_centre[:, None]
            which, some = np.flatnonzero(near.any(axis=0)), near.any(axis=1)
            rows, near, reach = rows[some], near[some], reach[some]
            if not len(which):
                continue
            if page.leaf:
                points, count = page.points[which], page.numbers[which]
                first = np.cumsum(page.numbers) - page.numbers
                ids = np.concatenate([page.ids[first[o] : first[o] + page.numbers[o]] for o in which])
                self.computed += len(rows) * len(points)
                own_row = (count == 1)[None] & (page.ids[first[which]][None] == own[rows][:, None])
                score = (q[rows] @ points.T.astype(np.float64)).astype(np.int64) if exact else _dot(queries[rows], points, own_row)
                score = np.where(ids[None] == own[rows][:, None], _NEVER, score[:, np.repeat(np.arange(len(which)), count)])
                hit = (score >= np.maximum(best[rows, -1], floor[rows])[:, None]).any(axis=1)
                rows, score = rows[hit], score[hit]
                if len(rows):
                    found = np.concatenate([best[rows], score], axis=1)
                    names = np.concatenate([best_id[rows], np.where(score == _NEVER, _NO_ID, np.broadcast_to(ids, score.shape))], axis=1)
                    if self.repeats:  # an id's best score counts
                        at_name = np.lexsort((~found, names), axis=1)
                        sorted_names = np.take_along_axis(names, at_name, 1)
                        again = np.zeros(names.shape, dtype=bool)
                        np.put_along_axis(again, at_name[:, 1:], sorted_names[:, 1:] == sorted_names[:, :-1], 1)
                        found, names = np.where(again, _NEVER, found), np.where(again, _NO_ID, names)
                    order = np.lexsort((names, -found.astype(np.float64)) if exact else (names, ~found), axis=1)[:, :k]
                    best[rows], best_id[rows] = np.take_along_axis(found, order, 1), np.take_along_axis(names, order, 1)
                continue
            d = distance(rows, page.points[which])
            for j, i in enumerate(which):
                lower = np.maximum(0.0, d[:, j] - page.radii[i])
                take = near[:, i] & (lower <= reach + margin[rows] + 1e-6 * d[:, j])
                if take.any():
                    lower = np.maximum(0.0, lower[take] - margin[rows[take]] - 1e-6 * d[take, j])
                    heapq.heappush(heap, (float((lower / np.sqrt(q2[rows[take]] + self.m2 + 1)).min()), int(page.numbers[i]), rows[take], d[take, j], lower))
        return best_id, best


def _cell(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of each vector."""
    x, p = points.astype(np.float64), pivots.astype(np.float64)
    return ((p * p).sum(axis=1)[None] - 2 * x @ p.T).argmin(axis=1)


def _place(batches: Iterator[pa.RecordBatch], pivots) -> Iterator[pa.RecordBatch]:
    """Adds a column cell to rows with dim and v; 0 for dimensions without pivots."""
    for batch in batches:
        dims, v = ta.column(batch, "dim").to_numpy(), ta.column(batch, "v")
        cell = np.zeros(batch.num_rows, np.int32)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            if dim in pivots.value:
                cell[at] = _cell(np.stack([np.frombuffer(v[int(i)].as_buffer(), dtype=np.int64) for i in at]), pivots.value[dim])
        yield pa.record_batch([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])


_PAGES = "dim int, tree long, page int, centre binary, radius double, m2 double, packed binary"


def _build(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of tree, vector and id -> the pages of each tree; the root's row, its last, has the tree's centre, covering radius and largest norm. Of equal vectors the k + 1 smallest ids stay."""
    tree, held = None, {}

    def packed() -> Iterator[pa.RecordBatch]:
        v = list(held)
        points = np.stack([np.frombuffer(x, dtype=np.int64) for x in v])
        pages, centre, radius, m2 = grow(points, [np.array(held[x]) for x in v])
        n, last = len(pages), len(pages) - 1
        for lo in range(0, n, 64):
            some = range(lo, min(n, lo + 64))
            yield pa.record_batch(
                [
                    pa.array([tree[0]] * len(some), pa.int32()),
                    pa.array([tree[1]] * len(some), pa.int64()),
                    pa.array(list(some), pa.int32()),
                    pa.array([centre.tobytes() if i == last else None for i in some], pa.binary()),
                    pa.array([radius if i == last else None for i in some], pa.float64()),
                    pa.array([m2 if i == last else None for i in some], pa.float64()),
                    pa.array([pages[i].dump() for i in some], pa.binary()),
                ],
                names=["dim", "tree", "page", "centre", "radius", "m2", "packed"],
            )

    for batch in batches:
        for d, t, v, i in zip(*(ta.column(batch, c).to_pylist() for c in ("dim", "tree", "v", "vec_id")), strict=True):
            if (d, t) != tree:
                if held:
                    yield from packed()
                tree, held = (d, t), {}
            own = held.setdefault(v, [])
            if len(own) <= k and (not own or own[-1] != i):
                own.append(i)
    if held:
        yield from packed()


def _pack(batches: Iterator[pa.RecordBatch], k: int, sample) -> Iterator[pa.RecordBatch]:
    """Rows in order of block -> a block's queries, packed, with a first bound from the sample."""
    block, held = None, []

    def packed() -> pa.RecordBatch:
        ids = np.array([i for i, _ in held])
        q = np.stack([np.frombuffer(v, dtype=np.int64) for _, v in held])
        floor = np.full(len(ids), _NEVER)
        if block[0] in sample.value:
            names, points = sample.value[block[0]]
            order = np.argsort(names, kind="stable")
            score = _dot(q, points[order], ids[:, None] == names[order][None])
            names, first = np.unique(names[order], return_index=True)
            score = np.maximum.reduceat(score, first, axis=1)  # of several rows of one id, the best
            score[ids[:, None] == names[None]] = _NEVER
            if score.shape[1] >= k:
                floor = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        np.savez(to := io.BytesIO(), ids=ids, q=q, floor=floor)
        x = q.astype(np.float64)
        centre = x.mean(axis=0)
        radius, longest = float(np.linalg.norm(x - centre, axis=1).max()), float(np.linalg.norm(x, axis=1).max())
        return pa.record_batch([pa.array([block[0]], pa.int32()), pa.array([centre.tobytes()], pa.binary()), pa.array([radius]), pa.array([longest]), pa.array([int(floor.min())], pa.int64()), pa.array([to.getvalue()], pa.binary())], names=["dim", "middle", "spread", "longest", "least", "packed"])

    for batch in batches:
        for d, b, v, i in zip(*(ta.column(batch, c).to_pylist() for c in ("dim", "block", "v", "vec_id")), strict=True):
            if (d, b) != block or len(held) >= BLOCK:
                if held:
                    yield packed()
                block, held = (d, b), []
            held.append((i, v))
    if held:
        yield packed()


def _reaches(batches: Iterator[pa.RecordBatch], pivots) -> Iterator[pa.RecordBatch]:
    """How far what is below a tree's root lies from its cell's pivot at most: the root's distance and its radius."""
    for batch in batches:
        out = []
        for dim, cell, centre, radius, m2 in zip(*(ta.column(batch, c).to_pylist() for c in ("dim", "cell", "centre", "radius", "m2")), strict=True):
            if dim in pivots.value:
                away = float(np.linalg.norm(np.frombuffer(centre, dtype=np.int64).astype(np.float64) - pivots.value[dim][cell].astype(np.float64)))
                out.append((dim, cell, away + radius, m2))
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["dim", "cell", "reach", "m2"])


def _to_cells(batches: Iterator[pa.RecordBatch], pivots, cells) -> Iterator[pa.RecordBatch]:
    """Blocks of queries -> a row for each cell whose trees they may have to go to, by the cell's pivot and reach. Dimensions without pivots have one cell.

    c.y, c a block's middle, is at most c.p and the length of c times the reach, p the pivot, and at most the length of
    c times the longest norm; the block's other queries add their distance from c times that norm.
    """
    for batch in batches:
        rows, to = [], []
        for i, (dim, middle, spread, longest, least) in enumerate(zip(*(ta.column(batch, c).to_pylist() for c in ("dim", "middle", "spread", "longest", "least")), strict=True)):
            if dim not in pivots.value:
                rows.append(i)
                to.append(0)
                continue
            number, reach, m2 = cells.value.get(dim, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
            c = np.frombuffer(middle, dtype=np.float64)
            size, norm = float(np.linalg.norm(c)), np.sqrt(m2)
            most = np.minimum(pivots.value[dim][number].astype(np.float64) @ c + size * reach, size * norm) + spread * norm
            hit = number[most + 1e-6 * (size * (reach + norm) + spread * norm) + 1e-9 * (m2 + longest**2) + 1 >= least]
            rows += [i] * len(hit)
            to += hit.tolist()
        yield pa.record_batch([*(x.take(pa.array(rows, pa.int64())) for x in batch.columns), pa.array(to, pa.int32())], names=[*batch.schema.names, "cell"])


def routes(roots: DataFrame, blocks: DataFrame, pivots) -> DataFrame:
    """roots(dim, tree, cell, centre, radius, m2), blocks(dim, block, middle, spread, longest, least) -> both, for each block and each tree of the cells that it may have to go to.

    An upper level of the trees: a cell is a ball about its pivot. No more cells than pivots, which come from a bounded
    sample, reach the driver; blocks meet trees by cell, not all by all.
    """
    balls = roots.mapInArrow(lambda it: _reaches(it, pivots), "dim int, cell int, reach double, m2 double").groupBy("dim", "cell").agg(F.max("reach").alias("reach"), F.max("m2").alias("m2"))
    found: dict[int, list[tuple]] = {}
    for r in balls.collect():
        found.setdefault(r.dim, []).append((r.cell, r.reach, r.m2))
    cells = roots.sparkSession.sparkContext.broadcast({d: tuple(np.array(x) for x in zip(*rows, strict=True)) for d, rows in found.items()})
    schema = "dim int, middle binary, spread double, longest double, least long, block long, cell int"
    sent = blocks.select("dim", "middle", "spread", "longest", "least", "block").mapInArrow(lambda it: _to_cells(it, pivots, cells), schema)
    return roots.join(sent, ["dim", "cell"])


def _reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block and a tree, by the tree's root and the block's extent alone -> (dim, tree, block) of those where something of the tree can enter a result.

    For all queries of a block, q.y = (q - c).y + c.y is at most the block's radius times the tree's longest norm, and
    c.y, c its middle; c.y in turn is bounded by the root's ball.
    """
    for batch in batches:
        take = np.zeros(batch.num_rows, dtype=bool)
        column = {c: ta.column(batch, c) for c in batch.schema.names}
        for i in range(batch.num_rows):
            c = np.frombuffer(column["middle"][i].as_buffer(), dtype=np.float64)
            r = np.frombuffer(column["centre"][i].as_buffer(), dtype=np.int64).astype(np.float64)
            m2, radius = column["m2"][i].as_py(), column["radius"][i].as_py()
            away = max(0.0, float(np.sqrt(max(0.0, float(c @ c) + m2 - 2 * float(c @ r)))) - radius)
            most = min((float(c @ c) + m2 - away * away) / 2, float(np.sqrt(float(c @ c) * m2))) + column["spread"][i].as_py() * float(np.sqrt(m2))
            take[i] = most * (1 + 1e-6 * np.sign(most)) + 1e-9 * (m2 + column["longest"][i].as_py() ** 2) + 1 >= column["least"][i].as_py()
        yield pa.record_batch([column[c] for c in ("dim", "tree", "block")], names=["dim", "tree", "block"]).filter(pa.array(take))


def _walk(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (dim, tree, kind, page, packed, centre, m2) in that order: a tree's pages, then the blocks of queries that walk it -> results, and with a null query the number of distances that were worked out."""
    at, pages, tree, stored = None, [], None, None
    for batch in batches:
        for i in range(batch.num_rows):
            name = (ta.column(batch, "dim")[i].as_py(), ta.column(batch, "tree")[i].as_py())
            packed = ta.column(batch, "packed")[i].as_buffer().to_pybytes()
            if name != at:
                at, pages, tree, stored = name, [], None, None
            if ta.column(batch, "kind")[i].as_py() == 0:
                pages.append(packed)
                if ta.column(batch, "centre")[i].is_valid:
                    stored = (np.frombuffer(ta.column(batch, "centre")[i].as_buffer().to_pybytes(), dtype=np.int64), ta.column(batch, "m2")[i].as_py())
                continue
            tree = tree or Tree(pages, *stored)
            before, block = tree.computed, np.load(io.BytesIO(packed))
            ids, best = tree.search(block["q"], block["ids"], k, block["floor"])
            row, found = np.nonzero(ids != _NO_ID)
            yield pa.record_batch(
                [pa.concat_arrays([pa.array(block["ids"][row], pa.int64()), pa.nulls(1, pa.int64())]), pa.array([*ids[row, found].tolist(), 0], pa.int64()), pa.array([*best[row, found].tolist(), tree.computed - before], pa.int64())],
                names=["query_id", "vec_id", "score"],
            )


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): the k best rows for each row whose vec_id is divisible by `every`.

    Components are floor(scale * x); the score is the integer inner product; a query's own id is no candidate; ties go to
    the smaller vec_id; all candidates are returned where there are fewer than k. Vectors that are null or hold a null,
    or a non-finite component take no part, nor do rows without vec_id, nor vectors with a scaled component that doesn't
    fit a long; two vectors whose score doesn't fit one are no candidates of each other. Vectors of different length aren't compared. Repeated rows of one vec_id and vector are one row; with different vectors, the
    best counts. An empty table gives no rows.
    """
    found = walked(vectors, k, every, scale).where("query_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def walked(vectors: DataFrame, k: int, every: int, scale: float) -> DataFrame:
    """(query_id, vec_id, score): of each tree that a query's block goes to, the best; and with a null query_id the distances and scores worked out for a block in a tree."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = scratch.save(plain.mapInArrow(lambda it: _integers(it, scale, k, every), "vec_id long, dim int, name long, v binary, query boolean, object boolean"), "integers")
    chosen: dict[int, list] = {}
    for r in rows.where("object").orderBy(F.xxhash64("name", "vec_id"), "vec_id").limit(SAMPLE).collect():
        chosen.setdefault(r.dim, []).append((r.vec_id, r.v))
    drawn = {d: (np.array([i for i, _ in x]), np.stack([np.frombuffer(v, dtype=np.int64) for _, v in x])) for d, x in chosen.items()}
    sample = spark.sparkContext.broadcast(drawn)
    n_objects = {r.dim: r.n for r in rows.where("object").groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(4096).collect()}
    # twice as many pivots as trees, so that a tree is a cell or a few parts of one
    pivots = spark.sparkContext.broadcast({d: x[farthest_first(x.astype(np.float64), max(1, min(PIVOTS, -(-2 * n_objects.get(d, 1) // TREE))))] for d, (_, x) in drawn.items()})
    placed = scratch.save(rows.mapInArrow(lambda it: _place(it, pivots), "vec_id long, dim int, name long, v binary, query boolean, object boolean, cell int"), "placed")
    scratch.drop(rows)
    objects, queries = placed.where("object"), placed.where("query")
    sizes = scratch.save(objects.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / TREE).cast("long").alias("parts")), "sizes")
    tree = F.col("cell").cast("long") * (1 << 40) + F.pmod("name", "parts")
    dealt = objects.join(sizes, ["dim", "cell"]).select("dim", tree.alias("tree"), "vec_id", "v")
    trees = dealt.repartition("dim", "tree").sortWithinPartitions("dim", "tree", "v", "vec_id").mapInArrow(lambda it: _build(it, k), _PAGES)
    trees = scratch.save(trees, "trees")
    per_cell = queries.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts"))
    blocks = queries.select("dim", "cell", "vec_id", "v").distinct().join(per_cell, ["dim", "cell"])
    blocks = blocks.select("dim", F.xxhash64("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"), "v", "vec_id")
    blocks = blocks.repartition("dim", "block").sortWithinPartitions("dim", "block").mapInArrow(lambda it: _pack(it, k, sample), "dim int, middle binary, spread double, longest double, least long, packed binary")
    blocks = scratch.save(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    roots = trees.where("centre is not null").select("dim", "tree", F.shiftright("tree", 40).cast("int").alias("cell"), "centre", "radius", "m2")
    pairs = routes(roots, blocks, pivots).mapInArrow(_reachable, "dim int, tree long, block long")
    none = F.lit(None)
    stream = trees.select("dim", "tree", F.lit(0).alias("kind"), "page", "packed", "centre", "m2").unionByName(
        pairs.join(blocks.select("block", "packed"), "block").select("dim", "tree", F.lit(1).alias("kind"), F.lit(0).alias("page"), "packed", none.cast("binary").alias("centre"), none.cast("double").alias("m2"))
    )
    return stream.repartition("dim", "tree").sortWithinPartitions("dim", "tree", "kind", "page").mapInArrow(lambda it: _walk(it, k), "query_id long, vec_id long, score long")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) as e
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""
