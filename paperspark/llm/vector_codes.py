"""Product quantisation with exact integer k-means over metric trees.

Vectors are cut into equal parts; every part position has a codebook of its
own. A block of vectors holds one tree per part position, built from anchors
outwards ("middle-out"): about sqrt(n) anchors take the points nearest to them,
the balls of the anchors are paired upwards into a root, and each ball is cut
by anchors of its own downwards into leaves. Every ball caches the number and
the sum of its points. An assignment walks the trees from the root with lists
of candidate entries: a ball inherits its parent's list and loses the entries
that can be nearest to none of its points. A ball left with one entry is owned
by it, and its cached sum is added at once; points are compared one by one
only in leaves with more than one entry left. Nothing is approximated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperspark.llm.common import BROADCAST_ROWS, prepare, staged

SCALE = 256
# Vectors of a block; a block and its trees take some 8 MB in a task.
BLOCK = 4096
# Components up to this size have exact 64-bit distances, with an entry's
# number below them, for parts of 256 dimensions; blocks with larger ones are
# handled with unbounded integers.
NARROW = 1 << 22
# Room for rounding when a bound is compared.
SLACK = 1e-7
LARGEST = (1 << 63) - 1


# --- trees of one block and part position -----------------------------------

def squares(rows: np.ndarray) -> np.ndarray:
    """Squared length of every row."""
    return np.einsum("ij,ij->i", rows, rows)


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(squares(rows))


def by_anchors(points: np.ndarray, start: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Cuts each group of points (rows ``start[g]`` to ``start[g+1]``) by up
    to ``wanted[g]`` anchors; returns the anchor's number for every point,
    growing with the group.

    All groups go on at once, one new anchor each per step: the point that is
    farthest from its anchor. A point nearer to its anchor than half the way
    from there to the new one cannot move, so it is not measured.
    """
    sizes = np.diff(start)
    group = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate([[0], np.cumsum(wanted)[:-1]])
    place = np.zeros((int(wanted.sum()), points.shape[1]))
    place[first] = points[start[:-1]]
    owner = first[group]
    far = lengths(points - place[owner])
    for step in range(1, int(wanted.max(initial=1))):
        radius = np.maximum.reduceat(far, start[:-1])
        live = (wanted > step) & (radius > 0)
        if not live.any():
            break
        top = np.nonzero((far == radius[group]) & live[group])[0]
        groups, at = np.unique(group[top], return_index=True)
        fresh = first[groups] + step
        place[fresh] = points[top[at]]
        new_of = np.full(len(sizes), -1)
        new_of[groups] = fresh
        # Half the distance between an anchor and the new one of its group.
        mine = np.repeat(new_of, wanted)
        half = np.full(len(place), np.inf)
        near = mine >= 0
        half[near] = lengths(place[near] - place[mine[near]]) / 2
        moved = np.nonzero(far > half[owner] * (1 - SLACK))[0]
        to = new_of[group[moved]]
        dist = lengths(points[moved] - place[to])
        closer = dist < far[moved]
        moved = moved[closer]
        far[moved], owner[moved] = dist[closer], to[closer]
    return owner


def paired(center: np.ndarray, radius: np.ndarray, count: np.ndarray) -> list[tuple[int, int]]:
    """Pairs balls upwards until one is left; each time the two whose common
    ball is smallest. New balls are numbered after the given ones."""
    n = len(center)
    center = np.concatenate([center, np.zeros_like(center)])
    radius, count = np.append(radius, np.zeros(n)), np.append(count, np.zeros(n, int))
    # Radius of the common ball of two that are both alive, the later second.
    size = np.full((2 * n, 2 * n), np.inf)
    apart = np.sqrt(((center[:n, None] - center[None, :n]) ** 2).sum(2))
    size[:n, :n] = np.where(np.tri(n, dtype=bool), np.inf, (apart + radius[:n, None] + radius[:n]) / 2)
    alive, pairs = np.arange(2 * n) < n, []
    for k in range(n, 2 * n - 1):
        a, b = divmod(int(size.argmin()), 2 * n)
        pairs.append((a, b))
        two = [a, b]
        count[k] = count[two].sum()
        center[k] = (center[two] * count[two, None]).sum(0) / count[k]
        radius[k] = (lengths(center[two] - center[k]) + radius[two]).max()
        size[two], size[:, two], alive[two] = np.inf, np.inf, False
        rest = np.nonzero(alive)[0]
        size[rest, k] = (lengths(center[rest] - center[k]) + radius[rest] + radius[k]) / 2
        alive[k] = True
    return pairs


class Tree:
    """Balls over the points of one part position. ``order`` lists the points
    so that every ball is a range of it, ``lo`` to ``hi``; a ball's ``parent``
    is one level of ``depth`` above it."""

    ARRAYS = ("order", "lo", "hi", "depth", "parent", "center", "radius", "total")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        n = len(points)
        x = points.astype(float)
        # Anchors, then anchors within each.
        owner = by_anchors(x, np.array([0, n]), np.array([max(1, math.isqrt(n))]))
        order = np.argsort(owner, kind="stable")
        cuts = np.nonzero(np.diff(owner[order], prepend=-1))[0]
        start = np.append(cuts, n)
        tops = len(cuts)
        x_sorted = x[order]
        sizes = np.diff(start)
        wanted = np.maximum(1, np.sqrt(sizes).astype(int))
        leaf = by_anchors(x_sorted, start, wanted)

        # Pairs of anchors' balls upwards, then one order in which every ball
        # is a range.
        sums = np.add.reduceat(x_sorted, start[:-1])
        center = sums / sizes[:, None]
        reach = lengths(x_sorted - np.repeat(center, sizes, axis=0))
        pairs = paired(center, np.maximum.reduceat(reach, start[:-1]), sizes)
        children = {tops + k: pair for k, pair in enumerate(pairs)}
        tree, stack = [], [(tops + len(pairs) - 1, 0, -1)]
        while stack:
            ball, depth, parent = stack.pop()
            tree.append((ball, depth, parent))
            stack.extend((c, depth + 1, len(tree) - 1) for c in children.get(ball, ()))
        ball, depth, parent = map(np.array, zip(*tree))
        anchors = np.nonzero(ball < tops)[0]
        rank = np.empty(tops, int)
        rank[ball[anchors]] = np.arange(tops)
        group = np.repeat(np.arange(tops), sizes)
        at = np.lexsort((leaf, rank[group]))
        order, leaf, group = order[at], leaf[at], group[at]
        x = points[order].astype(float)

        # Ranges: leaves, anchors, and above them what their children span.
        leaf_lo = np.nonzero(np.diff(leaf, prepend=-1))[0]
        leaf_hi = np.append(leaf_lo[1:], n)
        inner_lo, inner_hi = np.full(len(ball), n), np.zeros(len(ball), int)
        inner_lo[anchors] = np.nonzero(np.diff(group, prepend=-1))[0]
        inner_hi[anchors] = np.append(inner_lo[anchors][1:], n)
        for k in range(len(ball) - 1, 0, -1):
            p = parent[k]
            inner_lo[p], inner_hi[p] = min(inner_lo[p], inner_lo[k]), max(inner_hi[p], inner_hi[k])
        over = anchors[np.searchsorted(inner_lo[anchors], leaf_lo, side="right") - 1]
        lo, hi = np.append(inner_lo, leaf_lo), np.append(inner_hi, leaf_hi)
        depth = np.append(depth, depth[over] + 1)
        parent = np.append(parent, over)

        # Cached sums, exact; centers and radii of all balls.
        running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)])
        total = running[hi] - running[lo]
        center = total / (hi - lo)[:, None]
        radius = np.empty(len(lo))
        leaves = slice(len(ball), None)
        reach = lengths(x - np.repeat(center[leaves], leaf_hi - leaf_lo, axis=0))
        radius[leaves] = np.maximum.reduceat(reach, leaf_lo)
        reach = lengths(x - np.repeat(center[anchors], (hi - lo)[anchors], axis=0))
        radius[anchors] = np.maximum.reduceat(reach, lo[anchors])
        for k in range(len(ball) - 1, -1, -1):
            if ball[k] >= tops:
                kids = np.nonzero(parent[:len(ball)] == k)[0]
                radius[k] = (lengths(center[kids] - center[k]) + radius[kids]).max()
        return cls({"order": order.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32),
                    "depth": depth.astype(np.int32), "parent": parent.astype(np.int32), "center": center,
                    "radius": radius * (1 + SLACK), "total": total})

    def packed(self) -> bytes:
        """The arrays after a head of the numbers of points, balls, dimensions."""
        head = np.array([len(self.order), *self.center.shape], np.int64)
        return b"".join([head.tobytes(), *(np.ascontiguousarray(getattr(self, a)).tobytes() for a in self.ARRAYS)])

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        n, balls, dims = np.frombuffer(data, np.int64, 3).tolist()
        at, out = 24, {}
        for name in cls.ARRAYS:
            kind = np.float64 if name in ("center", "radius") else np.int64 if name == "total" else np.int32
            length = n if name == "order" else balls * dims if name in ("center", "total") else balls
            out[name] = np.frombuffer(data, kind, length, at)
            at += out[name].nbytes
            if name in ("center", "total"):
                out[name] = out[name].reshape(balls, dims)
        return cls(out)

    def assign(self, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of every point (ties to the lower index), and the
        number and the sum of the points of every entry."""
        entries, dims = book.shape
        place = book.astype(float)
        counts, sums = np.zeros(entries, np.int64), np.zeros((entries, dims), np.int64)
        code = np.empty(len(points), np.int64)
        # Of equal entries only the first can own a point.
        first = np.sort(np.unique(book, axis=0, return_index=True)[1])
        by_depth = np.argsort(self.depth, kind="stable")
        bounds = np.searchsorted(self.depth[by_depth], np.arange(self.depth.max() + 2))
        has_child = np.zeros(len(self.lo), bool)
        has_child[self.parent[self.parent >= 0]] = True
        begin, size = np.zeros(len(self.lo), np.int64), np.zeros(len(self.lo), np.int64)
        inherited = first
        size[self.parent < 0] = len(first)
        owned, left = [], []
        for d in range(len(bounds) - 1):
            balls = by_depth[bounds[d]:bounds[d + 1]]
            if d:
                over = self.parent[balls]
                begin[balls], size[balls] = begin[over], size[over]
            balls = balls[size[balls] > 0]
            if not len(balls):
                break
            # Pairs of a ball and each entry of the list it inherits.
            n = size[balls]
            cut = np.cumsum(n) - n
            at = np.repeat(begin[balls] - cut, n) + np.arange(n.sum())
            entry, ball = inherited[at], np.repeat(balls, n)
            dist = squares(self.center[ball] - place[entry])
            best = np.minimum.reduceat(dist, cut)
            nearest = np.zeros(len(balls), np.int64)
            k = np.repeat(np.arange(len(balls)), n)
            hits = np.nonzero(dist == best[k])[0]
            nearest[k[hits][::-1]] = entry[hits][::-1]
            # For all points of a ball the difference of the two squared
            # distances is at least that at the center less this reach.
            apart = lengths(place[entry] - place[nearest[k]])
            gap = dist - best[k]
            stays = gap * (1 + SLACK) - SLACK * (dist + best[k]) <= 2 * self.radius[ball] * apart * (1 + SLACK)
            entry, k = entry[stays], k[stays]
            n = np.bincount(k, minlength=len(balls))
            cut = np.cumsum(n) - n
            one = n == 1
            mine, by = balls[one], entry[cut[one]]
            owned.append((mine, by))
            leaf = ~one & ~has_child[balls]
            left.append((balls[leaf], [entry[cut[j]:cut[j] + n[j]] for j in np.nonzero(leaf)[0]]))
            inherited = entry
            size[balls] = 0
            inner = ~one & ~leaf
            begin[balls[inner]], size[balls[inner]] = cut[inner], n[inner]

        balls, by = (np.concatenate(a) for a in zip(*owned))
        n = (self.hi - self.lo)[balls].astype(np.int64)
        np.add.at(counts, by, n)
        np.add.at(sums, by, self.total[balls])
        cut = np.cumsum(n) - n
        code[self.order[np.repeat(self.lo[balls] - cut, n) + np.arange(n.sum())]] = np.repeat(by, n)

        balls = np.concatenate([b for b, _ in left])
        if len(balls):
            # Points of leaves with several entries, each against all of them.
            lists = [e for _, es in left for e in es]
            width = np.array([len(e) for e in lists])
            flat = np.concatenate(lists)
            head = np.cumsum(width) - width
            n = (self.hi - self.lo)[balls].astype(np.int64)
            row = self.order[np.repeat(self.lo[balls] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            leaf = np.repeat(np.arange(len(balls)), n)
            wide = width[leaf]
            cut = np.cumsum(wide) - wide
            entry = flat[np.repeat(head[leaf] - cut, wide) + np.arange(wide.sum())]
            dist = squares(np.repeat(points[row], wide, axis=0) - book[entry])
            # The least distance, and of equal ones the lowest entry.
            by = np.minimum.reduceat(dist * entries + entry, cut) % entries
            code[row] = by
            np.add.at(counts, by, 1)
            np.add.at(sums, by, points[row])
        return code, counts, sums


def assign_wide(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :meth:`Tree.assign` for unbounded integers, one point at a time."""
    counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, object)
    code = np.array([int(((book - p) ** 2).sum(1).argmin()) for p in points], np.int64)
    for p, c in zip(points, code):
        counts[c] += 1
        sums[c] += p
    return code, counts, sums


# --- Spark -------------------------------------------------------------------

class Layout(NamedTuple):
    """Parts and components of a vector, and the type they are stored in."""

    parts: int
    dims: int
    kind: str


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 x): 64-bit, or unbounded if a component is beyond NARROW."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(float) * SCALE)
    if np.abs(scaled).max(initial=0) <= NARROW:
        return scaled.astype(np.int64)
    exact = [math.floor(int(x) * SCALE if abs(x) >= 2.0 ** 53 else x * SCALE) for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def parted(values: np.ndarray, parts: int) -> np.ndarray:
    """(vector, part, component)."""
    return values.reshape(len(values), parts, values.shape[1] // parts)


def usable(vector: str):
    """Column: whether the vector and its components are there and finite."""
    v = F.col(vector)
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def blocks_of(vectors: DataFrame, layout: Layout) -> DataFrame:
    """Blocks of up to ``BLOCK`` vectors of one input partition, with their
    trees: ``vec_id, label`` (arrays), ``vectors`` (packed), ``trees``
    (one per part; empty for a block with components beyond ``NARROW``)."""

    parts, dims, stored = layout

    def block(ids: list[pa.Array], labels: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        ids, labels, values = pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(rows)
        whole = integers(values)
        cut = parted(whole, parts)
        trees = [] if whole.dtype == object else [Tree.build(cut[:, p]).packed() for p in range(parts)]
        ends = pa.array([0, len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels),
             pa.array([values.tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))],
            names=["vec_id", "label", "vectors", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows, held = [], [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(BLOCK - held, batch.num_rows - at))
                at, held = at + part.num_rows, held + part.num_rows
                lengths = np.diff(part.column(2).offsets.to_numpy())
                if (lengths != dims).any():
                    raise ValueError(f"vectors of {dims} and of {lengths[lengths != dims][0]} components")
                ids.append(part.column(0))
                labels.append(part.column(1))
                rows.append(part.column(2).flatten().to_numpy(zero_copy_only=False).astype(stored).reshape(-1, dims))
                if held == BLOCK:
                    yield block(ids, labels, rows)
                    ids, labels, rows, held = [], [], [], 0
        if held:
            yield block(ids, labels, rows)

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return vectors.mapInArrow(
        run, f"vec_id array<{kinds[0]}>, label array<{kinds[1]}>, vectors binary, trees array<binary>")


def opened(batch: pa.RecordBatch, layout: Layout) -> Iterator[tuple[int, np.ndarray, list[Tree]]]:
    """Number, parted integers and trees of each block of a batch."""
    for k in range(batch.num_rows):
        values = np.frombuffer(batch.column("vectors")[k].as_buffer(), layout.kind).reshape(-1, layout.dims)
        trees = [Tree.unpacked(t.as_buffer()) for t in batch.column("trees")[k].values]
        yield k, parted(integers(values), layout.parts), trees


def assigned(points: np.ndarray, trees: list[Tree], books: list[np.ndarray]) -> list[tuple]:
    """The assignment of every part of a block."""
    if trees and all(b.dtype != object for b in books):
        return [t.assign(points[:, p], books[p]) for p, t in enumerate(trees)]
    return [assign_wide(points[:, p].astype(object), b.astype(object)) for p, b in enumerate(books)]


def moved_books(blocks: DataFrame, books: list[np.ndarray], layout: Layout) -> list[np.ndarray]:
    """One round: every entry becomes the floored mean of the parts assigned
    to it. A task adds up all of its blocks and sends at most one row per
    component of the codebooks; Spark adds those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for _, points, trees in opened(batch, layout):
                for p, (_, n, total) in enumerate(assigned(points, trees, books)):
                    counts[p] += n
                    sums[p] += total
        rows = [(p, e, j, int(counts[p][e]), str(sums[p][e, j]))
                for p in range(layout.parts) for e in np.nonzero(counts[p])[0].tolist() for j in range(sums[p].shape[1])]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "entry", "dim", "n", "total"), r)) for r in rows],
            pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()),
                       ("total", pa.string())]))

    sums = (blocks.select("vectors", "trees").mapInArrow(run, "part int, entry int, dim int, n long, total string")
            .groupBy("part", "entry", "dim")
            .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    out = [b.astype(object) for b in books]
    # As many rows as the codebooks have components.
    for r in sums.collect():
        out[r["part"]][r["entry"], r["dim"]] = int(r["total"]) // r["n"]
    return [narrowed(b) for b in out]


def narrowed(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if max((abs(int(x)) for x in book.ravel()), default=0) <= NARROW else book


def codes_of(blocks: DataFrame, books: list[np.ndarray], layout: Layout) -> DataFrame:
    """``vec_id, label, code, error`` of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, points, trees in opened(batch, layout):
                code = np.empty(points.shape[:2], np.uint8)
                error = 0
                for p, (mine, _, _) in enumerate(assigned(points, trees, books)):
                    code[:, p] = mine
                    error = error + ((points[:, p] - books[p][mine]) ** 2).sum(1)
                digits, width = code.tobytes().hex(), 2 * layout.parts
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id")[k].values, batch.column("label")[k].values,
                     pa.array([digits[i:i + width] for i in range(0, len(digits), width)], pa.string()),
                     pa.array([min(int(e), LARGEST) for e in error], pa.int64())],
                    names=["vec_id", "label", "code", "error"])

    kinds = [blocks.schema[c].dataType.elementType.simpleString() for c in ("vec_id", "label")]
    return blocks.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors, and the final codebooks (integers, by part).

    Returns ``vec_id, label, code, error`` and one array (entry, component)
    per part. Codebooks start from the ``entries`` vectors of smallest id
    (null ids last, rows of one id by their components), or from all if there
    are fewer. Rows whose vector is null, or holds null or non-finite
    components, are dropped; every other row gives one row, equal rows and
    null ids or labels included. Ties go to the lower entry. An empty table
    gives no rows and codebooks without entries. Other columns are ignored.
    Vectors of different lengths, or of a length that ``parts`` does not
    divide, raise, and so do components whose sum is beyond 38 digits; an
    error beyond 64 bits becomes the largest long.

    Blocks with their trees are written once to the shared folder and read by
    every round; what a round sends does not grow with the vectors.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256, two hexadecimal digits each")
    prepare(vectors.sparkSession)
    kind = vectors.schema[vector_col].dataType
    vector = F.col(vector_col)
    if not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        vector = vector.cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                          vector.alias("vector")).where(usable("vector"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    lengths = {len(r["vector"]) for r in first}
    if len(lengths) > 1 or any(n % parts or not n for n in lengths):
        raise ValueError(f"vectors of {sorted(lengths)} components cannot be cut into {parts} equal parts")
    dims = lengths.pop() if lengths else parts
    start = parted(integers(np.array([r["vector"] for r in first], float).reshape(-1, dims)), parts)
    books = [narrowed(start[:, p]) for p in range(parts)]
    layout = Layout(parts, dims, "f4" if isinstance(kind.elementType, T.FloatType) else "f8")
    blocks = staged(blocks_of(rows, layout), "vector-blocks")
    for _ in range(rounds):
        books = moved_books(blocks, books, layout)
    return codes_of(blocks, books, layout), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows of a label (nulls together)
    added up, beside every row. Errors are added within each task first; the
    sums are broadcast if counted to be few and of fixed width, else joined by
    a shuffle, where AQE splits a hot label."""
    codes = staged(codes, "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)"))
    sums = staged(codes.groupBy(F.col("label").alias("__label")).agg(total.cast("long").alias("label_error")), "sums")
    fixed = isinstance(codes.schema["label"].dataType, (T.NumericType, T.BooleanType, T.DateType))
    if fixed and sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
