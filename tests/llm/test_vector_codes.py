"""Metric trees and codes against plain comparisons, and on awkward rows."""

import math

import numpy as np
import pytest

from paperspark.llm import vector_codes as vc
from paperspark.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, label int, code string, __label long"


def nearest(points, book):
    dist = ((points[:, None] - book[None]) ** 2).sum(2)
    code = dist.argmin(1)
    return code, np.bincount(code, minlength=len(book)), np.array([points[code == e].sum(0) for e in range(len(book))])


def cases(rng, n):
    for t in range(n):
        size, dims = int(rng.integers(1, 500)), int(rng.integers(1, 6))
        scale = int(rng.choice([1, 3, 40, 300, vc.NARROW]))
        points = rng.integers(-scale, scale + 1, (size, dims))
        entries = int(rng.integers(1, 65))
        yield points, points[rng.integers(0, size, entries)] if t % 2 else rng.integers(-scale, scale + 1, (entries, dims))


def test_trees_assign_as_plain_comparison_does():
    for points, book in cases(np.random.default_rng(1), 150):
        got = vc.Tree.unpacked(vc.Tree.build(points).packed()).assign(points, book)
        for a, b in zip(got, nearest(points, book)):
            assert (a == b).all()


def test_balls_hold_their_points_and_sums():
    for points, _ in cases(np.random.default_rng(2), 40):
        tree = vc.Tree.build(points)
        assert sorted(tree.order.tolist()) == list(range(len(points)))
        for ball in range(len(tree.lo)):
            mine = points[tree.order[tree.lo[ball]:tree.hi[ball]]]
            assert (mine.sum(0) == tree.total[ball]).all()
            reach = np.sqrt(((mine - tree.center[ball]) ** 2).sum(1)).max()
            assert reach <= tree.radius[ball] + 1e-6
            above = tree.parent[ball]
            assert above < 0 or tree.lo[above] <= tree.lo[ball] < tree.hi[ball] <= tree.hi[above]


def test_lists_shrink():
    """Most points are assigned with their ball, without being compared."""
    rng = np.random.default_rng(3)
    middles = rng.integers(-4000, 4000, (16, 4))
    points = (middles[rng.integers(0, 16, 4096)] + rng.integers(-40, 41, (4096, 4))).astype(np.int64)
    tree, compared = vc.Tree.build(points), []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1 and at.dtype != bool:
                compared.append(len(at))
            return super().__getitem__(at)

    tree.assign(points.view(Counting), middles.astype(np.int64))
    assert sum(compared) < len(points) / 10


def plain_codes(rows, parts, entries, rounds):
    """The codes by Python integers, row by row."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def code_of(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(code_of(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(groups[e]) for col in zip(*groups[e])] if e in groups else y
                        for e, y in enumerate(books[p])]
    out = []
    for (i, _, label), c in zip(kept, cut):
        best = [code_of(c[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), min(sum(d for d, _ in best), vc.LARGEST)))
    return out, books


def run(spark, rows, **how):
    prepare(spark)
    frame = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)
    codes, books = vc.compress(frame, **how)
    return vc.with_label_error(codes).collect(), books


def key(r):
    return (r[0] is None, r[0] or 0, r[2], r[3], r[1] is None, r[1] or 0)


@pytest.mark.parametrize("spread", [0.3, 9.0])
def test_codes_equal_plain_ones(spark, monkeypatch, spread):
    monkeypatch.setattr(vc, "BLOCK", 100)
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(0, spread, 8).astype(np.float32).tolist(), int(i) % 3) for i in rng.permutation(400)]
    # Nulls in every column, values that are not finite, repeated rows and ids.
    rows += [(1, None, 0), (2, [None] * 8, 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] + [0.0] * 7, 2),
             (None, [0.5] * 8, 1), (None, [0.5] * 8, None), (5, rows[0][1], None), (5, rows[0][1], None)]
    want, books = plain_codes(rows, 4, 16, 2)
    got, found = run(spark, rows, parts=4, entries=16)
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in got), key=key) == sorted(want, key=key)
    assert [b.tolist() for b in found] == books
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    assert all(r["label_error"] == sums[r["label"]] for r in got)


def test_huge_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, 1, 4) * 10.0 ** rng.integers(-2, 9)).astype(np.float32).tolist(), 0) for i in range(60)]
    want, books = plain_codes(rows, 2, 8, 2)
    got, found = run(spark, rows, parts=2, entries=8)
    assert sorted((r["vec_id"], r["label"], r["code"], r["error"]) for r in got) == sorted(want)
    assert [b.tolist() for b in found] == books


def test_few_equal_and_no_vectors(spark):
    assert run(spark, [])[0] == []
    got, books = run(spark, [(7, [0.25] * 16, 1)] * 3)
    assert [(r["vec_id"], r["code"], r["error"]) for r in got] == [(7, "00" * 16, 0)] * 3
    assert [len(b) for b in books] == [3] * 16
    with pytest.raises(ValueError):
        run(spark, [(1, [0.5] * 5, 1)])
    with pytest.raises(Exception, match="components"):
        run(spark, [(i, [0.5] * 16, 1) for i in range(80)] + [(99, [0.5] * 32, 1)])[0]
