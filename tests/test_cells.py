"""Search by cells returns the rows of the full search and skips the rest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperspark.operators import cells
from paperspark.operators.knn import top_k

STORE = "name string, part long, embedding array<double>"
ASKED = "query_id long, embedding array<double>"


def clustered(rng, n, dims=6, clusters=12):
    middles = rng.normal(0, 40, (clusters, dims))
    return (middles[rng.integers(0, clusters, n)] + rng.normal(0, 1, (n, dims))).round(3)


def frames(spark, seed, n=600, asked=40, **how):
    rng = np.random.default_rng(seed)
    rows = clustered(np.random.default_rng(99), n, **how)
    store = spark.createDataFrame([(f"v{i}", i % 3, [float(x) for x in v]) for i, v in enumerate(rows)], STORE)
    near = rows[rng.integers(0, n, asked)] + rng.normal(0, 0.5, (asked, rows.shape[1]))
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(near)], ASKED)
    return store, queries


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "name", "part", "dist").collect()))


@pytest.mark.parametrize("pivots,k", [(1, 5), (24, 1), (24, 7), (600, 5)])
def test_same_rows_as_the_full_search(spark, tmp_path, pivots, k):
    store, queries = frames(spark, k)
    path = str(tmp_path / "cells")
    cells.write_cells(store, path, ["name", "part"], pivots=pivots)
    assert rows_of(cells.top_k_cells(queries, path, k)) == rows_of(top_k(queries, store, k))


def test_most_pairs_are_skipped(spark, tmp_path):
    store, queries = frames(spark, 3, n=3000)
    path = str(tmp_path / "cells")
    cells.write_cells(store, path, ["name", "part"], pivots=60)
    share = cells.visited_share(queries, path, 5)
    assert share["pairs"] == 3000 * 40 and share["visited"] < 0.2 * share["pairs"]


def test_large_cells_are_split_on_both_sides(spark, tmp_path, monkeypatch):
    store, queries = frames(spark, 4)
    path = str(tmp_path / "cells")
    cells.write_cells(store, path, ["name", "part"], pivots=5)
    want = rows_of(top_k(queries, store, 4))
    monkeypatch.setattr(cells, "CELL_BYTES", 2000)
    monkeypatch.setattr(cells, "CELL_QUERY_BYTES", 200)
    assert rows_of(cells.top_k_cells(queries, path, 4)) == want


def test_shuffled_rows_grow_less_than_blocks_by_vectors(spark, tmp_path):
    """A vector goes to the queries' groups of its own cell, not to all."""
    store, queries = frames(spark, 5, n=2000, asked=200)
    path = str(tmp_path / "cells")
    cells.write_cells(store, path, ["name", "part"], pivots=50)
    first, second, _, found = cells._rounds(queries, path, 5, ["query_id"], ["name", "part"], "embedding", "raise")
    sent = first.count() + second.count()
    assert sent < 200 * np.count_nonzero(found.counts) / 4


def test_ties_few_rows_and_empty_sides(spark, tmp_path):
    same = spark.createDataFrame([(f"v{i}", 0, [1.0, 2.0]) for i in range(9)] + [("far", 0, [9.0, 9.0]), ("no", 0, None)],
                                 STORE)
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, [9.0, 9.0]), (3, None)], ASKED)
    path = str(tmp_path / "same")
    cells.write_cells(same, path, ["name", "part"], pivots=4)
    for k in (1, 3, 10, 50):
        assert rows_of(cells.top_k_cells(queries, path, k)) == rows_of(top_k(queries, same, k))
    assert cells.top_k_cells(queries.limit(0), path, 3).collect() == []
    empty = str(tmp_path / "empty")
    cells.write_cells(same.limit(0), empty, ["name", "part"])
    assert cells.top_k_cells(queries, empty, 3).collect() == []
    with pytest.raises(ValueError):
        cells.top_k_cells(queries, path, 0)


def test_nonfinite_vectors_raise_or_are_skipped(spark, tmp_path):
    store = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("b", 0, [float("nan"), 0.0]), ("c", 0, [float("inf"), 0.0]),
                                   ("d", 0, [1.5, 2.0])], STORE)
    with pytest.raises(Exception, match="NaN"):
        cells.write_cells(store, str(tmp_path / "x"), ["name", "part"])
    path = str(tmp_path / "y")
    cells.write_cells(store, path, ["name", "part"], nonfinite="skip")
    queries = spark.createDataFrame([(1, [1.0, 2.0])], ASKED)
    assert [r["name"] for r in cells.top_k_cells(queries, path, 5).orderBy("rank").collect()] == ["a", "d"]
    with pytest.raises(Exception, match="dimension"):
        cells.top_k_cells(spark.createDataFrame([(1, [1.0])], ASKED), path, 5).collect()


def test_needed_cells_reach_the_scan(spark, tmp_path):
    store, _ = frames(spark, 6)
    path = str(tmp_path / "cells")
    cells.write_cells(store, path, ["name", "part"], pivots=20)
    vectors, _ = cells.read_cells(spark, path)
    plan = vectors.filter(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan
