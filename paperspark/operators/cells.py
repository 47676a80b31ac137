"""Exact nearest-neighbour search that skips most of a stored vector set.

``write_cells`` stores vectors around pivots: every vector lies in the cell of
a near pivot, with its distance to it (``radius``), sorted by both. For a query
at distance D from a pivot, the triangle inequality bounds the distances to all
vectors of the cell: at least D - largest radius and smallest radius - D, at
most D + largest radius. ``top_k_cells`` first scans, per query, the nearest
cells that hold k vectors together, which gives a k-th distance, and then only
those other cells whose lower bound does not exceed it. The rows are those of
``knn.top_k``.

Queries are never collected: they go to blocks of the cells they need, once to
each, and vectors of needed cells meet them there, in groups bounded in bytes
on both sides. A query's cells travel as a list.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..schemas import DEFAULT_TOP_K
from ..session import null_join, ship_package, staged
from .knn import (
    BLOCK_BYTES, CELL_BYTES, CELL_QUERY_BYTES, ROW_CHUNK, _final_rank, _ranks, _rows_of, _Search, _stack,
    _with_query_keys,
)

# Pivots are this many vectors at most, taken by the hash of their keys; their
# matrix is on the driver and in every task.
PIVOTS = 256
# Queries whose cells are looked up at once: a row of distances for each.
VISIT_ROWS = 1024
# Bounds are widened by this share against rounding.
SLACK = 1e-9


class Cells(NamedTuple):
    """Pivots of a stored vector set, and per pivot the number of vectors and
    their least and greatest radius. As many rows as there are pivots."""

    pivots: object
    counts: object
    low: object
    high: object


def _distances(Q, pivots):
    """Exact distances of every query to every pivot."""
    import numpy as np

    out = np.empty((len(Q), len(pivots)))
    for j, p in enumerate(pivots):
        diff = Q - p
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def write_cells(vectors: DataFrame, path: str, vector_key: list[str], vector_col: str = "embedding",
                pivots: int = PIVOTS, nonfinite: str = "raise") -> None:
    """Store ``vectors`` by cells at ``path`` (a new folder). NULL vectors are
    left out; ``nonfinite`` is ``raise`` or ``skip``, as in ``knn.top_k``."""
    import numpy as np

    spark = vectors.sparkSession
    ship_package(spark)
    v = vectors.select(*vector_key, F.col(vector_col).cast("array<double>").alias("_vv")).filter("_vv IS NOT NULL")
    finite = F.forall("_vv", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonfinite == "skip":
        v = v.filter(finite)
    chosen = v.filter(finite).orderBy(F.xxhash64(*vector_key), *vector_key).limit(pivots).select("_vv").collect()
    dims = {len(r["_vv"]) for r in chosen}
    if len(dims) > 1:
        raise ValueError(f"vectors of several dimensions: {sorted(dims)}")
    mat = np.asarray([r["_vv"] for r in chosen], float).reshape(len(chosen), dims.pop() if dims else 0)
    sent = spark.sparkContext.broadcast(mat)

    def run(batches):
        P = sent.value
        for pdf in batches:
            X, mask = _stack(pdf["_vv"], nonfinite)
            if len(X) and X.shape[1] != P.shape[1]:
                raise ValueError(f"vector dimension {X.shape[1]} differs from {P.shape[1]}")
            pdf = pdf[mask].reset_index(drop=True)
            cell, radius = np.zeros(len(X), int), np.zeros(len(X))
            for s in range(0, len(X), 1024):
                d = _distances(X[s:s + 1024], P)
                cell[s:s + 1024] = d.argmin(1)
                radius[s:s + 1024] = d.min(1)
            yield pdf.assign(cell=cell, radius=radius)

    schema = T.StructType([*v.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("radius", T.DoubleType())])
    placed = staged(v.mapInPandas(run, schema), "placed-vectors")
    order = ["cell", "radius"]
    placed.repartitionByRange(*order, *vector_key).sortWithinPartitions(*order).write.parquet(f"{path}/vectors")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"),
                                       F.max("radius").alias("high"))
    named = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(mat)],
                                  "cell int, pivot array<double>")
    named.join(stats, "cell").coalesce(1).write.parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, Cells]:
    """The stored vectors and their cells."""
    import numpy as np

    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    size = max((r["cell"] for r in rows), default=-1) + 1
    dims = len(rows[0]["pivot"]) if rows else 0
    pivots, counts = np.full((size, dims), np.inf), np.zeros(size, np.int64)
    low, high = np.zeros(size), np.zeros(size)
    for r in rows:
        i = r["cell"]
        pivots[i], counts[i], low[i], high[i] = r["pivot"], r["n"], r["low"], r["high"]
    return spark.read.parquet(f"{path}/vectors"), Cells(pivots, counts, low, high)


def nearest_cells(D, cells: Cells, k: int):
    """For the distances of one query to all pivots: the nearest cells that
    hold ``k`` vectors together."""
    import numpy as np

    held = np.flatnonzero(cells.counts)
    order = held[np.argsort(D[held], kind="stable")]
    return order[:int(np.searchsorted(np.cumsum(cells.counts[order]), k)) + 1]


def needed_cells(D, cells: Cells, limit: float):
    """The cells that can hold a vector within ``limit`` of the query."""
    import numpy as np

    wide = SLACK * (1 + D + cells.high)
    bound = np.maximum(D - cells.high, cells.low - D) - wide
    return np.flatnonzero((cells.counts > 0) & (bound <= limit * (1 + SLACK)))


def _visits(queries: DataFrame, cells, query_key: list[str], k: int, second: bool, nonfinite: str) -> DataFrame:
    """``query_key, _qv, _limit, cells``: the cells that each query of
    ``queries(query_key, _qv, _limit)`` visits, in the first or second round.
    ``_limit`` is the squared k-th distance so far (NULL: fewer rows)."""
    import numpy as np

    schema = T.StructType([*[queries.schema[c] for c in (*query_key, "_qv", "_limit")],
                           T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import pandas as pd

        held: Cells = cells.value
        for whole in batches:
            for at in range(0, len(whole), VISIT_ROWS):
                pdf = whole.iloc[at:at + VISIT_ROWS]
                Q, mask = _stack(pdf["_qv"], nonfinite)
                if not len(held.counts):
                    Q, mask = Q[:0], mask & False
                elif len(Q) and Q.shape[1] != held.pivots.shape[1]:
                    raise ValueError(f"vector dimension {held.pivots.shape[1]} differs from query dimension {Q.shape[1]}")
                pdf = pdf[mask].reset_index(drop=True)
                with np.errstate(invalid="ignore"):
                    D = _distances(Q, held.pivots) if len(Q) else np.zeros((0, 0))
                found = []
                for i in range(len(Q)):
                    near = nearest_cells(D[i], held, k)
                    if second:
                        limit = pdf["_limit"].iloc[i]
                        limit = np.inf if pd.isna(limit) else math.sqrt(limit)
                        near = np.setdiff1d(needed_cells(D[i], held, limit), near)
                    found.append(near.astype(np.int32))
                yield pdf.assign(cells=pd.Series(found, dtype=object))

    return queries.mapInPandas(run, schema).where(F.size("cells") > 0)


def _blocks(counts, asked, size: int):
    """Blocks of about ``size`` vectors: per cell the first block that holds it
    and in how many it lies (0: no query visits it), and their number. Cells
    share a block in their order; a larger one is dealt out to several."""
    import numpy as np

    first, many = np.zeros(len(counts), int), np.zeros(len(counts), int)
    block, room = -1, 0
    for c in np.flatnonzero(asked):
        if counts[c] > room:
            many[c] = max(1, math.ceil(counts[c] / size))
            first[c], block, room = block + 1, block + many[c], (size - counts[c]) * (many[c] == 1)
        else:
            first[c], many[c], room = block, 1, room - counts[c]
    return first, many, block + 1


def _meet(visits: DataFrame, vectors: DataFrame, cells: Cells, query_key, vector_key, k, nonfinite) -> DataFrame:
    """Best ``k`` candidates per query and block of the cells it visits.

    A query goes to each block once, whatever number of its cells lies there;
    blocks and groups of queries are bounded in bytes."""
    import numpy as np

    width = 8 * max(cells.pivots.shape[1], 1)
    per_cell = visits.select(F.explode("cells").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    asked = np.zeros(len(cells.counts), bool)
    asked[[r["c"] for r in per_cell]] = True
    first, many, n_blocks = _blocks(cells.counts, asked, max(1, CELL_BYTES // width))
    groups = max(1, math.ceil(visits.count() * width / CELL_QUERY_BYTES))
    row_chunk = max(1, min(ROW_CHUNK, BLOCK_BYTES // width))

    def of(numbers, cell):
        return F.get(F.array(*[F.lit(int(x)) for x in numbers]).cast("array<int>"), cell)

    def blocks_of(c):
        return F.sequence(of(first, c), of(first, c) + of(many, c) - 1)

    qs = visits.withColumn("_qb", F.pmod(F.xxhash64(*query_key), F.lit(groups)).cast("int")).withColumn(
        "_vb", F.explode(F.array_distinct(F.flatten(F.transform("cells", blocks_of)))))
    vs = (vectors.filter(F.col("cell").isin([int(c) for c in np.flatnonzero(asked)]))
          .select(*vector_key, "_vv", "cell",
                  (of(first, F.col("cell")) + F.pmod(F.xxhash64(*vector_key), of(many, F.col("cell")))).cast("int").alias("_vb"),
                  F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_qb")))
    schema = T.StructType([*[visits.schema[c] for c in query_key], *[vectors.schema[c] for c in vector_key],
                           T.StructField("dist", T.DoubleType())])

    def group(vpdf, qpdf):
        import pandas as pd

        held = None
        if len(vpdf) and len(qpdf):
            Q, _ = _stack(qpdf["_qv"], nonfinite)
            X, keys, mask = _rows_of(vpdf, vector_key, "_vv", Q.shape[1], nonfinite)
            limit = qpdf["_limit"].astype("float64").fillna(np.inf).to_numpy()
            search = _Search(Q, k, _ranks(keys, vector_key), None, limit)
            cell = vpdf["cell"].to_numpy()[mask]
            order = np.argsort(cell, kind="stable")
            X, cell = X[order], cell[order]
            sizes = [len(c) for c in qpdf["cells"]]
            goes, asker = np.concatenate(list(qpdf["cells"])), np.repeat(np.arange(len(Q)), sizes)
            by_cell = np.argsort(goes, kind="stable")
            goes, asker = goes[by_cell], asker[by_cell]
            for c in np.unique(cell):
                a, b = np.searchsorted(cell, [c, c + 1])
                p, q = np.searchsorted(goes, [c, c + 1])
                if p < q:
                    search.add(X[a:b], order[a:b], row_chunk, asker[p:q])
            held = search.found(keys)
        if held is None:
            return pd.DataFrame()  # no rows
        return _with_query_keys(held, qpdf[query_key])[[*query_key, *vector_key, "dist"]]

    on = ["_vb", "_qb"]
    return vs.groupBy(*on).cogroup(qs.groupBy(*on)).applyInPandas(group, schema)


def _rounds(queries: DataFrame, path: str, k: int, query_key, vector_key, query_col, nonfinite):
    """Visits of both rounds (staged), the candidates of both, the cells."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    ship_package(spark)
    vectors, cells = read_cells(spark, path)
    q = queries.select(*query_key, F.col(query_col).cast("array<double>").alias("_qv")).filter("_qv IS NOT NULL")
    sent = spark.sparkContext.broadcast(cells)
    asked = q.withColumn("_limit", F.lit(None).cast("double"))
    first = staged(_visits(asked, sent, query_key, k, False, nonfinite), "first-visits")
    found = staged(_meet(first, vectors, cells, query_key, vector_key, k, nonfinite), "first-candidates")
    best = Window.partitionBy(*query_key).orderBy("dist")
    kth = (found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == k)
           .select(*query_key, F.col("dist").alias("_limit")))
    second = staged(_visits(null_join(q, kth, query_key, "left"), sent, query_key, k, True, nonfinite), "second-visits")
    more = _meet(second, vectors, cells, query_key, vector_key, k, nonfinite)
    return first, second, found.unionByName(more), cells


def top_k_cells(queries: DataFrame, path: str, k: int = DEFAULT_TOP_K, query_key: list[str] | None = None,
                vector_key: list[str] | None = None, query_col: str = "embedding",
                nonfinite: str = "raise") -> DataFrame:
    """As ``knn.top_k`` over the vectors stored at ``path``. A query key names
    one query."""
    query_key = query_key or ["query_id"]
    vector_key = vector_key or [c for c in queries.sparkSession.read.parquet(f"{path}/vectors").columns
                                if c not in ("_vv", "cell", "radius")]
    _, _, found, _ = _rounds(queries, path, k, query_key, vector_key, query_col, nonfinite)
    return _final_rank(found, query_key, vector_key, k)


def visited_share(queries: DataFrame, path: str, k: int = DEFAULT_TOP_K, query_key: list[str] | None = None,
                  query_col: str = "embedding", nonfinite: str = "raise") -> dict[str, int]:
    """What a search does: pairs of a query and a stored vector, and how many
    of them lie in cells that the query visits; the rest is skipped unread."""
    query_key = query_key or ["query_id"]
    vector_key = [c for c in queries.sparkSession.read.parquet(f"{path}/vectors").columns
                  if c not in ("_vv", "cell", "radius")]
    first, second, _, cells = _rounds(queries, path, k, query_key, vector_key, query_col, nonfinite)
    per_cell = (first.unionByName(second).select(F.explode("cells").alias("c")).groupBy("c")
                .agg(F.count(F.lit(1)).alias("n")).collect())
    seen = sum(int(cells.counts[r["c"]]) * r["n"] for r in per_cell)
    n_queries = queries.filter(F.col(query_col).isNotNull()).count()
    return {"pairs": n_queries * int(cells.counts.sum()), "visited": seen}
