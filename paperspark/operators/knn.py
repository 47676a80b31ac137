"""Exact k-nearest-neighbour search by squared L2 distance.

No pair of (query, vector) ever becomes a row. Each task scores its vectors
against a block of queries with numpy and keeps only the best ``k`` per
query (ties broken by the vector key), so a task emits at most
``k x queries`` rows however many vectors it holds; a window per query then
keeps the global best ``k`` (Spark plans it with a WindowGroupLimit).

* Small query sets (checked: vectors and keys together under a byte budget)
  are broadcast once and the vectors are scanned in place, with no shuffle.
* Larger query sets are split into blocks by hash; vectors and queries meet
  in co-grouped (query block, vector block) cells, each bounded in bytes on
  both sides.

Distances: candidates are chosen with the fast expansion |x|^2 + |q|^2 - 2xq
and a margin for its rounding error, per row and query, then re-scored
exactly as the sum over dimensions, left to right in double precision, of
(x_i - q_i)^2, the same value the SQL expression
``aggregate(zip_with(...))`` gives. A row whose expansion overflows is always
a candidate. NULL vectors are ignored; a vector with a NaN, an infinity or a
NULL element, and one whose dimension differs from the queries', fails the
job. ``nonfinite="skip"`` leaves vectors without a finite value everywhere
out instead; ``nonfinite_vectors`` lists them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..session import ship_package
from ..schemas import DEFAULT_TOP_K

BROADCAST_BUDGET_BYTES = 16 * 1024 * 1024
QUERY_CHUNK = 256
# Rows scored at once: bounds the distance block to ROW_CHUNK x QUERY_CHUNK;
# Arrow batches are gathered up to GATHER such blocks. A search starts with a
# smaller block, to learn how near the k-th row is.
ROW_CHUNK = 4096
BLOCK_BYTES = 8 * 1024 * 1024
GATHER = 4
FIRST_ROWS = 256
OUT_ROWS = 50_000
# Each side of a co-grouped cell holds about so many bytes of vectors: a task
# keeps some five copies of both, and the shuffle grows with their inverse.
CELL_BYTES = 16 * 1024 * 1024
CELL_QUERY_BYTES = 16 * 1024 * 1024


def _stack(series, nonfinite="raise"):
    """Rows of an array column as a float64 matrix plus a mask of the rows it
    holds: not NULL and, with ``skip``, finite everywhere."""
    import numpy as np

    mask = series.notna().to_numpy()
    vals = series[mask].tolist()
    if not vals:
        return np.zeros((0, 0)), mask
    lens = {len(v) for v in vals}
    if len(lens) != 1:
        raise ValueError(f"one batch holds vectors of several dimensions: {sorted(lens)[:5]}")
    X = np.asarray([np.asarray(v, dtype=np.float64) for v in vals])
    finite = np.isfinite(X).all(axis=1)
    if not finite.all():
        if nonfinite == "raise":
            raise ValueError(f"{int((~finite).sum())} vectors of a batch hold NaN, infinite or NULL elements")
        mask[np.flatnonzero(mask)[~finite]] = False
        X = X[finite]
    return X, mask


def _exact(X, Q, rows, queries):
    """Sums of squared differences of paired rows, dimension by dimension,
    left to right."""
    import numpy as np

    acc = np.zeros(len(rows), dtype=np.float64)
    for i in range(X.shape[1]):
        diff = X[rows, i] - Q[queries, i]
        acc = acc + diff * diff
    return acc


def _ranks(keys, key_names):
    """Place of every row in the order of the keys."""
    import numpy as np

    out = np.empty(len(keys), dtype=np.int64)
    out[keys.sort_values(key_names, kind="mergesort").index.to_numpy()] = np.arange(len(keys))
    return out


def _first_k(q, r, d, rank, k, groups=None):
    """Of ``(query, row, distance)`` arrays the best ``k`` of each query under
    (distance, key), with ``groups`` one row of a group; and their places."""
    import numpy as np

    order = np.lexsort((rank[r], d, q))
    q, r, d = q[order], r[order], d[order]
    if groups is not None:
        by_group = np.lexsort((groups[r], q))  # stable: the nearest of a group stays first
        gq, gr = q[by_group], groups[r[by_group]]
        first = np.r_[True, (gq[1:] != gq[:-1]) | (gr[1:] != gr[:-1])][:len(q)]
        keep = np.sort(by_group[first])
        q, r, d = q[keep], r[keep], d[keep]
    new = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][:len(q)])
    place = np.arange(len(q)) - np.repeat(new, np.diff(np.r_[new, len(q)]))
    near = place < k
    return q[near], r[near], d[near], place[near]


class _Search:
    """The best ``k`` rows of each query among the rows scored so far, as two
    arrays of ``queries x k``: row numbers (-1: none) and exact distances.

    Bounds of a block's distances come from the expansion |x|^2 + |q|^2 - 2xq,
    one matrix product, and its rounding error. ``limit`` holds a distance per
    query that its k-th row does not exceed; only nearer rows are scored
    exactly. What is held at once is bounded by a block of rows by
    ``QUERY_CHUNK`` queries, also if all distances tie. ``rank`` and
    ``groups`` are integers per row number: the order of its key, its group."""

    def __init__(self, Q, k, rank, groups=None, limit=None):
        import numpy as np

        self.Q, self.k, self.rank, self.groups = Q, k, rank, groups
        self.rows = np.full((len(Q), k), -1, dtype=np.int64)
        self.dist = np.full((len(Q), k), np.inf)
        self.limit = np.full(len(Q), np.inf) if limit is None else limit.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            self.qq = np.einsum("ij,ij->i", Q, Q)
            self.wide = np.column_stack([-2.0 * Q, np.ones(len(Q)), self.qq])

    def hold(self, q, r, d):
        """Take in scored rows; queries as numbers."""
        import numpy as np

        asked = np.unique(q)
        old_q, old_i = np.nonzero(self.rows[asked] >= 0)
        old_q = asked[old_q]
        q, r, d, place = _first_k(
            np.r_[q, old_q], np.r_[r, self.rows[old_q, old_i]], np.r_[d, self.dist[old_q, old_i]],
            self.rank, self.k, self.groups)
        self.rows[q, place], self.dist[q, place] = r, d
        full = place == self.k - 1
        self.limit[q[full]] = np.minimum(self.limit[q[full]], d[full])

    def _within(self, high, codes):
        """A distance per query that k rows (groups) of a block do not exceed."""
        import numpy as np

        if codes is not None:
            order = np.argsort(codes, kind="stable")
            ordered = codes[order]
            high = np.minimum.reduceat(high[order], np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]), axis=0)
        if len(high) < self.k:
            return np.full(high.shape[1], np.inf)
        return np.partition(high, self.k - 1, axis=0)[self.k - 1]

    def add(self, X, numbers, row_chunk=ROW_CHUNK, queries=None):
        """Score the rows ``X``, numbered ``numbers``, for some queries (all by
        default)."""
        import numpy as np

        if not len(X) or not len(self.Q):
            return
        queries = np.arange(len(self.Q)) if queries is None else queries
        with np.errstate(over="ignore", invalid="ignore"):
            xx = np.einsum("ij,ij->i", X, X)
            wide = np.column_stack([X, xx, np.ones(len(X))])
        # A few rows first: they give limits to most queries.
        few = min(len(X), row_chunk, max(FIRST_ROWS, 4 * self.k))
        cuts = [0, *range(few, len(X), row_chunk), len(X)]
        for s in range(0, len(queries), QUERY_CHUNK):
            asked = queries[s:s + QUERY_CHUNK]
            Qt, qq = self.wide[asked].T, self.qq[asked]
            for a, b in zip(cuts, cuts[1:]):
                with np.errstate(over="ignore", invalid="ignore"):
                    approx = wide[a:b] @ Qt
                    margin = 1e-9 * (xx[a:b].max() + qq) + 1e-12
                    sure = np.isfinite(4.0 * (xx[a:b].max() + qq.max()))
                    if not np.isfinite(self.limit[asked]).all():
                        high = approx + margin
                        if not sure:
                            high[~np.isfinite(approx)] = np.inf
                        within = self._within(high, None if self.groups is None else self.groups[numbers[a:b]])
                        self.limit[asked] = np.minimum(self.limit[asked], np.where(np.isnan(within), np.inf, within))
                    near = approx <= self.limit[asked] + margin
                    if not sure:
                        near |= ~np.isfinite(approx)
                ri, qi = np.nonzero(near)
                if len(qi):
                    self.hold(asked[qi], numbers[a:b][ri], _exact(X[a:b], self.Q[asked], ri, qi))

    def found(self, keys):
        """``keys`` of the best rows, ``_q`` (query number) and ``dist``; None
        if there are none."""
        import numpy as np

        q, i = np.nonzero(self.rows >= 0)
        if not len(q):
            return None
        return keys.iloc[self.rows[q, i]].reset_index(drop=True).assign(_q=q, dist=self.dist[q, i])


def _rows_of(vec_pdf, key_names, vec_col, width, nonfinite):
    """The matrix of the vectors and the keys of its rows; the mask."""
    X, mask = _stack(vec_pdf[vec_col], nonfinite)
    if len(X) and X.shape[1] != width:
        raise ValueError(f"vector dimension {X.shape[1]} differs from query dimension {width}")
    keys = vec_pdf.loc[mask, key_names].reset_index(drop=True)
    # Plain strings: rows taken from a chunked string column stay chunked,
    # which Spark does not send back.
    return X, keys.astype({c: object for c in key_names if keys[c].dtype == "str"}), mask


def _kernel(vec_pdf, Q, key_names, vec_col, k, group_name=None, row_chunk=ROW_CHUNK, nonfinite="raise", held=None):
    """Best k per query over ``vec_pdf`` and ``held`` (an earlier result; its
    column ``_q`` numbers the queries), ``row_chunk`` rows at a time."""
    import numpy as np
    import pandas as pd

    if not len(Q):
        _stack(vec_pdf[vec_col], nonfinite)  # a vector that is refused fails all the same
        return held
    X, keys, _ = _rows_of(vec_pdf, key_names, vec_col, Q.shape[1], nonfinite)
    if held is not None:
        keys = pd.concat([keys, held[key_names]], ignore_index=True)
    codes = pd.factorize(keys[group_name], use_na_sentinel=False)[0] if group_name is not None else None
    search = _Search(Q, k, _ranks(keys, key_names), codes)
    if held is not None:
        search.hold(held["_q"].to_numpy(), np.arange(len(X), len(keys)), held["dist"].to_numpy())
    search.add(X, np.arange(len(X)), row_chunk)
    return search.found(keys)


def _with_query_keys(held, qkey_pdf):
    import pandas as pd

    keys = qkey_pdf.iloc[held["_q"].to_numpy()].reset_index(drop=True)
    return pd.concat([keys, held.drop(columns=["_q"]).reset_index(drop=True)], axis=1)


def nonfinite_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector holds a NaN, an infinity or a NULL element."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(bad)


def _out_schema(queries: DataFrame, vectors: DataFrame, query_key, vector_key):
    return T.StructType([queries.schema[c] for c in query_key]
                        + [vectors.schema[c] for c in vector_key]
                        + [T.StructField("dist", T.DoubleType())])


def _final_rank(cands: DataFrame, query_key, vector_key, k, group_col=None) -> DataFrame:
    if group_col is not None:
        wg = Window.partitionBy(*query_key, group_col).orderBy("dist", *vector_key)
        cands = cands.withColumn("_g", F.row_number().over(wg)).filter(F.col("_g") == 1).drop("_g")
    w = Window.partitionBy(*query_key).orderBy("dist", *vector_key)
    return (cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(*query_key, "rank", *vector_key, "dist"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = DEFAULT_TOP_K,
          query_key: list[str] | None = None, vector_key: list[str] | None = None,
          query_col: str = "embedding", vector_col: str = "embedding",
          group_col: str | None = None,
          broadcast_budget: int = BROADCAST_BUDGET_BYTES, row_chunk: int = ROW_CHUNK,
          nonfinite: str = "raise") -> DataFrame:
    """``(query_key..., rank, vector_key..., dist)``: for every query its
    ``k`` nearest vectors (fewer if there are fewer), rank 1 = nearest,
    ties broken by the vector key. ``group_col`` (e.g. the paper id) makes
    the result hold ``k`` distinct groups, each by its nearest vector.
    ``nonfinite`` is ``raise`` or ``skip``, for vectors and queries alike.

    ``queries`` is read twice (its size is checked first): pass a stored
    table when it comes from a costly function."""
    if k <= 0:
        raise ValueError("k must be positive")
    if nonfinite not in ("raise", "skip"):
        raise ValueError("nonfinite must be 'raise' or 'skip'")
    query_key = query_key or ["query_id"]
    vector_key = vector_key or [c for c in vectors.columns if c != vector_col]
    if group_col is not None and group_col not in vector_key:
        raise ValueError("group_col must be one of the vector key columns")
    spark = vectors.sparkSession
    ship_package(spark)
    q = queries.select(*query_key, F.col(query_col).cast("array<double>").alias("_qv")) \
        .filter(F.col("_qv").isNotNull())
    v = vectors.select(*vector_key, F.col(vector_col).alias("_vv"))
    schema = _out_schema(queries, vectors, query_key, vector_key)
    # Size check on the query side before anything is broadcast.
    key_bytes = F.length(F.to_json(F.struct(*query_key))).cast("bigint")
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_qv")).alias("d"),
                  F.sum(key_bytes).alias("b")).first()
    n_q, dim = int(stats["n"]), int(stats["d"] or 0)
    if n_q == 0:
        return spark.createDataFrame([], _out_schema(queries, vectors, query_key, vector_key)
                                     .add("rank", T.IntegerType())).select(*query_key, "rank", *vector_key, "dist")
    row_chunk = max(1, min(row_chunk, BLOCK_BYTES // (8 * max(dim, 1))))
    if n_q * max(dim, 1) * 8 + int(stats["b"]) <= broadcast_budget:
        cands = _broadcast_scan(q, v, query_key, vector_key, k, group_col, schema, row_chunk, nonfinite)
    else:
        cands = _cogroup_scan(q, v, query_key, vector_key, k, group_col, schema, n_q, dim, row_chunk, nonfinite)
    return _final_rank(cands, query_key, vector_key, k, group_col)


def _broadcast_scan(q, v, query_key, vector_key, k, group_col, schema, row_chunk, nonfinite):
    import numpy as np

    spark = v.sparkSession
    rows = q.collect()  # bounded by the budget checked above
    if len({len(r["_qv"]) for r in rows}) > 1:
        raise ValueError("the queries have several dimensions")
    qmat = np.asarray([r["_qv"] for r in rows], dtype=np.float64)
    finite = np.isfinite(qmat).all(axis=1)
    if not finite.all() and nonfinite == "raise":
        raise ValueError(f"{int((~finite).sum())} queries hold NaN, infinite or NULL elements")
    qkeys = [tuple(r[c] for c in query_key) for r, good in zip(rows, finite) if good]
    bq = spark.sparkContext.broadcast((qkeys, qmat[finite]))

    def run(batches):
        import pandas as pd

        keys, Q = bq.value
        qkey_pdf = pd.DataFrame(keys, columns=query_key)
        held, waiting, n = None, [], 0
        for pdf in batches:
            waiting.append(pdf)
            n += len(pdf)
            if n >= GATHER * row_chunk:
                held = _kernel(pd.concat(waiting, ignore_index=True), Q, vector_key, "_vv", k, group_col,
                               row_chunk, nonfinite, held)
                waiting, n = [], 0
        if waiting:
            held = _kernel(pd.concat(waiting, ignore_index=True), Q, vector_key, "_vv", k, group_col,
                           row_chunk, nonfinite, held)
        if held is not None:
            # Query keys beside some rows at a time.
            for s in range(0, len(held), OUT_ROWS):
                yield _with_query_keys(held.iloc[s:s + OUT_ROWS], qkey_pdf)

    return v.mapInPandas(run, schema)


def _cogroup_scan(q, v, query_key, vector_key, k, group_col, schema, n_q, dim, row_chunk, nonfinite):
    n_v = v.count()
    width = 8 * max(dim, 1)
    vb = max(1, math.ceil(n_v * width / CELL_BYTES))
    qb = max(1, math.ceil(n_q * width / CELL_QUERY_BYTES))
    vs = (v.withColumn("_vb", F.pmod(F.xxhash64(*vector_key), F.lit(vb)))
          .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)).cast("array<bigint>"))))
    qs = (q.withColumn("_qb", F.pmod(F.xxhash64(*query_key), F.lit(qb)))
          .withColumn("_vb", F.explode(F.sequence(F.lit(0), F.lit(vb - 1)).cast("array<bigint>"))))

    def cell(vpdf, qpdf):
        import pandas as pd

        held = None
        if len(vpdf) and len(qpdf):
            Q, mask = _stack(qpdf["_qv"], nonfinite)
            qkey_pdf = qpdf.loc[mask, query_key].reset_index(drop=True)
            held = _kernel(vpdf, Q, vector_key, "_vv", k, group_col, row_chunk, nonfinite)
        if held is None:
            return pd.DataFrame()  # no rows
        return _with_query_keys(held, qkey_pdf)[[*query_key, *vector_key, "dist"]]

    return (vs.groupBy("_qb", "_vb").cogroup(qs.groupBy("_qb", "_vb"))
            .applyInPandas(cell, schema))
