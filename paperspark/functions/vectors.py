"""Vector expressions evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squared_l2(a, b) -> Column:
    """Squared Euclidean distance summed left to right in double precision.

    NULL when either side is NULL or the dimensions differ (callers check
    dimensions separately and raise).
    """
    x, y = _c(a), _c(b)
    diffs = F.zip_with(x, y, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))
    dist = F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, v: acc + v)
    return F.when(F.size(x) == F.size(y), dist)
