"""A deterministic built-in embedder written with DataFrame operations.

Feature hashing: a text is lower-cased and cut into runs of letters and
digits; every token adds one to the bucket chosen by its MD5 hash. It needs
no model and no Python per row, so it can stand in for a remote embedding
service in tests and offline runs. Users with a real model pass a function
to :func:`paperspark.operators.transform.embed_with` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.array_remove(F.split(F.lower(c), TOKEN_SPLIT), "")


def token_bucket(word: Column, dims: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint"), F.lit(dims))


def hash_embed(df: DataFrame, key_cols: list[str], text_col: str, dims: int = 64,
               out_col: str = "embedding", partitions: int | None = None) -> DataFrame:
    """``key_cols + [out_col]``: dense ``array<double>`` of token counts per
    bucket for each row's text.

    ``partitions`` deals keys and texts out to so many tasks first, by key:
    for input in few splits (a file of one row group), where the array work
    would be left to one core. Large inputs have splits enough and need none.

    Computed inside the row, with no per-token explode and no shuffle: the token
    buckets plus one copy of every bucket id are sorted natively; the count
    of bucket ``b`` is then the distance between the first positions of
    ``b`` and ``b + 1``, minus the added copy. Each intermediate array comes
    out of a one-row ``explode``: the optimizer can neither inline it into a
    lambda (which would rebuild it for every element) nor push a filter on
    the result below it.
    """
    if partitions:
        df = df.select(*key_cols, text_col).repartition(partitions, *key_cols)
    all_ids = F.sequence(F.lit(0), F.lit(dims - 1)).cast("array<bigint>")
    buckets = F.transform(tokens(text_col), lambda w: token_bucket(w, dims))
    srt = df.select(*key_cols, F.explode(F.array(F.sort_array(F.concat(
        F.coalesce(buckets, F.array().cast("array<bigint>")), all_ids)))).alias("_s"))
    s = F.col("_s")
    first = srt.select(*key_cols, F.explode(F.array(F.transform(
        F.sequence(F.lit(0), F.lit(dims)),
        lambda b: F.when(b == dims, F.size(s) + 1).otherwise(F.array_position(s, b.cast("bigint"))),
    ))).alias("_f"))
    f = F.col("_f")
    return first.select(*key_cols, F.transform(
        F.sequence(F.lit(1), F.lit(dims)),
        lambda j: (F.element_at(f, j + 1) - F.element_at(f, j) - 1).cast("double"),
    ).alias(out_col))
