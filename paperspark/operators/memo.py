"""Compute only what is missing: key-set joins against a keyed table.

``memoised`` is the incremental pattern behind both the summary cache and
the vector cache: rows whose key is stored are read back, the rest are
computed once by a user function, stored (errors excluded), and the union is
returned. The fresh results are staged before they are stored and
returned, so a non-deterministic function (a model call) runs exactly once
per row even though its output is used twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..session import null_join, staged
from ..sources.tables import insert_absent, read_table, upsert


# Bits of a key filter (1 MB, a literal of the plan) and the most keys it is
# made for: at that number every eighth foreign key passes it.
FILTER_BITS = 1 << 23
FILTER_KEYS = 1 << 21
# Bits of one bitmap of Spark's bitmap aggregate.
BITMAP_BITS = 4096 * 8


def _key_bits(key_cols: list[str], bits: int) -> list[Column]:
    """Two bits for a key; equal keys, NULL parts among them, have the same."""
    return [F.pmod(F.xxhash64(*key_cols, *salt), F.lit(bits)) for salt in ([], [F.lit(1)])]


def key_filter(keys: DataFrame, key_cols: list[str]) -> Column | None:
    """A Bloom filter of ``keys`` as a predicate on rows with ``key_cols``:
    true for every one of the keys and for few others. None if there are more
    than ``FILTER_KEYS``.

    The bits are set by Spark's bitmap aggregate; the driver puts together
    ``FILTER_BITS`` of them. As a plain filter it stands at the scan of a store,
    before its rows are shuffled to meet the keys.
    """
    keys = keys.select(*key_cols)
    if keys.limit(FILTER_KEYS + 1).count() > FILTER_KEYS:
        return None
    at = keys.select(F.explode(F.array(*_key_bits(key_cols, FILTER_BITS))).alias("_bit"))
    part = F.floor(F.col("_bit") / BITMAP_BITS).cast("int")
    maps = at.groupBy(part.alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_bit") % BITMAP_BITS + 1)).alias("bits")).collect()
    mask = bytearray(FILTER_BITS // 8)
    for r in maps:
        mask[r["part"] * (BITMAP_BITS // 8):(r["part"] + 1) * (BITMAP_BITS // 8)] = r["bits"]
    held = F.lit(bytes(mask))
    out = F.lit(True)
    for bit in _key_bits(key_cols, FILTER_BITS):
        byte = F.substring(held, F.floor(bit / 8).cast("int") + 1, F.lit(1))
        out = out & (F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1)
    return out


def _probed(keys: DataFrame, table: DataFrame, key_cols: list[str], probe: bool) -> DataFrame:
    """``table`` without most of the rows whose key is not among ``keys``."""
    cond = key_filter(keys, key_cols) if probe else None
    return table if cond is None else table.filter(cond)


def present_keys(keys: DataFrame, table: DataFrame, key_cols: list[str], probe: bool = False) -> DataFrame:
    """Distinct requested keys that the table holds (NULL parts are equal).
    ``probe`` filters the table's scan by the keys first: for a table much
    larger than the batch, whose keys are read once more for it."""
    held = _probed(keys, table, key_cols, probe).select(*key_cols)
    return null_join(keys.select(*key_cols).distinct(), held, key_cols, "left_semi")


def missing_rows(rows: DataFrame, table: DataFrame, key_cols: list[str], probe: bool = False) -> DataFrame:
    """Rows whose key the table does not hold (anti-join); ``probe`` as in
    :func:`present_keys`."""
    return null_join(rows, _probed(rows, table, key_cols, probe).select(*key_cols), key_cols, "left_anti")


def checked_lookup(keys: DataFrame, store: DataFrame, key_cols: list[str], value_col: str,
                   on_missing: str = "raise", probe: bool = False) -> DataFrame:
    """Values for keys known to a separate key index; ``probe`` as in
    :func:`present_keys`.

    A key without a stored value is an integrity error: ``raise`` fails the
    job on the first one, ``flag`` returns it with ``has_value = false``.
    """
    asked = keys.select(*key_cols).distinct()
    held = _probed(keys, store, key_cols, probe).select(*key_cols, value_col)
    joined = null_join(asked, held, key_cols, "left")
    if on_missing == "raise":
        msg = F.concat(F.lit("key in the index has no stored value: "), F.concat_ws(":", *key_cols))
        return joined.withColumn(value_col, F.when(F.col(value_col).isNull(), F.raise_error(msg))
                                 .otherwise(F.col(value_col)))
    if on_missing == "flag":
        return joined.withColumn("has_value", F.col(value_col).isNotNull())
    raise ValueError("on_missing must be 'raise' or 'flag'")


def memoised(rows: DataFrame, key_cols: list[str], compute: Callable[[DataFrame], DataFrame],
             path: str, partition_by: list[str], schema: T.StructType,
             replace: bool = False, partition_values: dict | None = None) -> DataFrame:
    """Stored results for known keys plus freshly computed ones for the rest.

    ``compute(missing_rows)`` returns the schema's columns (plus optionally
    ``error``). Fresh rows without error are written to the table
    (insert-if-absent, or upsert with ``replace=True``). Returns one row per
    requested key with a ``cached`` flag, plus ``error`` for fresh rows that
    failed.

    ``partition_values`` (e.g. ``{"model_name": "hash"}``) states partition
    column values every requested row shares; the stored keys are then read
    from those partitions only.

    Keys in ``rows`` may repeat; a key is computed and returned once, like
    the keys of a dict. NULL key parts equal each other.

    Only keys move until the misses are known; then one pass over ``rows``
    keeps the payload of the missing ones, one row for each, by a join with
    the smaller of the two staged key sets, known or missing.
    """
    for col, val in (partition_values or {}).items():
        # A requested row outside the stated partition is a caller error:
        # fail on it rather than drop it.
        rows = rows.withColumn(col, F.when(F.col(col) == F.lit(val), F.col(col)).otherwise(
            F.raise_error(F.concat(F.lit(f"row outside the stated partition {col}={val}: "),
                                   F.coalesce(F.col(col).cast("string"), F.lit("NULL"))))))

    def fetch(missing: DataFrame, known: DataFrame) -> DataFrame:
        few = missing.count() <= known.count()
        todo = null_join(rows, missing if few else known, key_cols, "left_semi" if few else "left_anti")
        return compute(todo.dropDuplicates(key_cols))

    return memoised_keys(rows.select(*key_cols), key_cols, fetch, path, partition_by, schema, replace,
                         partition_values)


def memoised_keys(keys: DataFrame, key_cols: list[str], compute: Callable[[DataFrame, DataFrame], DataFrame],
                  path: str, partition_by: list[str], schema: T.StructType,
                  replace: bool = False, partition_values: dict | None = None) -> DataFrame:
    """As :func:`memoised`, for keys without their payload:
    ``compute(missing_keys, known_keys)`` gets the distinct keys that the
    table lacks and those it holds (both staged) and fetches what it needs."""
    spark = keys.sparkSession

    def stored() -> DataFrame:
        out = read_table(spark, path, schema)
        for col, val in (partition_values or {}).items():
            if col not in partition_by:
                raise ValueError(f"{col} is not a partition column")
            out = out.filter(F.col(col) == F.lit(val))
        return out

    asked = keys.select(*key_cols).distinct()
    # A table holds a key once, so the join keeps one row for each asked one.
    held = stored().select(*key_cols, F.lit(True).alias("_held"))
    flagged = staged(null_join(asked, held, key_cols, "left").withColumn("_held", F.col("_held").isNotNull()), "keys")
    known = flagged.filter("_held").drop("_held")
    missing = flagged.filter("NOT _held").drop("_held")
    fresh = compute(missing, known)
    if "error" not in fresh.columns:
        fresh = fresh.withColumn("error", F.lit(None).cast("string"))
    cols = [f.name for f in schema.fields]
    fresh = staged(fresh.select(*cols, "error"), "fresh")
    good = fresh.filter(F.col("error").isNull()).select(*cols)
    # What the known keys hold is read from the version before the write.
    hits = null_join(stored(), known, key_cols, "left_semi").select(
        *cols, F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    if replace:
        upsert(good, path, key_cols, partition_by, schema, materialized=True)
    else:
        insert_absent(good, path, key_cols, partition_by, schema, materialized=True)
    return hits.unionByName(fresh.withColumn("cached", F.lit(False)))
