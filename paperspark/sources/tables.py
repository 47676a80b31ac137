"""Keyed Parquet tables: create if absent, upsert, insert if absent.

A table is partitioned by a few low-cardinality columns (summarizer and
model, or agent/model/spec) and, below them, by a hash bucket of the other key
parts. A write reads and writes only the leaves (partition and bucket) that
its rows fall into: new leaf folders are written beside the old ones and the
new version is published in one step (see ``versions``), so a write that
fails or is killed anywhere leaves the table as it was. One writer per table
at a time; a second one fails when it publishes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from ..session import STORED_CODEC, apply_required_conf, null_join, shuffles_dropped, staged
from .versions import drop_old, hadoop_path, new_folder, path_exists, publish, read_state

ORDER = "_order"
BUCKET = "bucket"
VERSION = "_version"
# Buckets of every partition of a new table. A leaf is rewritten as a whole by
# one task: choose (bytes of the largest partition) / 256 MB.
DEFAULT_BUCKETS = 16

__all__ = ["create_table", "read_table", "upsert", "insert_absent", "path_exists", "drop_old", "leaf_paths"]


def _fresh_state(buckets: int) -> dict:
    return {"version": 0, "buckets": int(buckets), "leaves": {}, "folders": {}}


def leaf_paths(path: str, state: dict, leaves=None) -> list[str]:
    """Folders to read for some leaves (all by default). A data folder whose
    leaves are all wanted is read from its top."""
    wanted: dict[str, list[str]] = {}
    for leaf in state["leaves"] if leaves is None else leaves:
        for folder in state["leaves"].get(leaf, ()):
            wanted.setdefault(folder, []).append(leaf)
    out = []
    for folder, found in sorted(wanted.items()):
        top = f"{path}/{VERSION}={folder}"
        out += [top] if len(found) == state["folders"][folder] else [f"{top}/{leaf}" for leaf in sorted(found)]
    return out


def _read(spark: SparkSession, path: str, schema: T.StructType, state: dict | None, leaves=None) -> DataFrame:
    paths = leaf_paths(path, state, leaves) if state else []
    if not paths:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField(VERSION, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
    return spark.read.schema(whole).option("basePath", path).parquet(*paths).select(*schema.names)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest version's rows; a table without any reads as no rows. Later
    writes do not change what this DataFrame reads."""
    return _read(spark, path, schema, read_state(spark, path))


def create_table(spark: SparkSession, path: str, schema: T.StructType,
                 partition_by: list[str], buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Publish an empty table if there is none (no-op when there is one) and
    return its rows."""
    if read_state(spark, path) is None:
        publish(spark, path, _fresh_state(buckets))
    return read_table(spark, path, schema)


def _bucket(key_cols: list[str], partition_by: list[str], buckets: int):
    """Bucket of a row: by the key parts that are no partition columns."""
    rest = [c for c in key_cols if c not in partition_by]
    return F.pmod(F.xxhash64(*(rest or key_cols)), F.lit(buckets)).cast("int")


def _leaves_of(rows: DataFrame, partition_by: list[str]) -> list[str]:
    """Folder names of the leaves that rows fall into: as many as Spark's
    partitioned writer creates."""
    cols = [*partition_by, BUCKET]
    found = rows.select(*[F.col(c).cast("string").alias(c) for c in cols]).distinct().collect()
    name = rows.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    known: dict[tuple[str, str | None], str] = {}
    for c in cols:
        for value in {r[c] for r in found}:
            known[c, value] = name(c, value)
    return sorted({"/".join(known[c, r[c]] for c in cols) for r in found})


def _written_leaves(spark: SparkSession, path: str, folder: str, partition_by: list[str]) -> list[str]:
    top = f"{path}/{VERSION}={folder}"
    depth = len(partition_by) + 1
    fs, pattern = hadoop_path(spark, top + "/*=*" * depth)
    paths = (s.getPath() for s in fs.globStatus(pattern) or ())
    return ["/".join(p.toUri().getPath().split("/")[-depth:]) for p in paths]


def _write(rows: DataFrame, path: str, state: dict, partition_by: list[str], replace: bool) -> None:
    """Write rows as leaves of a new data folder and publish the table with
    them: in place of what those leaves held, or beside it."""
    folder = new_folder(state["version"] + 1)
    _write_leaves(rows, f"{path}/{VERSION}={folder}", partition_by)
    _publish(rows.sparkSession, path, state, folder, partition_by, replace)


def _write_leaves(rows: DataFrame, top: str, partition_by: list[str]) -> None:
    with shuffles_dropped(rows.sparkSession):
        rows.write.partitionBy(*partition_by, BUCKET).option("compression", STORED_CODEC).parquet(top)


def _publish(spark: SparkSession, path: str, state: dict, folder: str, partition_by: list[str], replace: bool) -> None:
    version = state["version"] + 1
    leaves = {k: list(v) for k, v in state["leaves"].items()}
    made = _written_leaves(spark, path, folder, partition_by)
    for leaf in made:
        leaves[leaf] = [folder] if replace else [*leaves.get(leaf, ()), folder]
    sizes = state["folders"] | {folder: len(made)}
    live = {f for held in leaves.values() for f in held}
    publish(spark, path, {**state, "version": version, "leaves": leaves,
                          "folders": {f: n for f, n in sizes.items() if f in live}})


def _with_order(df: DataFrame, order_col: str | None) -> DataFrame:
    if order_col is None:
        return df.withColumn(ORDER, F.lit(0).cast("bigint"))
    return df.withColumn(ORDER, F.col(order_col))


def _repeats(inc: DataFrame, key_cols: list[str], order_col: str | None) -> bool:
    """Whether a batch holds a key twice, which it may not without an order.
    Only keys are read."""
    found = inc.groupBy(*key_cols).count().filter("count > 1").limit(1).count() > 0
    if found and order_col is None:
        raise ValueError("the batch repeats a key; name the column that orders its rows")
    return found


def upsert(incoming: DataFrame, path: str, key_cols: list[str], partition_by: list[str],
           schema: T.StructType, order_col: str | None = None,
           stamp_col: str | None = None, materialized: bool = False, buckets: int = DEFAULT_BUCKETS) -> int:
    """Insert or replace rows by key; returns the number of rows offered.

    Within the batch the last row per key wins by ``order_col``, which a
    batch with repeated keys must name; an incoming row replaces a stored
    one. NULL key parts equal each other. ``stamp_col`` is set to the current
    time, whole seconds. ``buckets`` holds for a table that this creates.

    The batch is staged once as Parquet in the shared folder (skipped with
    ``materialized=True`` when the caller already did), so an expensive or
    non-deterministic producer (a model call) runs once. The leaves its rows
    fall into are read, merged and written anew after one shuffle by leaf;
    no other leaf is read. Keys are compared first: whole rows are sorted to
    find the last of a key only if the batch repeats one. The first batch of a
    table is written as its leaves at once, and published if no key repeats.
    """
    spark = incoming.sparkSession
    apply_required_conf(spark)
    state = read_state(spark, path) or _fresh_state(buckets)
    value_cols = [f.name for f in schema.fields if f.name not in key_cols]
    inc = _with_order(incoming, order_col)
    if stamp_col:
        inc = inc.withColumn(stamp_col, F.date_trunc("second", F.current_timestamp()))
    inc = inc.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields],
                     F.col(ORDER).cast("bigint").alias(ORDER))
    bucket = _bucket(key_cols, partition_by, state["buckets"])
    if not materialized and order_col is None and not state["leaves"]:
        folder = new_folder(state["version"] + 1)
        top = f"{path}/{VERSION}={folder}"
        _write_leaves(inc.drop(ORDER).withColumn(BUCKET, bucket).repartition(*partition_by, BUCKET), top, partition_by)
        made = spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(top)
        offered = made.count()
        if offered:
            _repeats(made, key_cols, order_col)
            _publish(spark, path, state, folder, partition_by, replace=True)
        return offered
    if not materialized:
        inc = staged(inc, "upsert-batch")
    offered = inc.count()
    if offered == 0:
        return 0
    repeats = _repeats(inc, key_cols, order_col)
    existing = _read(spark, path, schema, state, _leaves_of(inc.withColumn(BUCKET, bucket), partition_by))
    both = (existing.withColumn("_prio", F.lit(0)).withColumn(ORDER, F.lit(0).cast("bigint"))
            .unionByName(inc.withColumn("_prio", F.lit(1))).withColumn(BUCKET, bucket))
    leaf = [*partition_by, BUCKET]
    if not repeats:
        kept = null_join(existing, inc.select(*key_cols), key_cols, "left_anti")
        rows = kept.select(*schema.names).unionByName(inc.select(*schema.names)).withColumn(BUCKET, bucket)
        _write(rows.repartition(*leaf), path, state, partition_by, replace=True)
        return offered
    # The shuffle by leaf also serves the aggregate, whose keys hold it.
    merged = (both.repartition(*leaf).groupBy(*leaf, *[c for c in key_cols if c not in leaf])
              .agg(F.max_by(F.struct(*value_cols), F.struct("_prio", ORDER)).alias("_v"))
              .select(*key_cols, BUCKET, *[F.col(f"_v.{c}").alias(c) for c in value_cols])
              .select(*schema.names, BUCKET))
    _write(merged, path, state, partition_by, replace=True)
    return offered


def insert_absent(incoming: DataFrame, path: str, key_cols: list[str], partition_by: list[str],
                  schema: T.StructType, order_col: str | None = None, materialized: bool = False,
                  buckets: int = DEFAULT_BUCKETS) -> int:
    """Insert rows whose key is not stored yet (the first row per key in the
    batch wins by ``order_col``, which a batch with repeated keys must name);
    stored rows are never changed. NULL key parts equal each other. Returns
    rows inserted. The batch is staged (unless ``materialized``); the stored
    keys are read only from the leaves it falls into, and the new rows are put
    beside them."""
    spark = incoming.sparkSession
    apply_required_conf(spark)
    state = read_state(spark, path) or _fresh_state(buckets)
    value_cols = [f.name for f in schema.fields if f.name not in key_cols]
    inc = _with_order(incoming, order_col).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], ORDER)
    if not materialized:
        inc = staged(inc, "insert-batch")
    bucket = _bucket(key_cols, partition_by, state["buckets"])
    first = inc.select(*schema.names)
    if _repeats(inc, key_cols, order_col):
        first = (inc.groupBy(*key_cols)
                 .agg(F.min_by(F.struct(*value_cols), F.col(ORDER)).alias("_v"))
                 .select(*key_cols, *[F.col(f"_v.{c}").alias(c) for c in value_cols]))
    leaves = _leaves_of(inc.select(*key_cols).withColumn(BUCKET, bucket), partition_by)
    stored = _read(spark, path, schema, state, leaves).select(*key_cols)
    obs = Observation("inserted")
    new = (null_join(first, stored, key_cols, "left_anti").select(*schema.names).withColumn(BUCKET, bucket)
           .repartition(*partition_by, BUCKET).observe(obs, F.count(F.lit(1)).alias("n")))
    _write(new, path, state, partition_by, replace=False)
    return int(obs.get["n"])
