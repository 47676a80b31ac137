"""The vector store: scans by agent, dimension checks, index snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import ABSTRACT_LABEL, VECTOR_KEY, VECTOR_SCHEMA
from ..sources.versions import path_exists


def vectors_of_agent(store: DataFrame, agent_name: str, model_name: str, model_spec: str,
                     label: str | None = ABSTRACT_LABEL) -> DataFrame:
    """``(arxiv_id, embedding)`` of one (agent, model, spec) group.

    Equality on the partition columns prunes the store to that folder;
    ``label`` (default the abstract label) is a pushed Parquet filter.
    """
    out = store.filter((F.col("agent_name") == agent_name) & (F.col("model_name") == model_name)
                       & (F.col("model_spec") == model_spec))
    if label is not None:
        out = out.filter(F.col("label") == label)
    return out.select("arxiv_id", "embedding")


def store_groups(store: DataFrame) -> DataFrame:
    """Distinct (agent, model, spec) groups present in the store."""
    return store.select("agent_name", "model_name", "model_spec").distinct()


def dimension_stats(store: DataFrame, col: str = "embedding") -> DataFrame:
    """One row: number of non-NULL vectors and their smallest/largest size."""
    v = store.filter(F.col(col).isNotNull())
    return v.agg(F.count(F.lit(1)).alias("n_vectors"),
                 F.min(F.size(col)).cast("bigint").alias("min_dim"),
                 F.max(F.size(col)).cast("bigint").alias("max_dim"))


def check_uniform_dimension(store: DataFrame, col: str = "embedding") -> int:
    """The common dimension of all vectors; raises when they differ."""
    row = dimension_stats(store, col).first()
    if row["n_vectors"] == 0:
        return 0
    if row["min_dim"] != row["max_dim"]:
        raise ValueError(f"vectors have different dimensions ({row['min_dim']} to {row['max_dim']})")
    return int(row["min_dim"])


def write_snapshot(store: DataFrame, path: str) -> None:
    """Persist the searchable (key, vector) rows; the key travels in the
    row, so no positional list has to stay aligned with a matrix."""
    (store.filter(F.col("embedding").isNotNull()).select(*VECTOR_KEY, "embedding")
     .write.mode("overwrite").parquet(path))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot's rows; an absent one reads as no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], VECTOR_SCHEMA)
    return spark.read.schema(VECTOR_SCHEMA).parquet(path)
