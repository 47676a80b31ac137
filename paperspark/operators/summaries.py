"""The summaries table: write, read, and look up by any part of the key.

Key = (summarizer_name, full_model_name, arxiv_id); the table is
partitioned by (summarizer_name, full_model_name), so lookups by summarizer
or model prune folders and lookups by paper use Parquet statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import full_model_name
from ..schemas import SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA
from ..sources.tables import create_table, read_table, upsert
from .grouping import chunked_lists

# Most lookup keys that are sent to every task.
BROADCAST_KEYS = 50_000

SUMMARY_COLS = ["summarizer_name", "full_model_name", "arxiv_id", "summary_text"]


def create_summaries_table(spark: SparkSession, path: str) -> DataFrame:
    return create_table(spark, path, SUMMARY_SCHEMA, SUMMARY_PARTITIONS)


def all_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Every stored summary (the time stamp is not projected)."""
    return read_table(spark, path, SUMMARY_SCHEMA).select(*SUMMARY_COLS)


def cache_summaries(summaries: DataFrame, path: str, model_name: str | None = None,
                    model_spec: str | None = None, order_col: str | None = None) -> int:
    """Insert or replace summaries; returns the number of rows offered.

    ``summaries`` has summarizer_name, arxiv_id, summary_text and either
    full_model_name or the ``model_name``/``model_spec`` arguments. Rows with
    a non-NULL ``error`` column are never stored.
    """
    df = summaries
    if "error" in df.columns:
        df = df.filter(F.col("error").isNull())
    if "full_model_name" not in df.columns:
        if model_name is None or model_spec is None:
            raise ValueError("full_model_name column or model_name and model_spec are required")
        df = df.withColumn("full_model_name", full_model_name(F.lit(model_name), F.lit(model_spec)))
    return upsert(df, path, SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA,
                  order_col=order_col, stamp_col="timestamp")


def check_key_subset(keys) -> list[str]:
    """A non-empty subset of the key, in the key's own order."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys:
        raise ValueError("a lookup needs at least one key column")
    unknown = [k for k in keys if k not in SUMMARY_KEY]
    if unknown:
        raise ValueError(f"not part of the summary key: {', '.join(unknown)}")
    if len(set(keys)) != len(keys):
        raise ValueError("a key column is given twice")
    expected = [k for k in SUMMARY_KEY if k in keys]
    if keys != expected:
        raise ValueError(f"give the key columns as: {', '.join(expected)}")
    return keys


def lookup_summaries(table: DataFrame, keys=None, values=None) -> DataFrame:
    """Summaries matching lookup values on a subset of the key.

    ``keys``: None means the full key. ``values``: one tuple, a list of
    tuples, or a DataFrame with the key columns; None returns every row.
    It is a bag join: a value given twice returns its rows twice, as the
    concatenated point lookups would. Values are counted per key first. Up to
    ``BROADCAST_KEYS`` of them go to the table's scan; more are hashed in each
    partition, so that texts are shuffled once and never sorted.
    """
    rows = table.select(*SUMMARY_COLS)
    if values is None:
        return rows
    keys = check_key_subset(SUMMARY_KEY if keys is None else keys)
    if isinstance(values, DataFrame):
        vals = values.select(*keys)
    else:
        vals_list = [values] if isinstance(values, tuple) else list(values)
        if not vals_list:
            return rows.limit(0)
        spark = table.sparkSession
        vals = spark.createDataFrame([tuple(v) for v in vals_list],
                                     ", ".join(f"{k} string" for k in keys))
    if len(keys) == 1 and not isinstance(values, DataFrame) and len(vals_list) == 1:
        return rows.filter(F.col(keys[0]) == F.lit(vals_list[0][0]))
    asked = vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"))
    few = asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    found = rows.join(F.broadcast(asked) if few else asked.hint("shuffle_hash"), keys, "inner")
    return found.select(*SUMMARY_COLS, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).drop("_copy")


def filter_summaries(table: DataFrame, summarizer_name: str | None = None,
                     full_model_name: str | None = None, arxiv_id: str | None = None) -> DataFrame:
    """Point selection by literal key parts (partition pruning on the first
    two, pushed Parquet filters on the paper id)."""
    out = table.select(*SUMMARY_COLS)
    for col, val in (("summarizer_name", summarizer_name), ("full_model_name", full_model_name),
                     ("arxiv_id", arxiv_id)):
        if val is not None:
            out = out.filter(F.col(col) == F.lit(val))
    return out


def summaries_by_summarizer(table: DataFrame, chunk: int = 10_000) -> DataFrame:
    """(summarizer_name, part, n_items, items): (arxiv_id, summary_text)
    pairs per summarizer in paper order, in chunks of at most ``chunk``.
    ``table`` is a stored table."""
    return chunked_lists(table, ["summarizer_name"],
                         F.struct("arxiv_id", "summary_text"), order="arxiv_id", chunk=chunk, stored=True)


# --- Fixed values: names of the lookup queries over the summary table ------
QUERY_NAMES = [
    "select-summaries-by-primary-key",
    "select-all-summaries",
    "select-summaries-by-full-model",
    "select-summaries-by-summarizer",
    "select-summaries-by-arxiv-id",
    "select-summaries-by-full-model-and-arxiv-id",
    "select-summaries-by-summarizer-and-full-model",
    "select-summaries-by-summarizer-and-arxiv-id",
    "select-summaries-by-summarizer-and-full-model-and-arxiv-id",
]
# ---------------------------------------------------------------------------

# Each name says which key parts are bound, in key order, to positional
# ``?`` markers of a query over a view called ``summaries``.
_NAME_PARTS = {"summarizer": "summarizer_name", "full-model": "full_model_name",
               "arxiv-id": "arxiv_id"}


def named_query_text(name: str) -> str:
    """SQL text of a named lookup, e.g. ``select-summaries-by-summarizer-and-arxiv-id``."""
    if name not in QUERY_NAMES:
        raise ValueError(f"no lookup is called {name!r}")
    cols = ", ".join(SUMMARY_COLS)
    if name == "select-all-summaries":
        return f"SELECT {cols} FROM summaries"
    if name == "select-summaries-by-primary-key":
        return f"SELECT {cols} FROM summaries WHERE (summarizer_name, full_model_name, arxiv_id) IN ((?, ?, ?))"
    prefix = "select-summaries-by-"
    if not name.startswith(prefix):
        raise ValueError(f"no lookup is called {name!r}")
    parts = name[len(prefix):].split("-and-")
    if any(p not in _NAME_PARTS for p in parts):
        raise ValueError(f"no lookup is called {name!r}")
    key_cols = check_key_subset([_NAME_PARTS[p] for p in parts])
    where = " AND ".join(f"{c} = ?" for c in key_cols)
    return f"SELECT {cols} FROM summaries WHERE {where}"


def run_named(spark: SparkSession, name: str, args: list | tuple = ()) -> DataFrame:
    """Run a named lookup with positional parameters against ``summaries``."""
    return spark.sql(named_query_text(name), args=list(args))
