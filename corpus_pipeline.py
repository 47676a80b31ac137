"""From raw documents to token ids, in five stages.

Every stage works on all that its predecessor kept and returns the columns of
``documents``; the last one returns token ids. A verdict holds for one row:
rows without an id, and rows that repeat one, get keys of their own. Empty
tables pass through as empty tables, and other columns, whatever their names,
are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperspark.llm import bpe, decontaminate, jaccard_join, passage_dedup, quality_rules
from paperspark.llm.common import BROADCAST_ROWS, fresh_name, prepare, staged, table

# Near copies share so many percent of their runs of so many words.
NEAR_PERCENT, NEAR_WORDS = 80, 5


def with_row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with an integer of its own for every row, and that column's
    name: the id, or for a row whose id is null or repeated a number beyond
    all ids. New columns get names that ``docs`` does not use."""
    key = fresh_name(docs, "__row")
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    again = staged(ids.where("doc_id IS NULL OR n > 1").select(F.col("doc_id").alias("id")), "again")
    if not again.count():
        return docs.withColumn(key, F.col("doc_id")), key
    # Staged, so that a row keeps its number. Null ids stay out of the join,
    # where all of them would be one key.
    number, other = fresh_name(docs, "__n"), fresh_name(docs, "__id")
    rows = staged(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    again = again.where("id IS NOT NULL").withColumnRenamed("id", other)
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    low, high, last = rows.agg(F.min("doc_id"), F.max("doc_id"), F.max(number)).first()
    low, high = (0, 0) if low is None else (low, high)
    if high + 1 + last < 1 << 63:
        fresh = F.lit(high + 1) + F.col(number)
    elif low - 1 - last >= -1 << 63:
        fresh = F.lit(low - 1) - F.col(number)
    else:
        raise ValueError("ids leave no room for the keys of rows without an id of their own")
    known = rows.where("doc_id IS NOT NULL").join(again, F.col("doc_id") == F.col(other), "left").withColumn(
        key, F.when(F.col(other).isNull(), F.col("doc_id")).otherwise(fresh)).drop(other)
    keyed = known.unionByName(rows.where("doc_id IS NULL").withColumn(key, fresh)).drop(number)
    return staged(keyed, "keyed"), key


def without(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose key is in ``ids(doc_id)``, and less the key."""
    gone = staged(ids.select(F.col("doc_id").alias(key)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, key, "left_anti").select(*[f"`{c}`" for c in docs.columns if c != key])


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    prepare(spark)
    docs, key = with_row_keys(docs)
    return without(docs, key, quality_rules.judge(docs, id_col=key).where("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by shingles, the one of least key stays."""
    prepare(spark)
    docs, key = with_row_keys(docs)
    found = jaccard_join.similar_components(docs, percent=NEAR_PERCENT, shingle_words=NEAR_WORDS, id_col=key)
    return without(docs, key, found.where("doc_id != component_id"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages stay only in the first document that holds them."""
    prepare(spark)
    keyed, key = with_row_keys(docs)
    held = fresh_name(keyed, "__id")
    cut = passage_dedup.without_passages(keyed.withColumnsRenamed({"doc_id": held, key: "doc_id"}))
    return cut.drop("doc_id").withColumnRenamed(held, "doc_id").select(*[f"`{c}`" for c in docs.columns])


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs, key = with_row_keys(docs)
    return without(docs, key, decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"), id_col=key))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the text they decode to."""
    prepare(spark)
    return bpe.decode(bpe.encode(docs)).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_overlaps),
    ("BPE encoding and decoding", encode_tokens),
]

# Chained passages and byte-pair merges have no SQL form; the pipeline is
# tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared
    folder and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
