"""The corpus build: from metadata lines to a searchable vector snapshot.

index (build if absent) -> select by category and time -> load the selected
papers -> summarise what the summary table lacks -> store -> embed what the
vector table lacks -> store -> snapshot the searchable rows. Every step is a
DataFrame plan; the three tables are the stage boundaries, so a rerun only
computes what is new.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.embed import hash_embed
from ..functions.keys import full_model_name
from ..operators import index as ix
from ..operators import memo
from ..operators import transform as tf
from ..operators.vectors import check_uniform_dimension, write_snapshot
from ..schemas import (
    ABSTRACT_LABEL, SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA, VECTOR_KEY, VECTOR_PARTITIONS,
    VECTOR_SCHEMA,
)
from ..sources import papers as pp
from ..sources.corpus_store import refresh, stored_index, stored_papers


class CorpusPaths(NamedTuple):
    index: str
    summaries: str
    vectors: str
    snapshot: str


class Corpus(NamedTuple):
    papers: DataFrame
    summaries: DataFrame
    rejected_texts: DataFrame
    vectors: DataFrame
    snapshot: DataFrame


def summarise_missing(papers: DataFrame, agents: DataFrame, fn_for_agent, summaries_path: str,
                      model_name: str, model_spec: str, agent_class: str = "summarizer",
                      agent_name: str | None = None, batch_size: int = 20) -> DataFrame:
    """Summaries of every (agent, paper): stored ones read back, the rest
    computed by the agents' functions, stored, and returned with them.

    Keys are fanned out to the agents, never texts: the missing ones fetch
    their texts by one join, and a text is read once for all of its agents.
    ``papers`` holds an id once."""
    rows = tf.agent_rows(agents, agent_class, agent_name)
    fns = {r.agent_name: fn_for_agent(r.agent_name, r.instructions) for r in rows}
    full = f"{model_name}:{model_spec}"
    model = full_model_name(F.lit(model_name), F.lit(model_spec))
    keys = (tf.agent_keys(papers, list(fns), ["id"], "summarizer_name")
            .select("summarizer_name", model.alias("full_model_name"), F.col("id").alias("arxiv_id")))

    def compute(missing: DataFrame, known: DataFrame) -> DataFrame:
        # Each text once, beside the agents that still have to read it.
        todo = missing.groupBy("arxiv_id").agg(F.sort_array(F.collect_set("summarizer_name")).alias("_todo"))
        texts = papers.select(F.col("id").alias("arxiv_id"), "abstract").join(todo, "arxiv_id")
        out = tf.run_agents(texts, fns, ["arxiv_id"], "abstract", "_todo", batch_size, agent_col="summarizer_name")
        return (out.withColumn("full_model_name", F.lit(full))
                .withColumn("timestamp", F.date_trunc("second", F.current_timestamp())))

    return memo.memoised_keys(keys, SUMMARY_KEY, compute, summaries_path, SUMMARY_PARTITIONS, SUMMARY_SCHEMA,
                              partition_values={"full_model_name": full})


def embed_missing(texts: DataFrame, vectors_path: str, embed: str | Callable = "hash", dims: int = 64,
                  batch_size: int = 20, strict: bool = False,
                  partition_values: dict | None = None, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors of keyed texts (``VECTOR_KEY`` + ``text``): stored ones read
    back, the valid rest embedded and stored. Returns (vectors, rejected)."""
    valid, rejected = tf.split_valid(texts, "text", strict)

    def compute(todo: DataFrame) -> DataFrame:
        if embed == "hash":
            return hash_embed(todo, list(VECTOR_KEY), "text", dims, partitions=partitions)
        vecs, _ = tf.embed_with(todo, embed, "text", list(VECTOR_KEY), batch_size)
        return vecs

    vecs = memo.memoised(valid, list(VECTOR_KEY), compute, vectors_path, VECTOR_PARTITIONS, VECTOR_SCHEMA,
                         partition_values=partition_values)
    return vecs, rejected


def build_corpus(spark: SparkSession, lines, paths: CorpusPaths, categories, date_range,
                 agents: DataFrame, fn_for_agent, model: tuple[str, str],
                 embed_model: tuple[str, str], embed: str | Callable = "hash",
                 agent_name: str | None = None, rebuild_index: bool = False,
                 embed_partitions: int | None = None) -> Corpus:
    """Run the whole build; ``lines`` are NDJSON files or folders, or a lines
    DataFrame.

    Files are kept as a stored corpus at ``paths.index`` (see
    ``sources.corpus_store``): only new or changed ones are parsed, and
    selected papers are read by id. A DataFrame of lines is indexed once.
    """
    if isinstance(lines, DataFrame):
        index = ix.load_or_build_index(spark, paths.index, lines, rebuild=rebuild_index)
        ids = ix.selected_ids(ix.select_papers(index, categories, date_range))
        papers = pp.load_papers(pp.parse_lines(lines).records, ["title", "abstract"], ids=ids)
    else:
        refresh(spark, paths.index, lines, rebuild=rebuild_index)
        selection = ix.select_papers(stored_index(spark, paths.index), categories, date_range)
        papers = stored_papers(spark, paths.index, ["title", "abstract"], ix.selected_ids(selection))
    summaries = summarise_missing(papers, agents, fn_for_agent, paths.summaries, *model,
                                  agent_name=agent_name)
    good = summaries.filter(F.col("error").isNull())
    texts = good.select(F.col("summarizer_name").alias("agent_name"),
                        F.lit(embed_model[0].lower()).alias("model_name"),
                        F.lit(embed_model[1]).alias("model_spec"), "arxiv_id",
                        F.lit(ABSTRACT_LABEL).alias("label"), F.col("summary_text").alias("text"))
    vectors, rejected = embed_missing(texts, paths.vectors, embed, partition_values={
        "model_name": embed_model[0].lower(), "model_spec": embed_model[1]}, partitions=embed_partitions)
    # One dimension for the whole snapshot, checked before it is written.
    check_uniform_dimension(vectors.filter(F.col("error").isNull()))
    searchable = vectors.filter(F.col("error").isNull()).select(*VECTOR_KEY, "embedding")
    write_snapshot(searchable, paths.snapshot)
    snapshot = spark.read.parquet(paths.snapshot)
    return Corpus(papers, summaries, rejected, vectors, snapshot)
