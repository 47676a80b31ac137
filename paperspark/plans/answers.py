"""The answer step: questions in, context, sources and answers out."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions.embed import hash_embed
from ..operators import context as ctx
from ..operators import transform as tf
from ..schemas import DEFAULT_TOP_K
from ..session import staged


class Answers(NamedTuple):
    hits: DataFrame
    answers: DataFrame


def answer_questions(questions: DataFrame, store: DataFrame,
                     papers: DataFrame | Callable[[DataFrame], DataFrame], answer_fn: Callable, embed: str | Callable = "hash", dims: int = 64,
                     k: int = DEFAULT_TOP_K, agent_name: str | None = None,
                     dedupe_papers: bool = False, batch_size: int = 5, embed_batch: int = 20) -> Answers:
    """``questions(question_id, question)`` -> embed -> k nearest stored
    vectors -> their papers -> context text -> ``answer_fn`` (a batch of
    contexts to a batch of answers).

    Returns the hits and ``(question_id, context, sources, answer, error)``.
    A question whose embedding failed keeps its row: context, sources and
    answer are NULL, ``error`` says why, and ``answer_fn`` never sees it.
    Each function sees every question once; results are staged.
    """
    if embed == "hash":
        qv = hash_embed(questions, ["question_id"], "question", dims).withColumn(
            "error", F.lit(None).cast("string"))
    else:
        qv, _ = tf.embed_with(questions, embed, "question", ["question_id"], batch_size=embed_batch, strict=True)
    qv = staged(qv, "question-vectors")
    good = qv.filter(F.col("error").isNull()).drop("error")
    failed = qv.filter(F.col("error").isNotNull()).select(
        "question_id", *[F.lit(None).cast("string").alias(c) for c in ("context", "sources", "answer")], "error")
    hits = ctx.retrieve(good, store, papers, k, ["question_id"], agent_name=agent_name,
                        dedupe_papers=dedupe_papers)
    asked = questions.join(good.select("question_id"), "question_id", "left_semi")
    contexts = staged(ctx.context_text(hits, asked, ["question_id"], "question"), "contexts")
    sources = ctx.context_sources(hits, ["question_id"])
    answered = staged(ctx.answer(contexts, answer_fn, ["question_id"], batch_size), "answers")
    out = (contexts.join(sources, "question_id", "left").join(answered, "question_id", "left")
           .select("question_id", "context", "sources", "answer", "error"))
    return Answers(hits, out.unionByName(failed))
