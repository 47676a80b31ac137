"""Retrieval of papers for questions and assembly of the answer context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..schemas import DEFAULT_TOP_K, VECTOR_KEY
from ..session import staged
from .knn import top_k

# --- Fixed values: the text layout of a question's context -----------------
QUESTION_HEADER = "Question: {question}\n\n"
CONTEXT_HEADER = "Context:\n"
CONTEXT_BLOCK = "arXiv:{id}\nAbstract: {abstract}\n\n"
SOURCE_LINE = "- arXiv:{id} Title: {title}"
# ---------------------------------------------------------------------------


def retrieve(questions: DataFrame, store: DataFrame, papers: DataFrame | Callable[[DataFrame], DataFrame],
             k: int = DEFAULT_TOP_K,
             question_key: list[str] | None = None, question_vec: str = "embedding",
             agent_name: str | None = None, dedupe_papers: bool = False,
             paper_fields: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """``(question_key..., rank, arxiv_id, dist, <paper_fields>)``.

    The k nearest stored vectors per question (optionally of one agent; with
    ``dedupe_papers`` k distinct papers, each by its nearest vector), joined
    to the papers they belong to. The rank travels with each hit. ``papers``
    is a DataFrame, or a function that gives the papers of the ids in a
    one-column DataFrame (``sources.corpus_store.stored_papers`` reads only
    the row groups that may hold them).
    """
    question_key = question_key or ["question_id"]
    vecs = store if agent_name is None else store.filter(F.col("agent_name") == agent_name)
    hits = top_k(questions, vecs, k, query_key=question_key, vector_key=list(VECTOR_KEY),
                 query_col=question_vec, vector_col="embedding",
                 group_col="arxiv_id" if dedupe_papers else None)
    # The hits are small (questions x k rows) and costly: staged once, alone
    # for the semi-join below and then with their papers' fields.
    hits = staged(hits, "hits")
    # The semi-join on the hit ids is pushed below a de-duplicating
    # aggregate in ``papers`` (its grouping key is the id), so only the
    # retrieved papers are de-duplicated and joined.
    hit_ids = hits.select(F.col("arxiv_id").alias("id")).distinct()
    found = papers.join(hit_ids, "id", "left_semi") if isinstance(papers, DataFrame) else papers(hit_ids)
    pap = found.select(F.col("id").alias("arxiv_id"), *paper_fields)
    return staged(hits.join(pap, "arxiv_id", "inner")
                  .select(*question_key, "rank", "arxiv_id", "dist", *paper_fields), "paper-hits")


def _fmt(template: str, **cols) -> F.Column:
    """``template`` with ``{name}`` fields replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            parts.append(F.lit(pre))
        parts.append(cols[name].cast("string"))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def context_text(hits: DataFrame, questions: DataFrame, question_key: list[str] | None = None,
                 question_col: str = "question") -> DataFrame:
    """``(question_key..., context)``: header plus one block per retrieved
    paper in rank order. Each list holds at most k entries."""
    question_key = question_key or ["question_id"]
    blocks = hits.select(*question_key, "rank",
                         _fmt(CONTEXT_BLOCK, id=F.col("arxiv_id"), abstract=F.col("abstract")).alias("_b"))
    per_q = blocks.groupBy(*question_key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_b"))), lambda e: e["_b"]),
                     "").alias("_blocks"))
    q = questions.select(*question_key, F.col(question_col).alias("_q"))
    return (q.join(per_q, question_key, "left")
            .select(*question_key,
                    F.concat(_fmt(QUESTION_HEADER, question=F.col("_q")), F.lit(CONTEXT_HEADER),
                             F.coalesce(F.col("_blocks"), F.lit(""))).alias("context")))


def context_sources(hits: DataFrame, question_key: list[str] | None = None) -> DataFrame:
    """``(question_key..., sources)``: one line per retrieved paper, in rank order."""
    question_key = question_key or ["question_id"]
    lines = hits.select(*question_key, "rank",
                        _fmt(SOURCE_LINE, id=F.col("arxiv_id"), title=F.col("title")).alias("_l"))
    return lines.groupBy(*question_key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_l"))), lambda e: e["_l"]),
                     "\n").alias("sources"))


def answer(contexts: DataFrame, fn, question_key: list[str] | None = None,
           batch_size: int = 5) -> DataFrame:
    """Run a user answer function (list of context texts -> list of
    answers) over the contexts in batches."""
    from pyspark.sql import types as T

    from .transform import apply_batched

    question_key = question_key or ["question_id"]
    return apply_batched(contexts, fn, "context", "answer", T.StringType(), batch_size,
                         keep_cols=question_key)
