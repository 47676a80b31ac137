"""Top-k against brute force, text validity, batched functions, plans."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .conftest import SF_SMALL
from paperspark.functions.text import text_validity
from paperspark.functions.vectors import squared_l2
from paperspark.operators import transform as tf
from paperspark.operators.context import context_sources, context_text
from paperspark.operators.knn import top_k


def brute(queries, vectors, k, group=None):
    out = {}
    for qid, q in queries:
        scored = []
        for key, paper, v in vectors:
            if v is None:
                continue
            d = 0.0
            for a, b in zip(v, q):
                d = d + (float(a) - float(b)) * (float(a) - float(b))
            scored.append((d, key, paper))
        scored.sort()
        if group:
            seen, kept = set(), []
            for s in scored:
                if s[2] not in seen:
                    seen.add(s[2])
                    kept.append(s)
            scored = kept
        out[qid] = [(s[1], s[0]) for s in scored[:k]]
    return out


def run_topk(spark, queries, vectors, k, group=False, budget=None, row_chunk=None):
    qdf = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    vdf = spark.createDataFrame(vectors, "key string, paper string, embedding array<double>").repartition(3)
    kw = {} if budget is None else {"broadcast_budget": budget}
    if row_chunk is not None:
        kw["row_chunk"] = row_chunk
    res = top_k(qdf, vdf, k, ["query_id"], ["key", "paper"], group_col="paper" if group else None, **kw)
    got = {}
    for r in res.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, r.dist))
    return got


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 7), st.booleans())
def test_topk_equals_brute_force(spark, seed, k, group):
    rng = np.random.default_rng(seed)
    vecs = [(f"k{i:03d}", f"p{i % 7}", [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(60)]
    vecs.append(("knull", "p0", None))
    qs = [(j, [float(x) for x in rng.integers(-3, 4, 4)]) for j in range(5)]
    assert run_topk(spark, qs, vecs, k, group) == brute(qs, vecs, k, group)


def test_topk_block_path_and_k_above_n(spark):
    rng = np.random.default_rng(1)
    vecs = [(f"k{i}", f"p{i}", rng.normal(size=3).tolist()) for i in range(4)]
    qs = [(j, rng.normal(size=3).tolist()) for j in range(3)]
    got = run_topk(spark, qs, vecs, 10, budget=1)
    exp = brute(qs, vecs, 10)
    assert got == exp and all(len(v) == 4 for v in got.values())


def test_topk_dimension_mismatch_raises(spark):
    with pytest.raises(Exception):
        run_topk(spark, [(0, [1.0, 2.0])], [("a", "p", [1.0, 2.0, 3.0])], 1)


def test_squared_l2_matches_python(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3], [0.3, 0.2, 0.1])], "a array<double>, b array<double>")
    got = df.select(squared_l2("a", "b").alias("d")).first().d
    assert got == (0.1 - 0.3) * (0.1 - 0.3) + 0.0 + (0.3 - 0.1) * (0.3 - 0.1)


def test_text_validity_edges(spark):
    texts = [("", False), (" ", False), ("x" * 8192, True), ("x" * 8193, False), ("😀" * 8192, True),
             (None, False), ("ok", True)]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    got = [r.v.is_valid for r in df.select(text_validity("t").alias("v")).collect()]
    assert got == [e for _, e in texts]


def test_batched_failure_is_per_batch(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id long, t string").coalesce(1)

    def fn(texts):
        if "t5" in texts:
            raise RuntimeError("service down")
        return [t.upper() for t in texts]

    out = {r.id: (r.out, r.error) for r in tf.apply_batched(df, fn, "t", "out", T.StringType(), 4, ["id"]).collect()}
    failed = {i for i, (o, e) in out.items() if e is not None}
    # Only the slice holding t5 fails (at most one batch of 4); every row
    # keeps its key, and all other rows get their own output.
    assert 5 in failed and len(failed) <= 4
    assert all(out[i][0] is None and "service down" in out[i][1] for i in failed)
    assert all(out[i] == (f"T{i}", None) for i in out if i not in failed)


def test_unknown_agent_raises(spark):
    from paperspark.plans import views as v

    texts = spark.createDataFrame([("p1", "text")], "id string, abstract string")
    with pytest.raises(ValueError):
        tf.apply_agents(texts, v.agents(spark, SF_SMALL), v.summarizer_fn, "abstract", ["id"], agent_class="nope")
    with pytest.raises(ValueError):
        tf.apply_agents(texts, v.agents(spark, SF_SMALL), v.summarizer_fn, "abstract", ["id"], agent_name="Nobody")
    out = tf.apply_agents(texts, v.agents(spark, SF_SMALL), v.summarizer_fn, "abstract", ["id"]).collect()
    assert sorted(r.agent_name for r in out) == ["quality-0", "quality-1"]


def test_agent_links(spark):
    from paperspark.plans import views as v
    from paperspark.sources.agents import agent_links

    links = {r.agent_name: r.linked_class for r in agent_links(v.agents(spark, SF_SMALL)).collect()}
    assert links["quality-0"] == "reader"


def test_context_layout(spark):
    hits = spark.createDataFrame([(1, 2, "p2", "B", "t2"), (1, 1, "p1", "A", "t1")],
                                 "question_id long, rank int, arxiv_id string, abstract string, title string")
    qs = spark.createDataFrame([(1, "Why?"), (2, "None?")], "question_id long, question string")
    ctx = {r.question_id: r.context for r in context_text(hits, qs).collect()}
    assert ctx[1] == "Question: Why?\n\nContext:\narXiv:p1\nAbstract: A\n\narXiv:p2\nAbstract: B\n\n"
    assert ctx[2] == "Question: None?\n\nContext:\n"
    src = context_sources(hits).first().sources
    assert src == "- arXiv:p1 Title: t1\n- arXiv:p2 Title: t2"


def test_plans_push_down_and_avoid_pairs(spark, tmp_path):
    """Selection reaches the Parquet scan; top-k never builds a pair join."""
    import datetime as dt

    from paperspark.operators.index import select_papers, write_index
    from paperspark.plans.explain import plan_text

    rows = [("cs.LG", dt.datetime(2020, 1, 1), "a")]
    path = str(tmp_path / "idx")
    write_index(spark.createDataFrame(rows, "category string, created timestamp_ntz, id string"), path)
    sel = select_papers(spark.read.parquet(path), "cs.LG", [dt.datetime(2019, 1, 1), dt.datetime(2021, 1, 1)])
    plan = plan_text(sel)
    assert "PushedFilters" in plan and "StringContains" in plan and "GreaterThanOrEqual" in plan

    q = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, embedding array<double>")
    vdf = spark.createDataFrame([("a", "p", [1.0, 1.0])], "key string, paper string, embedding array<double>")
    p2 = plan_text(top_k(q, vdf, 1, ["query_id"], ["key", "paper"]))
    assert "CartesianProduct" not in p2 and "NestedLoopJoin" not in p2
    assert "WindowGroupLimit" in p2 or "Window" in p2


def test_sliced_kernel_and_block_path_agree(spark):
    rng = np.random.default_rng(3)
    vecs = [(f"k{i:03d}", f"p{i % 11}", [float(x) for x in rng.integers(-4, 5, 3)]) for i in range(120)]
    qs = [(j, [float(x) for x in rng.integers(-4, 5, 3)]) for j in range(9)]
    for group in (False, True):
        exp = brute(qs, vecs, 4, group)
        assert run_topk(spark, qs, vecs, 4, group, row_chunk=7) == exp
        assert run_topk(spark, qs, vecs, 4, group, budget=1, row_chunk=7) == exp


def test_agent_catalogue_from_json(spark, tmp_path):
    import json

    from paperspark.sources.agents import normalise_agents, read_agents

    path = tmp_path / "agents.json"
    recs = [{"agent_class": "Summarizer", "agent_name": "S1", "instructions": "i", "agent_link": "R"},
            {"agent_class": "summarizer", "agent_name": "S1", "instructions": "dup", "agent_link": "R"},
            {"agent_class": "LibraryAssistant", "agent_name": "R", "instructions": "j", "agent_link": "S1"}]
    path.write_text("\n".join(json.dumps(r) for r in recs) + "\n")
    agents = read_agents(spark, str(path))
    assert sorted((r.agent_class, r.agent_name) for r in agents.collect()) == [
        ("libraryassistant", "R"), ("summarizer", "S1")]
    assert normalise_agents(agents, "Summarizer").count() == 1


def test_embed_with_numpy_outputs(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, " ")], "id long, t string")
    vecs, rejected = tf.embed_with(df, lambda texts: [np.array([len(t), 1.0]) for t in texts], "t", ["id"])
    got = {r.id: r.embedding for r in vecs.collect()}
    assert got == {1: [2.0, 1.0], 2: [3.0, 1.0]}
    assert [r.id for r in rejected.collect()] == [3]


def test_batch_size_must_be_positive(spark):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    with pytest.raises(ValueError):
        tf.apply_batched(df, lambda x: x, "t", "out", T.StringType(), 0, ["id"])


def test_answer_step_with_user_embedder(spark):
    from paperspark.plans.answers import answer_questions
    from paperspark.schemas import VECTOR_SCHEMA

    store = spark.createDataFrame([("A", "m", "s", "p1", "abstract", [1.0, 0.0]),
                                   ("A", "m", "s", "p2", "abstract", [0.0, 1.0])], VECTOR_SCHEMA)
    papers = spark.createDataFrame([("p1", "T1", "first"), ("p2", "T2", "second")],
                                   "id string, title string, abstract string")
    questions = spark.createDataFrame([(1, "xx"), (2, "yyy")], "question_id long, question string")
    embed = lambda texts: [[1.0, 0.0] if len(t) == 2 else [0.0, 1.0] for t in texts]
    out = answer_questions(questions, store, papers, lambda ctxs: [c.split("\n")[3] for c in ctxs],
                           embed=embed, k=1)
    got = {r.question_id: (r.answer, r.sources) for r in out.answers.collect()}
    assert got == {1: ("arXiv:p1", "- arXiv:p1 Title: T1"), 2: ("arXiv:p2", "- arXiv:p2 Title: T2")}
