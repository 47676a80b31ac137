"""Plan shapes and remaining properties from the survey's test strategy."""

import numpy as np
from pyspark.sql import functions as F

from paperspark.functions.vectors import squared_l2
from paperspark.operators import summaries as sm
from paperspark.operators.knn import top_k
from paperspark.operators.vectors import vectors_of_agent
from paperspark.plans.explain import plan_text
from paperspark.schemas import SUMMARY_SCHEMA, VECTOR_PARTITIONS, VECTOR_SCHEMA
from paperspark.sources.tables import read_table, upsert


def test_kernel_distances_equal_jvm_expression(spark):
    rng = np.random.default_rng(7)
    vecs = [(f"k{i}", rng.normal(size=16).astype(np.float32).astype(float).tolist()) for i in range(200)]
    qs = [(j, rng.normal(size=16).astype(np.float32).astype(float).tolist()) for j in range(7)]
    vdf = spark.createDataFrame(vecs, "key string, embedding array<double>")
    qdf = spark.createDataFrame(qs, "query_id long, embedding array<double>")
    res = top_k(qdf, vdf, 5, ["query_id"], ["key"])
    check = (res.join(qdf.withColumnRenamed("embedding", "q"), "query_id")
             .join(vdf.withColumnRenamed("embedding", "v"), "key")
             .select("dist", squared_l2("q", "v").alias("hof")))
    rows = check.collect()
    assert len(rows) == 35 and all(r.dist == r.hof for r in rows)


def test_lookup_plans_as_broadcast_join(spark, tmp_table):
    df = spark.createDataFrame([("A", "p1", "s", 0)], "summarizer_name string, arxiv_id string, summary_text string, o long")
    sm.cache_summaries(df, tmp_table, "openai", "m")
    t = read_table(spark, tmp_table, SUMMARY_SCHEMA)
    plan = plan_text(sm.lookup_summaries(t, ("arxiv_id",), [("p1",), ("p2",)]))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_agent_scan_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "vec")
    rows = [("A0", "hash", "64", "p1", "abstract", [1.0]), ("A1", "hash", "64", "p1", "abstract", [2.0]),
            ("A1", "hash", "64", "p2", "title", [3.0])]
    upsert(spark.createDataFrame(rows, VECTOR_SCHEMA), path, ["agent_name", "model_name", "model_spec",
                                                              "arxiv_id", "label"], VECTOR_PARTITIONS, VECTOR_SCHEMA)
    sel = vectors_of_agent(read_table(spark, path, VECTOR_SCHEMA), "A1", "hash", "64")
    plan = plan_text(sel)
    assert "PartitionFilters: [" in plan and "agent_name" in plan.split("PartitionFilters:")[1].split("\n")[0]
    assert [(r.arxiv_id, r.embedding) for r in sel.collect()] == [("p1", [2.0])]


def test_feed_json_sink_round_trip(spark, tmp_path):
    import datetime as dt

    from paperspark.schemas import FEED_RAW_SCHEMA
    from paperspark.sources.feed import newest, normalise_feed, write_feed

    raw = spark.createDataFrame([("  A title \n", [("Ann",), ("Bo",)], " line one\nline two ", dt.datetime(2024, 5, 1, 12),
                                  dt.datetime(2024, 5, 2), "u1", "e1")], FEED_RAW_SCHEMA)
    feed = normalise_feed(raw)
    path = str(tmp_path / "feed")
    write_feed(newest(feed, 100), path)
    back = spark.read.json(path).first()
    assert back.title == "A title" and back.authors == ["Ann", "Bo"]
    assert back.summary == "line one line two"
    assert back.published == "2024-05-01T12:00:00+00:00"


def test_empty_inputs_give_empty_results(spark, tmp_path):
    from paperspark.operators import memo
    from paperspark.schemas import VECTOR_KEY

    empty_q = spark.createDataFrame([], "query_id long, embedding array<double>")
    vdf = spark.createDataFrame([("a", [1.0])], "key string, embedding array<double>")
    assert top_k(empty_q, vdf, 3, ["query_id"], ["key"]).count() == 0
    rows = spark.createDataFrame([], "agent_name string, model_name string, model_spec string, arxiv_id string, "
                                     "label string, text string")
    out = memo.memoised(rows, list(VECTOR_KEY), lambda d: d.select(*VECTOR_KEY, F.array(F.lit(1.0)).alias("embedding")),
                        str(tmp_path / "v"), VECTOR_PARTITIONS, VECTOR_SCHEMA)
    assert out.count() == 0


def test_saved_feed_array_file(spark, tmp_path):
    import json

    from paperspark.sources.feed import read_saved_feed

    recs = [{"title": "T1", "authors": ["A", "B"], "summary": "s one", "published": "2024-05-01T12:00:00+00:00",
             "updated": "2024-05-02T00:00:00+00:00", "pdf_url": "u1", "entry_id": "e1"},
            {"title": "T2", "authors": [], "summary": "s two", "published": "2024-05-03T12:00:00+00:00",
             "updated": "2024-05-03T12:00:00+00:00", "pdf_url": "u2", "entry_id": "e2"}]
    path = tmp_path / "papers.json"
    path.write_text(json.dumps(recs, indent=2))
    got = sorted((r.entry_id, r.authors) for r in read_saved_feed(spark, str(path)).collect())
    assert got == [("e1", ["A", "B"]), ("e2", [])]


def test_flagship_plan_shape(spark):
    import __spark_entry__ as E

    text = plan_text(E.entry(spark))
    tree = text.split("\n\n")[0]
    # The selected ids are a filter of the stored corpus' scan: no line is
    # parsed again, and no other row group is read.
    assert "PushedFilters: [In(id" in text and "from_json" not in text
    assert "Aggregate" in tree.split("Exchange", 1)[1]
    assert "CartesianProduct" not in tree and "NestedLoopJoin" not in tree
