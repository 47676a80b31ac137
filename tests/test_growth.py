"""What a query moves and holds grows no faster than its input."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperspark.operators import cells, knn
from paperspark.operators import summaries as sm
from paperspark.operators.grouping import chunked_lists
from paperspark.plans import catalog_store, views
from paperspark.schemas import SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA
from paperspark.session import apply_required_conf, work_dir
from paperspark.sources import corpus_store
from paperspark.sources.tables import insert_absent, read_table, upsert


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def staged_names(spark):
    top = work_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(top)} if os.path.isdir(top) else set()


def test_a_query_visits_cells_in_one_row(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"v{i}", 0, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (400, 16)))]
    store = spark.createDataFrame(rows, "name string, part long, embedding array<double>")
    queries = store.limit(50).select(F.expr("cast(substring(name, 2) as long)").alias("query_id"), "embedding")
    path = str(tmp_path / "cells")
    cells.write_cells(store, path, ["name", "part"], pivots=40)
    first, second, _, _ = cells._rounds(queries, path, 5, ["query_id"], ["name", "part"], "embedding", "raise")
    assert first.count() == 50 and second.count() <= 50
    assert second.agg(F.max(F.size("cells"))).first()[0] > 1


def test_cells_share_blocks_and_large_ones_are_split():
    counts, asked = np.array([3, 4, 25, 2, 9, 0]), np.array([True, True, True, False, True, False])
    first, many, n = cells._blocks(counts, asked, 10)
    assert (list(many), n) == ([1, 1, 3, 0, 1, 0], 5)
    assert first[0] == first[1] == 0 and first[2] == 1 and first[4] == 4


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("kind", ["ties", "spread"])
def test_search_holds_k_rows_per_query(grouped, kind, monkeypatch):
    rng = np.random.default_rng(5)
    X = np.ones((900, 3)) if kind == "ties" else rng.integers(0, 4, (900, 3)).astype(float)
    Q, rank = X[::9], rng.permutation(900)
    codes = rng.integers(0, 40, 900) if grouped else None
    monkeypatch.setattr(knn, "QUERY_CHUNK", 16)
    most = []
    kept = knn._Search.hold
    monkeypatch.setattr(knn._Search, "hold", lambda s, q, r, d: (most.append(len(q)), kept(s, q, r, d)))
    search = knn._Search(Q, 5, rank, codes)
    search.add(X[:500], np.arange(500), 64)
    search.add(X[500:], np.arange(500, 900), 64)
    assert max(most) <= 64 * 16
    for i, q in enumerate(Q):
        d = ((X - q) ** 2).sum(1)
        want, seen = [], set()
        for r in np.lexsort((rank, d)):
            if codes is None or codes[r] not in seen:
                want.append(r)
                seen.add(None if codes is None else codes[r])
        assert list(search.rows[i]) == want[:5] and list(search.dist[i]) == list(d[want[:5]])


def test_python_batches_are_bounded_in_bytes(spark):
    apply_required_conf(spark)
    df = spark.range(0, 8000, 1, 1).withColumn("t", F.repeat(F.lit("x"), 4000))
    sizes = df.mapInPandas(lambda it: (p.assign(n=len(p))[["n"]] for p in it), "n long").agg(F.max("n")).first()[0]
    assert sizes * 4000 < 8 << 20


def summaries(spark, n, text="t", models=1):
    return spark.range(n).select(F.lit("s").alias("summarizer_name"), F.concat(F.lit("m"), F.col("id") % models).alias("full_model_name"),
                                 F.concat(F.lit("p"), "id").alias("arxiv_id"), F.concat(F.lit(text), "id").alias("summary_text"),
                                 F.lit(None).cast("timestamp").alias("timestamp"))


def test_first_batch_is_written_once_and_keys_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    before = staged_names(spark)
    assert upsert(summaries(spark, 30), path, SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA) == 30
    assert not [n for n in staged_names(spark) - before if n.startswith("upsert-batch")]
    assert upsert(summaries(spark, 10, "new"), path, SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA) == 10
    assert insert_absent(summaries(spark, 35, "late"), path, SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA) == 5
    got = {r.arxiv_id: r.summary_text for r in read_table(spark, path, SUMMARY_SCHEMA).collect()}
    assert got == {f"p{i}": f"{'new' if i < 10 else 't' if i < 30 else 'late'}{i}" for i in range(35)}


def test_refused_first_batch_publishes_nothing(spark, tmp_path):
    path, twice = str(tmp_path / "t"), summaries(spark, 4).unionByName(summaries(spark, 2))
    with pytest.raises(ValueError, match="repeats a key"):
        upsert(twice, path, SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA)
    assert read_table(spark, path, SUMMARY_SCHEMA).count() == 0
    assert upsert(summaries(spark, 4), path, SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA) == 4
    assert read_table(spark, path, SUMMARY_SCHEMA).count() == 4


def test_many_lookup_keys_sort_no_texts(spark, monkeypatch):
    monkeypatch.setattr(sm, "BROADCAST_KEYS", 3)
    keys = spark.createDataFrame([("p1",), ("p1",), ("p2",), ("p3",), ("p9",), ("none",), (None,)], "arxiv_id string")
    found = sm.lookup_summaries(summaries(spark, 20, models=2), ("arxiv_id",), keys)
    assert sorted(r.arxiv_id for r in found.collect()) == ["p1", "p1", "p2", "p3", "p9"]
    assert "ShuffledHashJoin" in plan_of(found) and "SortMergeJoin" not in plan_of(found)


def test_lists_move_values_twice(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("o"), F.concat(F.lit("v"), "id").alias("v"))
    for stored in (False, True):
        out = chunked_lists(df, ["g"], "v", order="o", chunk=4, stored=stored)
        assert "SortMergeJoin" not in plan_of(out) and "Window" not in plan_of(out)
        for g in (0, 1):
            rows = sorted((r for r in out.collect() if r.g == g), key=lambda r: r.part)
            want = [v for _, v in sorted((i % 7, f"v{i}") for i in range(50) if i % 2 == g)]
            assert [x for r in rows for x in r["items"]] == want
            assert [r.first_position for r in rows] == [4 * r.part for r in rows] and {r.n_items for r in rows} == {25}


def line(i, title):
    return f'{{"id": "p{i}", "title": "{title}", "categories": "c", "versions": []}}\n'


def test_corpus_of_one_folder_is_read_without_a_shuffle(spark, tmp_path):
    files, path = tmp_path / "files", str(tmp_path / "store")
    files.mkdir()
    (files / "a").write_text(line(1, "old") + line(2, "two") + line(1, "new"))
    corpus_store.refresh(spark, path, str(files))
    rows = corpus_store.stored_papers(spark, path, ["title"])
    assert "Exchange" not in plan_of(rows)
    assert sorted(map(tuple, rows.collect())) == [("p1", "new"), ("p2", "two")]
    (files / "b").write_text(line(2, "later") + line(3, "three"))
    corpus_store.refresh(spark, path, str(files))
    rows = corpus_store.stored_papers(spark, path, ["title"])
    assert sorted(map(tuple, rows.collect())) == [("p1", "new"), ("p2", "later"), ("p3", "three")]


def test_texts_are_not_shuffled_for_links_or_cores(spark, tmp_path):
    spark.range(40).selectExpr("id AS doc_id", "'a b' AS text", "'en' AS lang", "'src1' AS source", "3L AS n_chars") \
        .repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(4).selectExpr("id AS doc_id", "id % 2 AS quality", "0L AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        out = catalog_store.summaries_with_assistant(spark, str(tmp_path))
        assert "BroadcastHashJoin" in plan_of(out)
        assert out.count() == 80
        assert views.cores(spark, str(tmp_path)) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.files.openCostInBytes", small)
