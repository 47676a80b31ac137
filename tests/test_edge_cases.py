"""Null keys, non-finite vectors, split lists, functions that run once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperspark.functions.dates import iso_utc
from paperspark.operators import memo
from paperspark.operators.grouping import chunked_lists
from paperspark.operators.index import category_match, load_or_build_index
from paperspark.operators.knn import nonfinite_vectors, top_k
from paperspark.operators.transform import apply_batched
from paperspark.plans.answers import answer_questions
from paperspark.schemas import VECTOR_KEY
from paperspark.sources.tables import insert_absent, read_table, upsert

SCHEMA = "part string, id string, value string"


def rows_of(df):
    return sorted(((r["part"], r["id"], r["value"]) for r in df.collect()), key=repr)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def write(spark, fn, rows, path, **kw):
    df = frame(spark, rows)
    return fn(df, path, ["part", "id"], ["part"], df.schema, **kw)


def test_upsert_keeps_rows_of_a_null_partition(spark, tmp_table):
    write(spark, upsert, [(None, "1", "a"), ("x", "1", "b"), ("y", "1", "c")], tmp_table)
    write(spark, upsert, [(None, "2", "d"), ("x", "1", "e")], tmp_table)
    schema = frame(spark, []).schema
    assert rows_of(read_table(spark, tmp_table, schema)) == sorted(
        [(None, "1", "a"), (None, "2", "d"), ("x", "1", "e"), ("y", "1", "c")], key=repr)


def test_null_key_parts_are_equal(spark, tmp_table):
    schema = frame(spark, []).schema
    assert write(spark, insert_absent, [("x", None, "a")], tmp_table) == 1
    assert write(spark, insert_absent, [("x", None, "b"), (None, None, "c")], tmp_table) == 1
    table = read_table(spark, tmp_table, schema)
    assert rows_of(table) == sorted([("x", None, "a"), (None, None, "c")], key=repr)
    asked = frame(spark, [("x", None, ""), (None, None, ""), ("z", None, "")])
    assert memo.present_keys(asked, table, ["part", "id"]).count() == 2
    assert [r["part"] for r in memo.missing_rows(asked, table, ["part", "id"]).collect()] == ["z"]


def test_repeated_keys_need_an_order(spark, tmp_table):
    with pytest.raises(ValueError, match="repeats a key"):
        write(spark, upsert, [("x", "1", "a"), ("x", "1", "b")], tmp_table)


def test_a_failing_batch_leaves_the_table_whole(spark, tmp_table):
    write(spark, upsert, [("x", "1", "a"), ("y", "1", "b")], tmp_table)
    bad = frame(spark, [("x", "1", "c"), ("y", "2", "d")]).withColumn(
        "value", F.when(F.col("id") == "2", F.raise_error(F.lit("stop"))).otherwise(F.col("value")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        upsert(bad, tmp_table, ["part", "id"], ["part"], frame(spark, []).schema)
    assert rows_of(read_table(spark, tmp_table, frame(spark, []).schema)) == [("x", "1", "a"), ("y", "1", "b")]


def test_memoised_computes_a_repeated_key_once(spark, tmp_table):
    seen = spark.sparkContext.accumulator(0)

    def compute(todo):
        def call(texts):
            seen.add(len(texts))
            return [t.upper() for t in texts]
        return apply_batched(todo, call, "text", "value", spark.createDataFrame([], "a string").schema["a"].dataType)

    asked = frame(spark, [("x", "1", "t"), ("x", "1", "t"), ("x", "2", "u")], "part string, id string, text string")
    out = memo.memoised(asked, ["part", "id"], compute, tmp_table, ["part"], frame(spark, []).schema)
    assert rows_of(out) == [("x", "1", "T"), ("x", "2", "U")] and out.count() == 2
    assert seen.value == 2
    again = memo.memoised(asked, ["part", "id"], compute, tmp_table, ["part"], frame(spark, []).schema)
    assert all(r["cached"] for r in again.collect()) and seen.value == 2


def vectors(spark, values):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)],
                                 "id long, embedding array<double>")


def nearest(spark, queries, store, **kw):
    q = vectors(spark, queries).withColumnRenamed("id", "query_id")
    out = top_k(q, vectors(spark, store), 3, vector_key=["id"], **kw)
    return {i: [r["id"] for r in sorted(out.collect(), key=lambda r: r["rank"]) if r["query_id"] == i]
            for i in range(len(queries))}


@pytest.mark.parametrize("budget", [1 << 26, 0])
def test_nonfinite_vectors_hide_nothing(spark, budget):
    rng = np.random.default_rng(3)
    store = rng.normal(size=(120, 8))
    queries = rng.normal(size=(5, 8))
    want = {i: list(np.argsort(((store - q) ** 2).sum(1), kind="stable")[:3]) for i, q in enumerate(queries)}
    assert nearest(spark, queries, store, broadcast_budget=budget) == want
    spoilt = np.vstack([store, np.full(8, np.nan), np.full(8, np.inf), np.full(8, 1e200)])
    with pytest.raises(Exception, match="NaN"):
        nearest(spark, queries, spoilt, broadcast_budget=budget)
    assert nearest(spark, queries, spoilt, broadcast_budget=budget, nonfinite="skip") == want
    assert {r["id"] for r in nonfinite_vectors(vectors(spark, spoilt)).collect()} == {120, 121}
    grouped = nearest(spark, queries, spoilt, broadcast_budget=budget, nonfinite="skip", group_col="id")
    assert grouped == want


def test_running_limit_across_slices(spark):
    rng = np.random.default_rng(4)
    store, queries = rng.integers(0, 3, size=(200, 4)), rng.integers(0, 3, size=(6, 4))
    want = {i: list(np.argsort(((store - q) ** 2).sum(1), kind="stable")[:3]) for i, q in enumerate(queries)}
    assert nearest(spark, queries, store, row_chunk=7) == want


def test_lists_are_split_by_position(spark):
    rows = [("a", i % 7, f"v{i:03d}") for i in range(50)] + [("b", 1, "same")] * 23 + [(None, 2, "n")]
    df = spark.createDataFrame(rows, "g string, k int, v string").repartition(5)
    out = chunked_lists(df, ["g"], "v", order="k", chunk=4).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: r["part"])
        values = [x for r in mine for x in r["items"]]
        assert values == [v for _, v in sorted((k, v) for h, k, v in rows if h == g)]
        assert [r["first_position"] for r in mine] == [4 * r["part"] for r in mine]
        assert all(len(r["items"]) <= 4 and r["n_items"] == len(values) for r in mine)


def test_failed_embeddings_reach_the_answers_and_functions_run_once(spark):
    embedded, answered = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def embed(texts):
        embedded.add(len(texts))
        if any("bad" in t for t in texts):
            raise ValueError("no vector")
        return [[float(len(t)), 1.0] for t in texts]

    def reply(contexts):
        answered.add(len(contexts))
        return ["ok"] * len(contexts)

    questions = spark.createDataFrame([(1, "one"), (2, "bad"), (3, "three")], "question_id long, question string")
    store = spark.createDataFrame([("A", "m", "s", f"p{i}", "abstract", [float(i), 1.0]) for i in range(6)],
                                  ", ".join(f"{c} string" for c in VECTOR_KEY) + ", embedding array<double>")
    papers = spark.createDataFrame([(f"p{i}", f"t{i}", f"a{i}") for i in range(6)],
                                   "id string, title string, abstract string")
    out = answer_questions(questions, store, papers, reply, embed=embed, k=2, embed_batch=1).answers
    for _ in range(2):
        found = {r["question_id"]: r for r in out.collect()}
    assert found[2]["error"] == "ValueError: no vector" and found[2]["answer"] is None and found[2]["context"] is None
    assert found[1]["answer"] == found[3]["answer"] == "ok" and found[1]["error"] is None
    assert (embedded.value, answered.value) == (3, 2)


def test_building_a_plan_starts_no_job(spark):
    from paperspark.functions.embed import hash_embed

    df = spark.range(50).selectExpr("id", "concat('text ', id) AS text").repartition(3)
    spark.sparkContext.setJobGroup("plan-only", "plan-only")
    try:
        hash_embed(df, ["id"], "text")
        apply_batched(df, len, "text", "n", spark.range(1).schema["id"].dataType)
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_iso_times_in_any_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.sql("SELECT timestamp_micros(1704067200250000) AS t, TIMESTAMP_NTZ'2024-11-03 01:30:00' AS w").select(
            iso_utc("t", instant=True).alias("t"), iso_utc("w").alias("w")).first()
        assert tuple(row) == ("2024-01-01T00:00:00.250000+00:00", "2024-11-03T01:30:00+00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("n", [3, 80])
def test_an_empty_pattern_matches_every_category_but_null(spark, n):
    index = spark.createDataFrame([("a",), (None,), ("",)], "category string")
    found = category_match(index, [f"q{i}" for i in range(n)] + [""]).collect()
    assert sorted(r["category"] for r in found) == ["", "a"]


def test_an_unfinished_index_is_rebuilt(spark, tmp_path):
    (tmp_path / "index" / "_temporary").mkdir(parents=True)
    line = ('{"id": "1", "categories": "cs.AI", "versions": [{"version": "v1", '
            '"created": "Mon, 2 Apr 2007 19:18:42 GMT"}]}')
    lines = spark.createDataFrame([(line,)], "value string")
    for _ in range(2):
        assert load_or_build_index(spark, str(tmp_path / "index"), lines).count() == 1
