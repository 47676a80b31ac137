"""Keyed tables: upsert, insert-if-absent, lookups, memoised compute."""

import pytest
from pyspark.sql import functions as F

from paperspark.functions.keys import cache_key, model_parts, parse_key
from paperspark.operators import memo
from paperspark.operators import summaries as sm
from paperspark.schemas import SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA, VECTOR_KEY
from paperspark.sources.tables import insert_absent, read_table


def batch(spark, rows):
    return spark.createDataFrame(rows, "summarizer_name string, arxiv_id string, summary_text string, o long")


def table_rows(spark, path):
    return sorted((r.summarizer_name, r.full_model_name, r.arxiv_id, r.summary_text)
                  for r in sm.all_summaries(spark, path).collect())


def test_absent_table_reads_empty(spark, tmp_table):
    assert sm.all_summaries(spark, tmp_table).count() == 0
    assert sm.lookup_summaries(read_table(spark, tmp_table, SUMMARY_SCHEMA), ("arxiv_id",), [("x",)]).count() == 0


def test_upsert_last_wins_and_untouched_partition(spark, tmp_table):
    n = sm.cache_summaries(batch(spark, [("A", "p1", "old", 0), ("B", "p1", "b", 1)]), tmp_table, "openai", "m")
    assert n == 2
    n = sm.cache_summaries(batch(spark, [("A", "p1", "first", 0), ("A", "p1", "second", 1), ("A", "p2", "x", 2)]),
                           tmp_table, "openai", "m", order_col="o")
    assert n == 3
    assert table_rows(spark, tmp_table) == [("A", "openai:m", "p1", "second"), ("A", "openai:m", "p2", "x"),
                                            ("B", "openai:m", "p1", "b")]


def test_rerun_changes_only_the_time(spark, tmp_table):
    b = batch(spark, [("A", "p1", "s", 0)])
    sm.cache_summaries(b, tmp_table, "openai", "m")
    before = table_rows(spark, tmp_table)
    sm.cache_summaries(b, tmp_table, "openai", "m")
    assert table_rows(spark, tmp_table) == before
    assert read_table(spark, tmp_table, SUMMARY_SCHEMA).filter(F.col("timestamp").isNull()).count() == 0


def test_errors_are_not_cached(spark, tmp_table):
    df = batch(spark, [("A", "p1", None, 0)]).withColumn("error", F.lit("boom"))
    sm.cache_summaries(df, tmp_table, "openai", "m")
    assert sm.all_summaries(spark, tmp_table).count() == 0


def test_insert_absent_keeps_stored(spark, tmp_table):
    sm.cache_summaries(batch(spark, [("A", "p1", "kept", 0)]), tmp_table, "openai", "m")
    inc = (batch(spark, [("A", "p1", "ignored", 0), ("A", "p2", "first", 1), ("A", "p2", "second", 2)])
           .withColumn("full_model_name", F.lit("openai:m")).withColumn("timestamp", F.current_timestamp()))
    n = insert_absent(inc, tmp_table, SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA, order_col="o")
    assert n == 1
    assert table_rows(spark, tmp_table) == [("A", "openai:m", "p1", "kept"), ("A", "openai:m", "p2", "first")]


def test_lookup_is_a_bag_join_and_checks_order(spark, tmp_table):
    sm.cache_summaries(batch(spark, [("A", "p1", "a", 0), ("B", "p1", "b", 1)]), tmp_table, "openai", "m")
    t = read_table(spark, tmp_table, SUMMARY_SCHEMA)
    assert sm.lookup_summaries(t, ("arxiv_id",), [("p1",), ("p1",)]).count() == 4
    assert sm.lookup_summaries(t, ("summarizer_name", "arxiv_id"), [("B", "p1")]).count() == 1
    with pytest.raises(ValueError):
        sm.lookup_summaries(t, ("arxiv_id", "summarizer_name"), [("p1", "B")])
    with pytest.raises(ValueError):
        sm.lookup_summaries(t, (), [("p1",)])


def test_named_queries(spark, tmp_table):
    sm.cache_summaries(batch(spark, [("A", "p1", "a", 0), ("B", "p2", "b", 1)]), tmp_table, "openai", "m")
    read_table(spark, tmp_table, SUMMARY_SCHEMA).createOrReplaceTempView("summaries")
    assert sm.run_named(spark, "select-summaries-by-summarizer-and-arxiv-id", ["B", "p2"]).count() == 1
    assert sm.run_named(spark, "select-summaries-by-primary-key", ["A", "openai:m", "p1"]).count() == 1
    assert sm.run_named(spark, "select-all-summaries").count() == 2
    with pytest.raises(ValueError):
        sm.named_query_text("select-summaries-by-nothing")


def test_memoised_calls_function_only_for_misses(spark, tmp_path):
    from paperspark.schemas import VECTOR_PARTITIONS, VECTOR_SCHEMA

    path = str(tmp_path / "vec")
    calls = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([("A", "m", "s", f"p{i}", "abstract", f"text {i}") for i in range(6)],
                                 "agent_name string, model_name string, model_spec string, arxiv_id string, "
                                 "label string, text string")

    def compute(todo):
        def fn(it):
            for pdf in it:
                calls.add(len(pdf))
                pdf["embedding"] = [[float(len(t))] for t in pdf["text"]]
                yield pdf.drop(columns=["text"])
        return todo.mapInPandas(fn, VECTOR_SCHEMA)

    first = memo.memoised(rows, list(VECTOR_KEY), compute, path, VECTOR_PARTITIONS, VECTOR_SCHEMA)
    assert first.count() == 6 and first.filter("cached").count() == 0
    assert calls.value == 6
    second = memo.memoised(rows, list(VECTOR_KEY), compute, path, VECTOR_PARTITIONS, VECTOR_SCHEMA)
    assert second.filter("cached").count() == 6
    assert calls.value == 6


def test_checked_lookup_raises_on_missing(spark):
    store = spark.createDataFrame([("k1", [1.0])], "key string, embedding array<double>")
    keys = spark.createDataFrame([("k1",), ("k2",)], "key string")
    flagged = {r.key: r.has_value for r in memo.checked_lookup(keys, store, ["key"], "embedding", "flag").collect()}
    assert flagged == {"k1": True, "k2": False}
    with pytest.raises(Exception):
        memo.checked_lookup(keys, store, ["key"], "embedding").collect()


def test_key_build_and_parse(spark):
    df = spark.createDataFrame([("A", "openai", "m", "astro-ph/0101001", "x:y")],
                               "a string, m string, s string, p string, l string")
    k = cache_key("a", "m", "s", "p", "l")
    row = df.select(k.alias("k"), parse_key(k).alias("p")).first()
    assert row.k == "A:openai:m:astro-ph/0101001:x:y"
    assert row.p.label == "x:y" and row.p.arxiv_id == "astro-ph/0101001"
    with pytest.raises(Exception):
        df.select(parse_key(F.lit("a:b:c:d"))).collect()
    with pytest.raises(Exception):
        df.select(cache_key(F.lit("A:B"), "m", "s", "p", "l")).collect()


def test_model_parts(spark):
    df = spark.createDataFrame([("OpenAI:gpt",)], "m string")
    r = df.select(model_parts("m").alias("x")).first().x
    assert (r.model_name, r.model_spec, r.is_supported) == ("openai", "gpt", True)
    with pytest.raises(Exception):
        spark.createDataFrame([("a:b:c",)], "m string").select(model_parts("m")).collect()


def test_decompose_model():
    from paperspark.functions.keys import decompose_model

    assert decompose_model("OpenAI:gpt-x") == ("openai", "gpt-x")
    for bad in ("openai", "a:b:c", "other:m", None):
        with pytest.raises(ValueError):
            decompose_model(bad)


def test_memoised_reads_only_the_stated_partition(spark, tmp_path):
    from paperspark.schemas import VECTOR_PARTITIONS, VECTOR_SCHEMA
    from paperspark.sources.tables import upsert

    path = str(tmp_path / "vec")
    other = spark.createDataFrame([("A", "other", "s", "p1", "abstract", [9.0])], VECTOR_SCHEMA)
    upsert(other, path, list(VECTOR_KEY), VECTOR_PARTITIONS, VECTOR_SCHEMA)
    rows = spark.createDataFrame([("A", "m", "s", "p1", "abstract", "abc")],
                                 "agent_name string, model_name string, model_spec string, arxiv_id string, "
                                 "label string, text string")

    def compute(todo):
        return todo.select(*VECTOR_KEY, F.array(F.length("text").cast("double")).alias("embedding"))

    out = memo.memoised(rows, list(VECTOR_KEY), compute, path, VECTOR_PARTITIONS, VECTOR_SCHEMA,
                        partition_values={"model_name": "m"})
    assert [(r.model_name, r.embedding, r.cached) for r in out.collect()] == [("m", [3.0], False)]
    stored = sorted((r.model_name, r.embedding[0]) for r in read_table(spark, path, VECTOR_SCHEMA).collect())
    assert stored == [("m", 3.0), ("other", 9.0)]
    with pytest.raises(Exception):
        memo.memoised(rows, list(VECTOR_KEY), compute, path, VECTOR_PARTITIONS, VECTOR_SCHEMA,
                      partition_values={"model_name": "x"}).collect()


def test_every_named_query_builds():
    for name in sm.QUERY_NAMES:
        assert sm.named_query_text(name).startswith("SELECT")
    with pytest.raises(ValueError):
        sm.named_query_text("select-summaries-by-arxiv-id-and-summarizer")


def test_missing_summaries_move_keys_only(spark, tmp_path):
    """No text lies above the search for missing keys, and a text enters the
    workers once for all of its agents."""
    from paperspark.operators import transform as tf
    from paperspark.plans.corpus import summarise_missing
    from paperspark.sources.agents import agents_from_records

    agents = agents_from_records(spark, [
        {"agent_class": "Summarizer", "agent_name": n, "instructions": None, "agent_link": None} for n in "ABC"])
    papers = spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(6)], "id string, abstract string")
    keys = tf.agent_keys(papers, list("ABC"), ["id"], "summarizer_name")
    assert "abstract" not in keys._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    path = str(tmp_path / "s")
    seen = spark.sparkContext.accumulator(0)

    def fn_for_agent(name, _):
        def fn(texts):
            seen.add(len(texts))
            return [f"{name}: {t}" for t in texts]
        return fn

    sm.cache_summaries(batch(spark, [("A", f"p{i}", "stored", 0) for i in range(4)]), path, "openai", "m")
    out = summarise_missing(papers, agents, fn_for_agent, path, "openai", "m").collect()
    assert sorted((r.summarizer_name, r.arxiv_id, r.summary_text, r.cached) for r in out) == sorted(
        (a, f"p{i}", "stored" if a == "A" and i < 4 else f"{a}: text {i}", a == "A" and i < 4)
        for a in "ABC" for i in range(6))
    assert seen.value == 14
    again = summarise_missing(papers, agents, fn_for_agent, path, "openai", "m")
    assert again.filter("cached").count() == 18 and seen.value == 14


def test_one_text_for_many_agents(spark):
    from paperspark.operators import transform as tf

    texts = spark.createDataFrame([("p1", "a", ["X", "Y"]), ("p2", "b", ["Y"]), ("p3", "c", []), ("p4", None, ["Z"])],
                                  "id string, t string, who array<string>")

    def y(batch):
        if "b" in batch:
            raise ValueError("no b")
        return [t + "y" for t in batch]

    out = tf.run_agents(texts, {"X": lambda b: [t + "x" for t in b], "Y": y}, ["id"], "t", "who", batch_size=1)
    got = sorted((r.id, r.agent_name, r.summary_text, r.error) for r in out.collect())
    assert got == [("p1", "X", "ax", None), ("p1", "Y", "ay", None), ("p2", "Y", None, "ValueError: 'Y': no b"),
                   ("p4", "Z", None, "KeyError: 'Z': \"no function for agent 'Z'\"")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_caller_deals_texts_out_to_cores(spark):
    from paperspark.functions.embed import hash_embed

    one = spark.createDataFrame([(i, f"word{i} word") for i in range(40)], "k int, t string").coalesce(1)
    dealt = hash_embed(one, ["k"], "t", 8, partitions=6)
    assert dealt.rdd.getNumPartitions() == 6 and hash_embed(one, ["k"], "t", 8).rdd.getNumPartitions() == 1
    assert sorted(map(str, dealt.collect())) == sorted(map(str, hash_embed(one, ["k"], "t", 8).collect()))


def key_rows(spark, n, start=0):
    rows = [(f"a{i % 5}", None if i % 7 == 0 else f"p{i}", i) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "agent string, paper string, n long")


def test_key_filter_keeps_all_keys_and_few_others(spark):
    store, keys = key_rows(spark, 5000), key_rows(spark, 300, 100)
    cond = memo.key_filter(keys, ["agent", "paper"])
    passed = {r.n for r in store.filter(cond).collect()}
    asked = {(r.agent, r.paper) for r in keys.collect()}
    assert {r.n for r in store.collect() if (r.agent, r.paper) in asked} <= passed and len(passed) < 1300


@pytest.mark.parametrize("bits", [1 << 23, memo.BITMAP_BITS])
def test_probed_lookups_return_the_same_rows(spark, monkeypatch, bits):
    """The small filter lets many foreign keys through."""
    monkeypatch.setattr(memo, "FILTER_BITS", bits)
    cols = ["agent", "paper"]
    store, keys = key_rows(spark, 20_000), key_rows(spark, 9000, 15_000).unionByName(key_rows(spark, 9000, 15_000))
    if bits < 1 << 20:
        passed = store.filter(memo.key_filter(keys, cols)).count()
        assert 6000 < passed < 20_000
    show = lambda df: sorted(map(str, df.collect()))
    assert show(memo.present_keys(keys, store, cols, probe=True)) == show(memo.present_keys(keys, store, cols))
    assert show(memo.missing_rows(keys, store, cols, probe=True)) == show(memo.missing_rows(keys, store, cols))
    assert show(memo.checked_lookup(keys, store, cols, "n", "flag", probe=True)) == show(
        memo.checked_lookup(keys, store, cols, "n", "flag"))
    assert memo.present_keys(keys.limit(0), store, cols, probe=True).collect() == []


def test_key_filter_stands_at_the_scan(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    key_rows(spark, 100).write.parquet(path)
    store, keys = spark.read.parquet(path), key_rows(spark, 10)
    plan = memo.present_keys(keys, store, ["agent", "paper"], probe=True)._jdf.queryExecution().executedPlan().toString()
    side = plan[:plan.index("FileScan parquet")]
    assert "getbit" in side[side.rindex("Filter"):]
    monkeypatch.setattr(memo, "FILTER_KEYS", 5)
    assert memo.key_filter(keys, ["agent", "paper"]) is None
