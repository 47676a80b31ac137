"""Published versions of keyed tables: all or nothing, and only what a batch
touches is read and written."""

import os
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from paperspark.operators import summaries as sm
from paperspark.schemas import SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA
from paperspark.sources import tables
from paperspark.sources.versions import drop_old, publish, read_state, versions


def batch(spark, rows):
    return (spark.createDataFrame(rows, "summarizer_name string, arxiv_id string, summary_text string")
            .withColumn("full_model_name", F.lit("openai:m")))


def stored(spark, path):
    return sorted((r.summarizer_name, r.arxiv_id, r.summary_text) for r in sm.all_summaries(spark, path).collect())


def data_files(path):
    return sum(n.endswith(".parquet") for _, _, names in os.walk(path) for n in names)


def many(n, text, agent="A"):
    return [(agent, f"p{i}", text) for i in range(n)]


def scanned(df):
    """Data folders in the plan's scans."""
    return sorted({unquote(f).split("/_version=")[1].rsplit("/", 1)[0] for f in df.inputFiles()})


def test_a_failed_write_leaves_the_table_whole(spark, tmp_table):
    sm.cache_summaries(batch(spark, many(50, "old") + many(50, "old", "B")), tmp_table)
    before, state = stored(spark, tmp_table), read_state(spark, tmp_table)

    def dies(it):
        # Agent A's rows are written by now, or will be; B's fail.
        for pdf in it:
            if (pdf["summarizer_name"] == "B").any():
                raise RuntimeError("lost")
            yield pdf

    schema = "summarizer_name string, arxiv_id string, summary_text string, full_model_name string"
    inc = batch(spark, many(50, "new") + many(50, "new", "B")).mapInPandas(dies, schema).withColumn(
        "timestamp", F.current_timestamp())
    for write in (lambda: tables.upsert(inc, tmp_table, SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA,
                                        materialized=True),):
        with pytest.raises(Exception, match="lost"):
            write()
    assert stored(spark, tmp_table) == before and read_state(spark, tmp_table) == state


def test_killed_between_two_partitions(spark, tmp_table, monkeypatch):
    """All data folders are written, the pointer is not."""
    sm.cache_summaries(batch(spark, many(20, "old") + many(20, "old", "B")), tmp_table)
    before = stored(spark, tmp_table)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            sm.cache_summaries(batch(spark, many(20, "new") + many(20, "new", "B")), tmp_table)
    assert stored(spark, tmp_table) == before
    # The next write goes on from there, and the lost folders can be removed.
    sm.cache_summaries(batch(spark, many(20, "newer")), tmp_table)
    assert {r[2] for r in stored(spark, tmp_table) if r[0] == "A"} == {"newer"}
    after = stored(spark, tmp_table)
    assert drop_old(spark, tmp_table)
    assert stored(spark, tmp_table) == after


def test_one_paper_reads_and_writes_one_bucket(spark, tmp_table):
    sm.cache_summaries(batch(spark, many(200, "old") + many(200, "old", "B")), tmp_table)
    state = read_state(spark, tmp_table)
    assert len(state["leaves"]) == 2 * tables.DEFAULT_BUCKETS
    one = batch(spark, [("A", "p7", "new")])
    bucket = tables._bucket(SUMMARY_KEY, SUMMARY_PARTITIONS, state["buckets"])
    leaves = tables._leaves_of(one.withColumn(tables.BUCKET, bucket), SUMMARY_PARTITIONS)
    assert len(leaves) == 1 and leaves[0] in state["leaves"]
    read = tables._read(spark, tmp_table, SUMMARY_SCHEMA, state, leaves)
    assert scanned(read) == [f"{next(iter(state['folders']))}/{leaves[0]}"]
    files = data_files(tmp_table)
    sm.cache_summaries(one, tmp_table)
    assert data_files(tmp_table) == files + 1
    now = read_state(spark, tmp_table)
    assert {k for k, v in now["leaves"].items() if v != state["leaves"][k]} == set(leaves)
    rows = stored(spark, tmp_table)
    assert len(rows) == 400 and ("A", "p7", "new") in rows and ("B", "p7", "old") in rows


def test_the_write_shuffles_by_leaf_once(spark, tmp_table, monkeypatch):
    plans = []
    real = tables._write
    monkeypatch.setattr(tables, "_write", lambda rows, *a, **k: (plans.append(
        rows._jdf.queryExecution().executedPlan().toString()), real(rows, *a, **k)))
    sm.cache_summaries(batch(spark, many(10, "a")), tmp_table)
    sm.cache_summaries(batch(spark, many(10, "b")), tmp_table)
    assert all(p.count("Exchange") == 1 for p in plans)


def test_insert_absent_reads_only_touched_buckets_and_appends(spark, tmp_table):
    sm.cache_summaries(batch(spark, many(100, "old")), tmp_table)
    inc = batch(spark, [("A", "p7", "ignored"), ("A", "q1", "fresh")]).withColumn("timestamp", F.current_timestamp())
    before = read_state(spark, tmp_table)
    assert tables.insert_absent(inc, tmp_table, SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA) == 1
    after = read_state(spark, tmp_table)
    grown = [k for k, v in after["leaves"].items() if len(v) > 1]
    assert len(grown) == 1 and after["leaves"][grown[0]][0] == before["leaves"][grown[0]][0]
    rows = stored(spark, tmp_table)
    assert len(rows) == 101 and ("A", "p7", "old") in rows and ("A", "q1", "fresh") in rows
    # Replacing a row of that bucket joins its folders again.
    sm.cache_summaries(batch(spark, [("A", "q1", "replaced")]), tmp_table)
    assert len(read_state(spark, tmp_table)["leaves"][grown[0]]) == 1
    assert ("A", "q1", "replaced") in stored(spark, tmp_table)


def test_a_reader_keeps_its_version(spark, tmp_table):
    sm.cache_summaries(batch(spark, many(10, "old")), tmp_table)
    opened = tables.read_table(spark, tmp_table, SUMMARY_SCHEMA)
    sm.cache_summaries(batch(spark, many(10, "new")), tmp_table)
    assert {r.summary_text for r in opened.collect()} == {"old"}


def test_the_second_writer_of_a_version_fails(spark, tmp_table):
    sm.cache_summaries(batch(spark, many(3, "old")), tmp_table)
    state = read_state(spark, tmp_table)
    with pytest.raises(RuntimeError, match="another writer"):
        publish(spark, tmp_table, state)
    assert versions(spark, tmp_table) == [1]
    assert not [n for n in os.listdir(f"{tmp_table}/_published") if n.endswith(".tmp")]


def test_old_versions_go_on_request(spark, tmp_table):
    for text in ("a", "b", "c"):
        sm.cache_summaries(batch(spark, many(30, text)), tmp_table)
    with pytest.raises(ValueError):
        drop_old(spark, tmp_table, keep=0)
    assert len(drop_old(spark, tmp_table, keep=2)) == 1
    assert versions(spark, tmp_table) == [2, 3]
    assert {r.summary_text for r in tables.read_table(spark, tmp_table, SUMMARY_SCHEMA).collect()} == {"c"}
    assert drop_old(spark, f"{tmp_table}-absent") == []


def test_odd_values_in_keys_and_partitions(spark, tmp_table):
    odd = ["a/b", "c:d", "e=f", "100%", "g h", "[x]*?{y}", "é", None]
    rows = [(agent, paper, f"{agent}|{paper}") for agent in odd for paper in [*odd[:-1], None]]
    sm.cache_summaries(batch(spark, rows), tmp_table)
    got = sm.all_summaries(spark, tmp_table)
    assert sorted(r.summary_text for r in got.collect()) == sorted(r[2] for r in rows)
    sm.cache_summaries(batch(spark, [(a, p, "new") for a, p, _ in rows[::3]]), tmp_table)
    again = sm.all_summaries(spark, tmp_table).collect()
    assert len(again) == len(rows) and sum(r.summary_text == "new" for r in again) == len(rows[::3])


def test_buckets_are_set_when_the_table_is_created(spark, tmp_table):
    tables.create_table(spark, tmp_table, SUMMARY_SCHEMA, SUMMARY_PARTITIONS, buckets=3)
    sm.cache_summaries(batch(spark, many(60, "x")), tmp_table)
    state = read_state(spark, tmp_table)
    assert state["buckets"] == 3 and len(state["leaves"]) == 3
    rows = tables.read_table(spark, tmp_table, SUMMARY_SCHEMA)
    assert rows.columns == SUMMARY_SCHEMA.names and rows.count() == 60
