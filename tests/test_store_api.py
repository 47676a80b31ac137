"""Small store operations: create-if-absent, literal filters, groups,
dimension check, snapshot round trip, cluster settings."""

import pytest

from paperspark.operators import summaries as sm
from paperspark.operators.vectors import (check_uniform_dimension, read_snapshot, store_groups,
                                          write_snapshot)
from paperspark.schemas import VECTOR_SCHEMA


def test_create_table_is_idempotent(spark, tmp_table):
    assert sm.create_summaries_table(spark, tmp_table).count() == 0
    df = spark.createDataFrame([("A", "p1", "s")], "summarizer_name string, arxiv_id string, summary_text string")
    sm.cache_summaries(df, tmp_table, "openai", "m")
    assert sm.create_summaries_table(spark, tmp_table).count() == 1


def test_filter_summaries_literal_keys(spark, tmp_table):
    df = spark.createDataFrame([("A", "p1", "a"), ("B", "p1", "b"), ("A", "p2", "c")],
                               "summarizer_name string, arxiv_id string, summary_text string")
    sm.cache_summaries(df, tmp_table, "openai", "m")
    t = sm.create_summaries_table(spark, tmp_table)
    assert sm.filter_summaries(t, summarizer_name="A").count() == 2
    assert sm.filter_summaries(t, full_model_name="openai:m", arxiv_id="p1").count() == 2
    assert [r.summary_text for r in sm.filter_summaries(t, "B", "openai:m", "p1").collect()] == ["b"]


def test_groups_dimensions_and_snapshot(spark, tmp_path):
    rows = [("A0", "h", "64", "p1", "abstract", [1.0, 2.0]), ("A1", "h", "64", "p2", "abstract", [3.0, 4.0]),
            ("A1", "h", "64", "p3", "abstract", None)]
    store = spark.createDataFrame(rows, VECTOR_SCHEMA)
    assert sorted(r.agent_name for r in store_groups(store).collect()) == ["A0", "A1"]
    assert check_uniform_dimension(store) == 2
    bad = store.unionByName(spark.createDataFrame([("A2", "h", "64", "p4", "abstract", [1.0])], VECTOR_SCHEMA))
    with pytest.raises(ValueError):
        check_uniform_dimension(bad)
    path = str(tmp_path / "snap")
    write_snapshot(store, path)
    assert sorted(r.arxiv_id for r in read_snapshot(spark, path).collect()) == ["p1", "p2"]


def test_cluster_settings_apply(spark):
    from paperspark.session import CLUSTER_CONF, apply_cluster_conf

    old = {k: spark.conf.get(k, None) for k in CLUSTER_CONF}
    try:
        apply_cluster_conf(spark)
        assert all(spark.conf.get(k) == v for k, v in CLUSTER_CONF.items())
    finally:
        for k, v in old.items():
            if v is not None:
                spark.conf.set(k, v)
