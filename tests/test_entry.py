"""Driver contract: entry smoke run and a cheap subset of the oracle checks."""

import duckdb
import pytest

import __spark_entry__ as E
from paperspark.plans.catalog import ORACLES, QUERIES

from .conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "title", "abstract"]
    assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(E.queries())


TYPE_NAMES = {"StringType()": "VARCHAR", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
              "BooleanType()": "BOOLEAN", "TimestampNTZType()": "TIMESTAMP", "IntegerType()": "INTEGER"}


def _norm(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["scan_project", "last_record_wins", "index_grouped", "select_contains_range",
                                  "papers_by_ids", "summary_upsert", "merged_summaries", "merged_vectors",
                                  "topk_many", "topk_dedupe", "context_text", "feed_newest",
                                  "summary_grouped", "answers", "answers_failed",
                                  "topk_nonfinite", "scan_files", "feed_fractions", "agents_with_errors", "select_counts"])
def test_oracle_matches_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    spark_types = {f.name: TYPE_NAMES.get(str(f.dataType), str(f.dataType)) for f in df.schema.fields}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert _norm(df.columns, [tuple(r) for r in df.collect()]) == _norm(rel.columns, rel.fetchall())
