"""The whole corpus build is incremental: a rerun computes nothing new."""

import datetime as dt

from pyspark.sql import functions as F

from .conftest import SF_SMALL
from paperspark.plans import views as v
from paperspark.plans.corpus import CorpusPaths, build_corpus
from paperspark.sources import papers as pp

LINE = ('{{"id":"{i}","abstract":"text of paper {i}\\nsecond line","categories":"cs.LG",'
        '"versions":[{{"created":"Mon, 2 Apr 2007 1{h}:00:00 GMT"}}]}}')


def test_rebuild_calls_summariser_zero_times(spark, tmp_path):
    rows = [(LINE.format(i=f"a{n}", h=n), n) for n in range(4)]
    lines = spark.createDataFrame(rows, "value string, n long").select(
        "value", F.struct(F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("block"),
                          F.col("n").alias("row")).alias(pp.POS))
    calls = spark.sparkContext.accumulator(0)

    def fn_for_agent(name, instructions):
        def fn(texts):
            calls.add(len(texts))
            return [t.replace("\n", " ") for t in texts]
        return fn

    paths = CorpusPaths(*(str(tmp_path / n) for n in ("index", "summaries", "vectors", "snapshot")))
    args = (spark, lines, paths, "cs.LG", [dt.datetime(2007, 4, 2, 11), dt.datetime(2007, 4, 2, 13)],
            v.agents(spark, SF_SMALL), fn_for_agent, ("openai", "m"), ("hash", "64"))
    first = sorted((r.agent_name, r.arxiv_id) for r in build_corpus(*args).snapshot.collect())
    assert first == [(a, p) for a in ("quality-0", "quality-1") for p in ("a1", "a2", "a3")]
    assert calls.value == 6
    second = sorted((r.agent_name, r.arxiv_id) for r in build_corpus(*args).snapshot.collect())
    assert second == first and calls.value == 6
