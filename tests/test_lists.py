"""Lists of any keys are cut from blocks that move every value once."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from paperspark.operators import grouping
from paperspark.operators.grouping import chunked_lists
from paperspark.session import DROP_SHUFFLES, shuffles_dropped, staged, staged_for, work_dir


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folders(spark, name):
    top = work_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(top) if f.startswith(f"{name}-")} if os.path.isdir(top) else set()


def shuffle_bytes(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.lstat(os.path.join(d, f)).st_size for t in top for d, _, fs in os.walk(t) for f in fs
               if f.startswith("shuffle"))


def check_lists(out, rows, groups, chunk):
    """``rows``: (group, sort key, value), NULLs first."""
    got = {}
    for r in out.collect():
        got.setdefault(tuple(r[c] for c in groups), []).append(r)
    assert set(got) == {g for g, _, _ in rows}
    for g, lists in got.items():
        lists.sort(key=lambda r: r["part"])
        want = [v for h, _, v in sorted((r for r in rows if r[0] == g), key=lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or "")))]
        assert [x for r in lists for x in r["items"]] == want
        assert [r["part"] for r in lists] == list(range(len(lists)))
        assert [r["first_position"] for r in lists] == [chunk * r["part"] for r in lists]
        assert all(len(r["items"]) == chunk for r in lists[:-1]) and {r["n_items"] for r in lists} == {len(want)}


@pytest.mark.parametrize("kind", ["unique", "ties", "one key", "equal", "many groups"])
@pytest.mark.parametrize("chunk", [3, 40])
def test_lists_of_blocks(spark, kind, chunk, monkeypatch):
    rng = random.Random(f"{kind} {chunk}")
    if chunk == 3:
        monkeypatch.setattr(grouping, "_block_rows", lambda entries, n, chunk: 2 * chunk)
    n = 150
    key = {"unique": lambda i: i, "ties": lambda i: rng.choice([None, *range(9)]), "one key": lambda i: 5, "equal": lambda i: 5,
           "many groups": lambda i: i % 4}[kind]
    value = {"equal": lambda i: "v", "ties": lambda i: rng.choice([None, "a", "b", f"v{i}"])}.get(kind, lambda i: f"v{i:03d}")
    group = (lambda i: (i // 2, "x")) if kind == "many groups" else (lambda i: (rng.choice([None, 1, 1, 1, 2]), rng.choice("xxxy")))
    rows = [(group(i), key(i), value(i)) for i in range(n)]
    df = spark.createDataFrame([(*g, k, v) for g, k, v in rows], "g long, h string, k long, v string").repartition(3)
    check_lists(chunked_lists(df, ["g", "h"], "v", order="k", chunk=chunk), rows, ["g", "h"], chunk)


def test_lists_of_other_keys(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(float("nan") if i % 5 == 0 else -0.0 if i % 5 == 1 else 0.0, t0 + dt.timedelta(minutes=i // 3), i) for i in range(60)]
    df = spark.createDataFrame(rows, "g double, k timestamp, v long")
    out = chunked_lists(df, ["g"], F.struct("v", F.col("k").alias("t")), order=F.struct("k", "v"), chunk=4)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["part"]):
        got.setdefault(str(abs(r["g"])), []).extend(e["v"] for e in r["items"])
    assert got == {"nan": [i for i in range(60) if i % 5 == 0], "0.0": [i for i in range(60) if i % 5]}
    none = chunked_lists(df.limit(0), ["g"], "v", chunk=4)
    assert none.collect() == [] and none.dtypes == [("g", "double"), ("part", "bigint"), ("n_items", "bigint"),
                                                    ("first_position", "bigint"), ("items", "array<bigint>")]


def test_lists_shuffle_each_value_once(spark, monkeypatch):
    monkeypatch.setattr(grouping, "_block_rows", lambda entries, n, chunk: 2 * chunk)
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    old = folders(spark, "list")
    out = chunked_lists(df, ["g"], "v", order="o", chunk=7)
    assert plan_of(out).count("Exchange") == 1
    # The entries and one small row for each block; no sorted copy of the entries.
    assert sorted(f.rsplit("-", 1)[0] for f in folders(spark, "list") - old) == ["list-entries", "list-starts"]
    assert sum(r["n_items"] == 250 for r in out.collect()) == 2 * 36


def test_a_staged_result_leaves_no_shuffle(spark):
    old = shuffle_bytes(spark)
    df = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 512).alias("v"))
    again = staged(df.repartitionByRange("v"), "kept-rows")
    assert shuffle_bytes(spark) - old < 1 << 20 and again.count() == 200_000
    with staged_for(df.limit(10), "gone-rows") as rows:
        assert rows.count() == 10 and folders(spark, "gone-rows")
    assert not folders(spark, "gone-rows")
    with pytest.raises(ZeroDivisionError), shuffles_dropped(spark):
        1 / 0
    assert spark.conf.get(DROP_SHUFFLES) == "false"


def test_lists_of_a_stored_table_move_it_once(spark, tmp_path):
    from paperspark.operators import summaries as sm
    from paperspark.schemas import SUMMARY_SCHEMA
    from paperspark.sources.tables import read_table

    path, old = str(tmp_path / "t"), shuffle_bytes(spark)
    rows = spark.range(20_000).select(
        F.concat(F.lit("s"), F.col("id") % 2).alias("summarizer_name"), F.lit("m").alias("full_model_name"),
        F.concat(F.lit("p"), "id").alias("arxiv_id"), F.sha2(F.col("id").cast("string"), 512).alias("summary_text"))
    sm.cache_summaries(rows, path)
    assert shuffle_bytes(spark) - old < 1 << 20
    held = [f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
    assert held and all(f.endswith(".zstd.parquet") for f in held)
    before = folders(spark, "list")
    out = sm.summaries_by_summarizer(read_table(spark, path, SUMMARY_SCHEMA), chunk=7)
    assert plan_of(out).count("Exchange") == 1
    assert [f.rsplit("-", 1)[0] for f in folders(spark, "list") - before] == ["list-starts"]
    assert out.agg(F.sum(F.size("items"))).first()[0] == 20_000


def test_parsed_lines_go_when_the_corpus_is_stored(spark, tmp_path):
    from paperspark.plans import views
    from paperspark.sources import corpus_store

    old = folders(spark, "parsed")
    spark.range(30).selectExpr("id AS doc_id", "concat('text\n', id) AS text", "'en' AS lang", "'src1' AS source", "3L AS n_chars") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    monkey = pytest.MonkeyPatch()
    monkey.setattr(views, "LINES_PER_FILE", 4)
    try:
        papers = views.papers(spark, str(tmp_path)).collect()
        files = views.paper_files(spark, str(tmp_path))
    finally:
        monkey.undo()
    assert sorted((r["id"], r["abstract"]) for r in papers) == sorted((f"p{i}", f"text\n{i}") for i in range(30))
    assert folders(spark, "parsed") == old
    packed = [f for f in os.listdir(files.removeprefix("file:")) if f.startswith("part-")]
    assert all(f.endswith(".gz") for f in packed) and len(packed) >= 8
    assert corpus_store.refresh(spark, views.paper_store(spark, str(tmp_path)), files).parsed == 0
