"""The stored corpus: kept up to date by file, read by id, published whole."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from paperspark.operators.context import retrieve
from paperspark.operators.index import build_index, select_papers, selected_ids
from paperspark.sources import corpus_store as cs
from paperspark.sources.papers import load_papers, parse_lines, read_lines
from paperspark.sources.versions import drop_old


def record(i, category="cs.LG", title="t", hour=10):
    return {"id": f"p{i}", "title": title, "categories": category, "abstract": f"text {i} " * 20,
            "versions": [{"version": "v1", "created": f"Mon, 2 Apr 2007 {hour}:18:42 GMT"}]}


@pytest.fixture()
def corpus(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def deliver(name, rows, clock=[0]):
        target = folder / name
        target.parent.mkdir(exist_ok=True)
        target.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
        clock[0] += 10
        os.utime(target, (1_000_000 + clock[0],) * 2)

    return str(folder), str(tmp_path / "store"), deliver


def rows(df):
    return sorted(map(str, df.collect()))


def same_as_rebuilt(spark, files, store):
    """The store against parsing all files anew."""
    parsed = parse_lines(read_lines(spark, [cs._escaped(f.path) for f in cs.list_files(spark, files).collect()]))
    fields = ["title", "categories", "abstract"]
    assert rows(cs.stored_papers(spark, store, fields)) == rows(load_papers(parsed.records, fields))
    built = build_index(parsed.records)
    assert rows(cs.stored_index(spark, store)) == rows(built.index)
    rejects = cs.stored_rejects(spark, store)
    assert rows(rejects.where("line IS NOT NULL").select("line", "reason")) == rows(
        parsed.rejects.select("line", "reason"))
    assert rows(rejects.where("line IS NULL").select("id", "reason")) == rows(built.rejects.select("id", "reason"))


def test_deliveries_equal_a_rebuild(spark, corpus):
    files, store, deliver = corpus
    deliver("a.json", [record(i) for i in range(30)] + ["junk", "", record(90, ""), '{"title": "no id"}'])
    assert cs.refresh(spark, store, files)[:3] == (1, 1, 0)
    assert cs.refresh(spark, store, files) == cs.Refresh(1, 0, 0, 0)
    same_as_rebuilt(spark, files, store)
    # A later delivery corrects some and adds others; odd names are plain names.
    deliver("b[1] {x}.json", [record(i, "math.CO", "new", 11) for i in range(20, 40)])
    deliver("c/d.json", [record(7, "cs.AI", "newest", 12)])
    assert cs.refresh(spark, store, files) == cs.Refresh(2, 2, 0, 0)
    same_as_rebuilt(spark, files, store)
    # A file changes: its lines leave, wherever they lie, and others come.
    deliver("a.json", [record(i, title="again") for i in range(5, 25)])
    assert cs.refresh(spark, store, files) == cs.Refresh(3, 1, 1, 1)
    same_as_rebuilt(spark, files, store)
    # A file goes.
    os.remove(f"{files}/b[1] {{x}}.json")
    assert cs.refresh(spark, store, files) == cs.Refresh(4, 0, 1, 1)
    same_as_rebuilt(spark, files, store)
    assert {r.file.rsplit("/", 1)[1] for r in cs.stored_files(spark, store).collect()} == {"a.json", "d.json"}
    assert drop_old(spark, store)
    same_as_rebuilt(spark, files, store)
    assert cs.refresh(spark, store, files, rebuild=True).parsed == 2
    same_as_rebuilt(spark, files, store)


def test_many_deliveries_are_joined(spark, corpus, monkeypatch):
    monkeypatch.setattr(cs, "MAX_FOLDERS", 2)
    files, store, deliver = corpus
    for k in range(4):
        deliver(f"{k}.json", [record(i, title=f"t{k}") for i in range(k, k + 3)])
        cs.refresh(spark, store, files)
        assert len(cs._folders(spark, store)) <= 2
    same_as_rebuilt(spark, files, store)


def test_no_files_and_no_store(spark, corpus):
    files, store, _ = corpus
    assert cs.stored_papers(spark, store, ["title"]).collect() == []
    assert cs.refresh(spark, store, files) == cs.Refresh(1, 0, 0, 0)
    assert cs.stored_index(spark, store).collect() == []


def test_a_refresh_that_dies_leaves_the_old_state(spark, corpus, monkeypatch):
    files, store, deliver = corpus
    deliver("a.json", [record(i) for i in range(5)])
    cs.refresh(spark, store, files)
    before = rows(cs.stored_papers(spark, store))
    deliver("b.json", [record(i, title="new") for i in range(5)])

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(cs, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            cs.refresh(spark, store, files)
    assert rows(cs.stored_papers(spark, store)) == before
    cs.refresh(spark, store, files)
    same_as_rebuilt(spark, files, store)


def test_only_new_files_are_parsed(spark, corpus, monkeypatch):
    files, store, deliver = corpus
    seen = []
    real = cs.read_lines
    monkeypatch.setattr(cs, "read_lines", lambda s, paths: (seen.append([os.path.basename(p) for p in paths]),
                                                            real(s, paths))[1])
    deliver("a.json", [record(1)])
    cs.refresh(spark, store, files)
    deliver("b.json", [record(2)])
    cs.refresh(spark, store, files)
    assert seen == [["a.json"], ["b.json"]]


def test_ids_reach_the_scan(spark, corpus, monkeypatch):
    files, store, deliver = corpus
    deliver("a.json", [record(i) for i in range(300)])
    cs.refresh(spark, store, files)
    asked = [f"p{i}" for i in range(0, 300, 4)]
    for ids in (asked, set(asked), spark.createDataFrame([(i,) for i in [*asked, asked[0], None]], "id string")):
        found = cs.stored_papers(spark, store, ["title"], ids)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(id" in plan and "from_json" not in plan and "abstract" not in plan
        assert sorted(r.id for r in found.collect()) == sorted(asked)
    # Long lists go as a tree of short ones.
    many = [f"p{i}" for i in range(cs.PUSHED_IDS)]
    found = cs.stored_papers(spark, store, ["title"], many)
    assert found.count() == 300
    assert "Or(" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert cs.stored_papers(spark, store, ["title"], ["p1'", "\\", "p1\n", "p5"]).count() == 1
    monkeypatch.setattr(cs, "PUSHED_IDS", 10)
    for ids in (asked, spark.createDataFrame([(i,) for i in asked], "id string")):
        assert sorted(r.id for r in cs.stored_papers(spark, store, ["title"], ids).collect()) == sorted(asked)
    assert cs.stored_papers(spark, store, ["title"], []).collect() == []
    with pytest.raises(ValueError):
        cs.stored_papers(spark, store, ["nothing"])


def test_row_groups_without_a_hit_are_not_read(spark, corpus, monkeypatch):
    """Ids interleave with those asked for, so only the Bloom filters tell."""
    monkeypatch.setattr(cs, "ROW_GROUP_BYTES", 4 << 10)
    files, store, deliver = corpus
    deliver("a.json", [record(i) for i in range(0, 4000, 2)])
    cs.refresh(spark, store, files)
    folder = next(iter(cs._folders(spark, store)))
    path = f"{store}/_version={folder}/papers"
    whole = spark.read.parquet(path)

    def scanned(df):
        plan = df._jdf.queryExecution()
        plan.executedPlan().execute().count()
        leaf = plan.executedPlan().collectLeaves().head()
        return leaf.metrics().get("numOutputRows").get().value()

    assert scanned(whole.select("id")) == 2000
    assert scanned(whole.where(F.col("id").isin("p100", "p3000")).select("id")) < 400
    assert scanned(whole.where(F.col("id").isin("p1001", "p2999")).select("id")) < 400


def test_retrieval_reads_only_the_hits(spark, corpus):
    files, store, deliver = corpus
    deliver("a.json", [record(i) for i in range(50)])
    cs.refresh(spark, store, files)
    key = ("A", "m", "s")
    vectors = spark.createDataFrame([(*key, f"p{i}", "abstract", [float(i), 0.0]) for i in range(50)],
                                    "agent_name string, model_name string, model_spec string, arxiv_id string, "
                                    "label string, embedding array<double>")
    asked = spark.createDataFrame([(1, [7.2, 0.0]), (2, [30.0, 0.0])], "question_id long, embedding array<double>")
    plans = []

    def papers(ids):
        found = cs.stored_papers(spark, store, ["title", "abstract"], ids)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    hits = retrieve(asked, vectors, papers, 2).collect()
    assert sorted((r.question_id, r.rank, r.arxiv_id) for r in hits) == [
        (1, 1, "p7"), (1, 2, "p8"), (2, 1, "p30"), (2, 2, "p29")]
    assert "In(id, [p29,p30,p7,p8])" in plans[0]


def test_selection_by_index(spark, corpus):
    files, store, deliver = corpus
    deliver("a.json", [record(i, hour=10 + i % 3) for i in range(9)] + [record(20, "math.CO")])
    cs.refresh(spark, store, files)
    chosen = select_papers(cs.stored_index(spark, store), "cs.LG", dt.datetime(2007, 4, 2, 11, 18, 42))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(category,cs.LG)" in plan and "EqualTo(created" in plan or "GreaterThanOrEqual(created" in plan
    got = cs.stored_papers(spark, store, ["title"], selected_ids(chosen)).collect()
    assert sorted(r.id for r in got) == ["p1", "p4", "p7"]
