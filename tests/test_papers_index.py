"""Parser, last-record-wins, index build and selection on literal lines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperspark.operators import index as ix
from paperspark.sources import papers as pp

GOOD = ('{"id":"a1","title":"T1","abstract":"A1","categories":"astro-ph.GA cs.LG",'
        '"versions":[{"version":"v1","created":"Mon, 2 Apr 2007 19:18:42 GMT"}]}')


def lines_df(spark, lines):
    rows = [(line, i) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "value string, i long")
    return df.select("value", F.struct(F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("block"),
                                       F.col("i").alias("row")).alias(pp.POS))


def test_bad_lines_go_to_quarantine(spark):
    bad = ["{bad", "", '{"id":"k",}', "{'id':'h'}", "123", '[{"id":"z"}]', "null", '{"title":"no id"}']
    parsed = pp.parse_lines(lines_df(spark, [GOOD] + bad))
    assert [r.id for r in parsed.records.collect()] == ["a1"]
    rej = {r.line: r.reason for r in parsed.rejects.collect()}
    assert set(rej) == set(bad)
    assert rej[""] == "blank line"
    assert rej["123"] == "not a JSON object"
    assert rej["{bad"] == "malformed JSON"
    assert rej['{"title":"no id"}'] == "missing id"


def test_odd_values_are_kept(spark):
    lines = ['{"id":"c","x":NaN}', '{"id":"d","id":"e"}', '{"id":"b","versions":"oops"}']
    recs = pp.parse_lines(lines_df(spark, lines)).records
    got = {r.id: r.versions for r in recs.collect()}
    assert got == {"c": None, "e": None, "b": None}


def test_later_line_wins(spark):
    lines = ['{"id":"x","title":"first"}', '{"id":"y","title":"other"}', '{"id":"x","title":"second"}']
    recs = pp.parse_lines(lines_df(spark, lines)).records
    out = {r.id: r.title for r in pp.load_papers(recs, ["title"]).collect()}
    assert out == {"x": "second", "y": "other"}


def test_unknown_field_and_empty_ids(spark):
    recs = pp.parse_lines(lines_df(spark, [GOOD])).records
    with pytest.raises(ValueError):
        pp.load_papers(recs, ["nope"])
    assert pp.load_papers(recs, ["title"], ids=[]).count() == 0
    assert pp.load_papers(recs, ["title"], ids=None).count() == 1
    assert pp.load_papers(recs, ["title"], limit=0).count() == 0


def test_index_uses_last_listed_version(spark):
    two = ('{"id":"v","categories":"cs.LG","versions":[{"created":"Tue, 3 Apr 2007 10:00:00 GMT"},'
           '{"created":"Mon, 2 Apr 2007 19:18:42 GMT"}]}')
    recs = pp.parse_lines(lines_df(spark, [GOOD, two])).records
    idx = {r.id: (r.category, r.created) for r in ix.build_index(recs).index.collect()}
    assert idx["a1"] == ("astro-ph.GA", dt.datetime(2007, 4, 2, 19, 18, 42))
    assert idx["v"] == ("cs.LG", dt.datetime(2007, 4, 2, 19, 18, 42))


def test_index_rejects_and_strict(spark):
    lines = [GOOD, '{"id":"e1","categories":"","versions":[{"created":"Mon, 2 Apr 2007 19:18:42 GMT"}]}',
             '{"id":"e2","categories":"cs","versions":[{"created":"xx"}]}']
    recs = pp.parse_lines(lines_df(spark, lines)).records
    built = ix.build_index(recs)
    assert {r.id for r in built.rejects.collect()} == {"e1", "e2"}
    with pytest.raises(Exception):
        ix.build_index(recs, strict=True).index.collect()


def _index(spark):
    rows = [("physics", dt.datetime(2020, 1, 1), "p1"), ("cs", dt.datetime(2020, 1, 2), "c1"),
            ("cs.LG", dt.datetime(2020, 1, 3), "l1"), ("math", dt.datetime(2020, 1, 3), "m1")]
    return spark.createDataFrame(rows, "category string, created timestamp_ntz, id string")


def test_containment_is_substring(spark):
    got = {r.id for r in ix.select_papers(_index(spark), "cs", None).collect()}
    assert got == {"p1", "c1", "l1"}
    got = {r.id for r in ix.select_papers(_index(spark), "cs", None, match="prefix").collect()}
    assert got == {"c1", "l1"}


def test_unknown_category_raises(spark):
    with pytest.raises(ValueError):
        ix.select_papers(_index(spark), "nope", None)


def test_range_edges(spark):
    idx = _index(spark)
    sel = lambda r: {x.id for x in ix.select_papers(idx, None, r).collect()}
    assert sel([dt.datetime(2020, 1, 2), dt.datetime(2020, 1, 3)]) == {"c1", "l1", "m1"}
    assert sel([dt.datetime(2020, 1, 3), dt.datetime(2020, 1, 2)]) == set()
    assert sel(dt.datetime(2020, 1, 2)) == {"c1"}
    # End of day given as midnight excludes later times that day.
    assert sel([dt.datetime(2019, 12, 31), dt.datetime(2020, 1, 1)]) == {"p1"}
    with pytest.raises(ValueError):
        sel([dt.datetime(2020, 1, 1)] * 3)
    with pytest.raises(ValueError):
        sel(["2020-01-01", dt.datetime(2020, 1, 2)])


def test_many_patterns_join_path(spark):
    pats = ["LG"] + [f"zz{i}" for i in range(100)]
    got = {r.id for r in ix.select_papers(_index(spark), pats, None, check_exists=False).collect()}
    assert got == {"l1"}


def test_chunked_groups_are_complete(spark):
    rows = [("hot", dt.datetime(2020, 1, 1), f"id{i:04d}") for i in range(2500)]
    idx = spark.createDataFrame(rows, "category string, created timestamp_ntz, id string")
    g = ix.ids_per_group(idx, chunk=1000).collect()
    assert len(g) >= 2
    assert all(r.n_ids == 2500 for r in g)
    ids = sorted(i for r in g for i in r.ids)
    assert ids == sorted(r[2] for r in rows)


def test_written_index_reads_back(spark, tmp_path):
    idx = _index(spark)
    path = str(tmp_path / "index")
    ix.write_index(idx, path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, idx.collect()))


def test_version_time_ignores_session_zone(spark):
    from paperspark.functions.dates import parse_version_date

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("Sun, 11 Mar 2007 02:30:00 GMT",), ("Mon, 31 Apr 2007 1:2:3 GMT",),
                                    ("Mon, 2 apr 2007 19:18:42 UTC",)], "c string")
        got = [r.t for r in df.select(parse_version_date("c").alias("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [dt.datetime(2007, 3, 11, 2, 30), None, dt.datetime(2007, 4, 2, 19, 18, 42)]


def test_many_patterns_equal_few_patterns(spark):
    idx = _index(spark)
    filler = [f"zz{i}" for i in range(100)]
    for match in ("contains", "prefix"):
        for pats in (["cs", "ath"], ["c", "s.L"], ["ph"]):
            few = {r.id for r in ix.select_papers(idx, pats, None, match=match, check_exists=False).collect()}
            many = {r.id for r in ix.select_papers(idx, pats + filler, None, match=match,
                                                   check_exists=False).collect()}
            assert few == many, (match, pats)


def test_index_limit_counts_valid_records_in_order(spark):
    lines = ["{bad"] + [f'{{"id":"i{i}","categories":"cs","versions":[{{"created":"Mon, 2 Apr 2007 19:18:0{i} GMT"}}]}}'
                        for i in range(5)]
    recs = pp.parse_lines(lines_df(spark, lines)).records
    assert sorted(r.id for r in ix.build_index(recs, limit=3).index.collect()) == ["i0", "i1", "i2"]
    assert ix.build_index(recs, limit=0).index.count() == 0


def test_files_later_line_and_later_file_win(spark, tmp_path):
    folder = tmp_path / "meta"
    folder.mkdir()
    (folder / "a.json").write_text('{"id":"x","title":"a1"}\n{"id":"y","title":"a2"}\n{"id":"x","title":"a3"}\n')
    (folder / "b.json").write_text('{"id":"y","title":"b1"}\n{bad\n')
    parsed = pp.parse_lines(pp.read_lines(spark, str(folder)))
    got = {r.id: r.title for r in pp.load_papers(parsed.records, ["title"]).collect()}
    assert got == {"x": "a3", "y": "b1"}
    assert [r.reason for r in parsed.rejects.collect()] == ["malformed JSON"]


def test_load_or_build_index_reuses_stored_index(spark, tmp_path):
    folder = tmp_path / "meta"
    folder.mkdir()
    (folder / "a.json").write_text(GOOD + "\n")
    path = str(tmp_path / "idx")
    first = ix.load_or_build_index(spark, path, str(folder))
    assert [r.id for r in first.collect()] == ["a1"]
    (folder / "b.json").write_text(GOOD.replace('"a1"', '"a2"') + "\n")
    assert [r.id for r in ix.load_or_build_index(spark, path, str(folder)).collect()] == ["a1"]
    rebuilt = ix.load_or_build_index(spark, path, str(folder), rebuild=True)
    assert sorted(r.id for r in rebuilt.collect()) == ["a1", "a2"]


def test_hot_id_is_reduced_before_the_shuffle(spark):
    from paperspark.plans.explain import plan_text

    lines = [f'{{"id":"hot","title":"t{i}"}}' if i % 3 == 0 else f'{{"id":"u{i}","title":"x"}}'
             for i in range(3000)]
    recs = pp.parse_lines(lines_df(spark, lines).repartition(6)).records
    out = pp.load_papers(recs, ["title"])
    got = {r.id: r.title for r in out.collect()}
    assert got["hot"] == "t2997" and len(got) == 2001
    # The plan tree lists the final aggregate above the Exchange and the
    # partial one below it.
    tree = plan_text(out).split("\n\n")[0]
    assert "Aggregate" in tree.split("Exchange", 1)[1]
