"""Registered queries: one Spark plan and one DuckDB oracle per operator.

Every query reads the shared test tables (or data Spark derives from them)
in full. Column names agree between the two sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import index as ix
from ..session import fresh_path
from ..sources import corpus_store as cs
from ..sources import papers as pp
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


# DuckDB form of the derived paper view (see views.py).
PAPERS_SQL = """
papers AS (
  SELECT doc_id,
         'p' || doc_id AS id,
         'Document ' || doc_id || ' (' || lang || ', ' || source || ')' AS title,
         source || ' ' || lang AS categories,
         source AS category,
         text AS abstract,
         TIMESTAMP '2024-01-01 00:00:00'
           + to_seconds((doc_id % 50) * 3600 + (doc_id % 3 + 1) * 60) AS created
  FROM documents)
"""

RANGE = [dt.datetime(2024, 1, 1, 10, 0, 0), dt.datetime(2024, 1, 1, 20, 2, 0)]
INSTANT = dt.datetime(2024, 1, 1, 5, 2, 0)
# More patterns than the OR-predicate limit, so the join path runs.
MANY_PATTERNS = ["rr", "gn", "ew"] + [f"q{i}" for i in range(70)]
EVENT_RANGE = [dt.datetime(2024, 1, 3, 0, 0, 0), dt.datetime(2024, 1, 27, 12, 0, 0)]


def _records(spark, sf_dir, **kw):
    return pp.parse_lines(v.paper_lines(spark, sf_dir, **kw))


def _index(spark, sf_dir):
    return ix.build_index(_records(spark, sf_dir).records).index


def _stored_index(spark, sf_dir):
    """The index of the stored corpus, sorted, read from Parquet."""
    return cs.stored_index(spark, v.paper_store(spark, sf_dir))


@register("scan_project", f"""
WITH {PAPERS_SQL}
SELECT id, title, categories, abstract FROM papers
""")
def scan_project(spark, sf_dir):
    recs = _records(spark, sf_dir, bad_lines=True).records
    return pp.load_papers(recs, ["title", "categories", "abstract"])


@register("scan_rejects", """
SELECT 'not a JSON object' AS reason, count(*) AS n_lines FROM benchmark
""")
def scan_rejects(spark, sf_dir):
    rej = _records(spark, sf_dir, bad_lines=True).rejects
    return rej.groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))


@register("last_record_wins", f"""
WITH {PAPERS_SQL}
SELECT p.id,
       coalesce('Relabelled: quality=' || l.quality || ' toxic=' || l.toxic, p.title) AS title,
       p.categories
FROM papers p LEFT JOIN labels l ON l.doc_id = p.doc_id
""")
def last_record_wins(spark, sf_dir):
    recs = _records(spark, sf_dir, later_duplicates=True).records
    return pp.load_papers(recs, ["title", "categories"])


@register("index_flat", f"""
WITH {PAPERS_SQL}
SELECT category, created, id FROM papers
""")
def index_flat(spark, sf_dir):
    return _index(spark, sf_dir)


# Small enough that groups split at every test scale.
LIST_CHUNK = 3


@register("index_grouped", f"""
WITH {PAPERS_SQL}
SELECT category, created, count(*) OVER (PARTITION BY category, created) AS n_ids, (pos // 3)::BIGINT AS part,
       pos, id
FROM (SELECT *, row_number() OVER (PARTITION BY category, created ORDER BY id) - 1 AS pos FROM papers)
""")
def index_grouped(spark, sf_dir):
    """The nested view, flattened back: every id with its part and its place
    in the whole list of its group."""
    g = ix.ids_per_group(_index(spark, sf_dir), chunk=LIST_CHUNK)
    return g.select("category", "created", "n_ids", "part", "first_position",
                    F.posexplode("ids").alias("_i", "id")).select(
        "category", "created", "n_ids", "part", (F.col("first_position") + F.col("_i")).alias("pos"), "id")


@register("scan_files", """
SELECT doc_id::VARCHAR AS id, text AS abstract, NULL::VARCHAR AS reason, 1 AS n FROM documents
UNION ALL
SELECT NULL, NULL, CASE item_id % 6 WHEN 0 THEN 'blank line' WHEN 1 THEN 'malformed JSON' WHEN 5 THEN 'missing id' ELSE 'not a JSON object' END, count(*)
FROM benchmark GROUP BY ALL
""")
def scan_files(spark, sf_dir):
    """The corpus written as NDJSON files and scanned back: blank
    lines, malformed ones, arrays, scalars, strings and objects without an
    id are rejected with their reason."""
    docs = v.table(spark, sf_dir, "documents").select(
        F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("abstract"))).alias("value"))
    kind = F.col("item_id") % 6
    bad = v.table(spark, sf_dir, "benchmark").select(
        F.when(kind == 0, F.lit(" ")).when(kind == 1, F.lit('{"id": "x"')).when(kind == 2, F.lit('[{"id": "x"}]'))
        .when(kind == 3, F.lit("17")).when(kind == 4, F.lit('"text"'))
        .otherwise(F.to_json(F.struct(F.col("text").alias("abstract")))).alias("value"))
    path = fresh_path(spark, "lines")
    docs.unionByName(bad).write.text(path)
    parsed = pp.parse_lines(pp.read_lines(spark, path))
    good = pp.load_papers(parsed.records, ["abstract"]).select(
        "id", "abstract", F.lit(None).cast("string").alias("reason"), F.lit(1).cast("bigint").alias("n"))
    rejected = parsed.rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(rejected.select(
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("abstract"), "reason", "n"))


@register("index_group_summary", f"""
WITH {PAPERS_SQL}
SELECT category, created, count(*) AS n_ids, min(id) AS min_id, max(id) AS max_id
FROM papers GROUP BY category, created
""")
def index_group_summary(spark, sf_dir):
    return ix.group_summary(_index(spark, sf_dir))


@register("select_contains_range", f"""
WITH {PAPERS_SQL}
SELECT category, created, id FROM papers
WHERE contains(category, 'src1')
  AND created BETWEEN TIMESTAMP '2024-01-01 10:00:00' AND TIMESTAMP '2024-01-01 20:02:00'
""")
def select_contains_range(spark, sf_dir):
    return ix.select_papers(_stored_index(spark, sf_dir), "src1", RANGE)


@register("select_instant", f"""
WITH {PAPERS_SQL}
SELECT category, created, id FROM papers
WHERE (contains(category, 'src5') OR contains(category, 'src15'))
  AND created = TIMESTAMP '2024-01-01 05:02:00'
""")
def select_instant(spark, sf_dir):
    return ix.select_papers(_stored_index(spark, sf_dir), ["src5", "src15"], INSTANT)


@register("select_many_patterns", """
SELECT event_type AS category, ts AS created, CAST(event_id AS VARCHAR) AS id FROM events
WHERE (contains(event_type, 'rr') OR contains(event_type, 'gn') OR contains(event_type, 'ew'))
  AND ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-27 12:00:00'
""")
def select_many_patterns(spark, sf_dir):
    return ix.select_papers(v.event_index(spark, sf_dir), MANY_PATTERNS, EVENT_RANGE,
                            check_exists=False)


@register("select_prefix", """
SELECT event_type AS category, ts AS created, CAST(event_id AS VARCHAR) AS id FROM events
WHERE starts_with(event_type, 'v') OR starts_with(event_type, 'cl')
""")
def select_prefix(spark, sf_dir):
    return ix.select_papers(v.event_index(spark, sf_dir), ["v", "cl"], None, match="prefix",
                            check_exists=False)


@register("select_prefix_many", """
SELECT event_type AS category, ts AS created, CAST(event_id AS VARCHAR) AS id FROM events
WHERE starts_with(event_type, 'pur') OR starts_with(event_type, 'e')
""")
def select_prefix_many(spark, sf_dir):
    """Prefix matching with more patterns than the OR-predicate limit."""
    pats = ["pur", "e"] + [f"zz{i}" for i in range(80)]
    return ix.select_papers(v.event_index(spark, sf_dir), pats, None, match="prefix", check_exists=False)


@register("papers_by_ids", f"""
WITH {PAPERS_SQL}
SELECT id, title, abstract FROM papers
WHERE contains(category, 'src1')
  AND created BETWEEN TIMESTAMP '2024-01-01 10:00:00' AND TIMESTAMP '2024-01-01 20:02:00'
""")
def papers_by_ids(spark, sf_dir):
    sel = ix.select_papers(_stored_index(spark, sf_dir), "src1", RANGE)
    return cs.stored_papers(spark, v.paper_store(spark, sf_dir), ["title", "abstract"], ix.selected_ids(sel))


@register("papers_outside_range", f"""
WITH {PAPERS_SQL}
SELECT id, title, abstract FROM papers
WHERE contains(category, 'src1')
  AND created BETWEEN TIMESTAMP '1999-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00'
""")
def papers_outside_range(spark, sf_dir):
    """A selection that matches nothing loads nothing, not everything."""
    years = [dt.datetime(1999, 1, 1), dt.datetime(1999, 12, 31)]
    sel = ix.select_papers(_stored_index(spark, sf_dir), "src1", years)
    return cs.stored_papers(spark, v.paper_store(spark, sf_dir), ["title", "abstract"], ix.selected_ids(sel))


@register("select_counts", f"""
WITH {PAPERS_SQL}
SELECT count(DISTINCT (category, created)) AS n_groups, count(DISTINCT id) AS n_papers, count(*) AS n_rows
FROM papers
WHERE (contains(category, 'src1') OR contains(category, 'src11'))
  AND created BETWEEN TIMESTAMP '2024-01-01 10:00:00' AND TIMESTAMP '2024-01-01 20:02:00'
""")
def select_counts(spark, sf_dir):
    """Two overlapping patterns: every group and paper is counted once."""
    sel = ix.select_papers(_stored_index(spark, sf_dir), ["src1", "src11"], RANGE)
    return ix.selection_counts(sel)


def _delivery(docs: DataFrame, title, categories, path: str) -> None:
    """Paper lines of some documents with another title and category."""
    rec = F.struct("id", title.alias("title"), categories.alias("categories"), "abstract", "versions")
    docs.select(F.to_json(rec).alias("value")).write.mode("overwrite").text(path)


def _redelivered(spark, sf_dir) -> str:
    """A stored corpus refreshed over deliveries of files. The first holds
    every document, the second corrects those in ``labels``; then the second
    is delivered anew with other lines in its place."""
    files, store = fresh_path(spark, "deliveries"), fresh_path(spark, "corpus-store")
    docs = v.paper_records(spark, sf_dir)
    labelled = docs.join(v.table(spark, sf_dir, "labels"), "doc_id")
    _delivery(docs, F.col("title"), F.col("categories"), f"{files}/1-all")
    cs.refresh(spark, store, files)
    _delivery(labelled, F.lit("Withdrawn"), F.lit("withdrawn"), f"{files}/2-labelled")
    cs.refresh(spark, store, files)
    quality = F.concat(F.lit("quality-"), F.col("quality").cast("string"))
    _delivery(labelled, F.concat(F.col("title"), F.lit(" "), quality), quality, f"{files}/2-labelled")
    cs.refresh(spark, store, files)
    return store


@register("papers_redelivered", f"""
WITH {PAPERS_SQL}
SELECT p.id, coalesce(p.title || ' quality-' || l.quality, p.title) AS title,
       coalesce('quality-' || l.quality, p.categories) AS categories, p.abstract
FROM papers p LEFT JOIN labels l ON l.doc_id = p.doc_id
""")
def papers_redelivered(spark, sf_dir):
    """Papers of a corpus kept up to date over three deliveries: later files
    win, and lines of a replaced file are gone."""
    return cs.stored_papers(spark, _redelivered(spark, sf_dir), ["title", "categories", "abstract"])


@register("index_redelivered", f"""
WITH {PAPERS_SQL}
SELECT category, created, id FROM papers
UNION ALL
SELECT 'quality-' || l.quality, p.created, p.id FROM papers p JOIN labels l ON l.doc_id = p.doc_id
""")
def index_redelivered(spark, sf_dir):
    """The index of that corpus: one row per line of the files as they are."""
    return cs.stored_index(spark, _redelivered(spark, sf_dir))


@register("papers_limit", f"""
WITH {PAPERS_SQL}
SELECT id, title FROM papers ORDER BY doc_id LIMIT 100
""")
def papers_limit(spark, sf_dir):
    return pp.load_papers(_records(spark, sf_dir).records, ["title"], limit=100)


# Queries over the summary table, the vector store, retrieval and the feed.
from . import catalog_store  # noqa: E402,F401  (registers on import)


@register("index_rejects", """
SELECT 'b' || item_id AS id, '' AS categories, 'Mon, 1 Jan 2024 00:00:00 GMT' AS created,
       'missing category' AS reason FROM benchmark
UNION ALL
SELECT 'c' || conv_id || '-' || turn, role, 'turn ' || turn, 'missing or unparsable version time'
FROM conversations
""")
def index_rejects(spark, sf_dir):
    """Records without a category or with an unparsable version time are
    quarantined by the index build, with the reason."""
    recs = pp.parse_lines(v.index_edge_lines(spark, sf_dir)).records
    return ix.build_index(recs).rejects
