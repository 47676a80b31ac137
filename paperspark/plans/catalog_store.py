"""Registered queries for the summary table, the vector store, retrieval,
context assembly and the feed."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.embed import hash_embed
from ..functions.keys import cache_key, full_model_name, model_parts, parse_key
from ..functions.text import text_validity
from ..operators import context as ctx
from ..operators import memo
from ..operators import summaries as sm
from ..operators import transform as tf
from ..operators.cells import top_k_cells, write_cells
from ..operators.knn import top_k
from ..schemas import SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA, VECTOR_KEY, VECTOR_PARTITIONS, VECTOR_SCHEMA
from ..session import fresh_path
from ..sources import feed as fd
from ..sources.tables import insert_absent, read_table, upsert
from . import views as v
from .catalog import register

# --- summaries ---------------------------------------------------------------

SUMMARIES_SQL = """
summaries AS (
  SELECT s.name AS summarizer_name, 'openai:demo-model' AS full_model_name,
         'p' || d.doc_id AS arxiv_id,
         CASE s.name WHEN 'quality-0' THEN replace(d.text, chr(10), ' ')
                     ELSE replace(d.text, chr(10), ' | ') END AS summary_text
  FROM documents d
  CROSS JOIN (SELECT DISTINCT 'quality-' || quality AS name FROM labels WHERE quality IS NOT NULL) s)
"""

_built: dict = {}
_lock = threading.Lock()


def _summaries_of(spark, sf_dir, fn_for_agent=v.summarizer_fn, agent_name=None,
                  labelled_only: bool = False) -> DataFrame:
    """Papers x summarizer agents through the batched user functions;
    ``labelled_only`` keeps the papers listed in ``labels`` before any
    function runs."""
    papers = v.papers(spark, sf_dir)
    if labelled_only:
        papers = papers.join(_label_ids(spark, sf_dir).select(F.col("arxiv_id").alias("id")), "id", "left_semi")
    out = tf.apply_agents(papers, v.agents(spark, sf_dir), fn_for_agent, "abstract", ["id"],
                          agent_class="summarizer", agent_name=agent_name)
    return out.select(F.col("agent_name").alias("summarizer_name"),
                      F.lit(v.FULL_MODEL).alias("full_model_name"),
                      F.col("id").alias("arxiv_id"), "summary_text", "error")


def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries table of the whole corpus, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _lock:
        if key not in _built:
            path = fresh_path(spark, "summaries")
            sm.cache_summaries(_summaries_of(spark, sf_dir), path)
            _built[key] = path
    return read_table(spark, _built[key], SUMMARY_SCHEMA)


def _label_ids(spark, sf_dir) -> DataFrame:
    return v.table(spark, sf_dir, "labels").select(
        "doc_id", "quality", "toxic", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("arxiv_id"))


@register("summary_all", f"""
WITH {SUMMARIES_SQL} SELECT * FROM summaries
""")
def summary_all(spark, sf_dir):
    summary_table(spark, sf_dir)
    return sm.all_summaries(spark, _built[(spark.sparkContext.applicationId, sf_dir)])


@register("summary_stamped", f"""
WITH {SUMMARIES_SQL}
SELECT summarizer_name, count(*) AS n_rows, count(*) AS n_stamped FROM summaries GROUP BY summarizer_name
""")
def summary_stamped(spark, sf_dir):
    """Rows per summarizer, and those stamped with whole seconds by now."""
    stamp = F.col("timestamp")
    good = (stamp == F.date_trunc("second", stamp)) & (stamp <= F.current_timestamp())
    return summary_table(spark, sf_dir).groupBy("summarizer_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(good, 1)).alias("n_stamped"))


@register("by_summarizer", f"""
WITH {SUMMARIES_SQL} SELECT * FROM summaries WHERE summarizer_name = 'quality-1'
""")
def by_summarizer(spark, sf_dir):
    summary_table(spark, sf_dir).createOrReplaceTempView("summaries")
    return sm.run_named(spark, "select-summaries-by-summarizer", ["quality-1"])


@register("by_model", f"""
WITH {SUMMARIES_SQL} SELECT * FROM summaries WHERE full_model_name = 'openai:demo-model'
""")
def by_model(spark, sf_dir):
    summary_table(spark, sf_dir).createOrReplaceTempView("summaries")
    return sm.run_named(spark, "select-summaries-by-full-model", [v.FULL_MODEL])


@register("by_summarizer_model", f"""
WITH {SUMMARIES_SQL} SELECT * FROM summaries
WHERE summarizer_name = 'quality-0' AND full_model_name = 'openai:demo-model'
""")
def by_summarizer_model(spark, sf_dir):
    summary_table(spark, sf_dir).createOrReplaceTempView("summaries")
    return sm.run_named(spark, "select-summaries-by-summarizer-and-full-model",
                        ["quality-0", v.FULL_MODEL])


@register("by_paper", f"""
WITH {SUMMARIES_SQL}
SELECT s.* FROM labels l JOIN summaries s ON s.arxiv_id = 'p' || l.doc_id
""")
def by_paper(spark, sf_dir):
    return sm.lookup_summaries(summary_table(spark, sf_dir), ("arxiv_id",), _label_ids(spark, sf_dir))


@register("by_model_paper", f"""
WITH {SUMMARIES_SQL}
SELECT s.* FROM labels l JOIN summaries s
  ON s.arxiv_id = 'p' || l.doc_id AND s.full_model_name = 'openai:demo-model'
""")
def by_model_paper(spark, sf_dir):
    vals = _label_ids(spark, sf_dir).withColumn("full_model_name", F.lit(v.FULL_MODEL))
    return sm.lookup_summaries(summary_table(spark, sf_dir), ("full_model_name", "arxiv_id"), vals)


@register("by_summarizer_paper", f"""
WITH {SUMMARIES_SQL}
SELECT s.* FROM labels l JOIN summaries s
  ON s.arxiv_id = 'p' || l.doc_id
 AND s.summarizer_name = CASE WHEN l.quality = 1 THEN 'quality-0' ELSE 'quality-1' END
""")
def by_summarizer_paper(spark, sf_dir):
    vals = _label_ids(spark, sf_dir).withColumn(
        "summarizer_name", F.when(F.col("quality") == 1, "quality-0").otherwise("quality-1"))
    return sm.lookup_summaries(summary_table(spark, sf_dir), ("summarizer_name", "arxiv_id"), vals)


@register("by_all_three", f"""
WITH {SUMMARIES_SQL}
SELECT s.* FROM labels l JOIN summaries s
  ON s.arxiv_id = 'p' || l.doc_id AND s.full_model_name = 'openai:demo-model'
 AND s.summarizer_name = CASE WHEN l.toxic = 1 THEN 'quality-1' ELSE 'quality-0' END
""")
def by_all_three(spark, sf_dir):
    vals = (_label_ids(spark, sf_dir).withColumn("full_model_name", F.lit(v.FULL_MODEL))
            .withColumn("summarizer_name", F.when(F.col("toxic") == 1, "quality-1")
                        .otherwise("quality-0")))
    return sm.lookup_summaries(summary_table(spark, sf_dir), ("summarizer_name", "full_model_name", "arxiv_id"), vals)


@register("by_key_tuple", f"""
WITH {SUMMARIES_SQL}
SELECT s.* FROM labels l
CROSS JOIN (SELECT DISTINCT 'quality-' || quality AS name FROM labels WHERE quality IS NOT NULL) a
JOIN summaries s ON (s.summarizer_name, s.full_model_name, s.arxiv_id)
                  = (a.name, 'openai:demo-model', 'p' || l.doc_id)
""")
def by_key_tuple(spark, sf_dir):
    names = [r.agent_name for r in tf.agent_rows(v.agents(spark, sf_dir))]
    vals = (tf.agent_keys(_label_ids(spark, sf_dir), names, ["arxiv_id"], "summarizer_name")
            .withColumn("full_model_name", F.lit(v.FULL_MODEL)))
    return sm.lookup_summaries(summary_table(spark, sf_dir), None, vals)


@register("summary_multi_key", f"""
WITH {SUMMARIES_SQL},
keys AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE quality = 1)
SELECT s.* FROM keys k JOIN summaries s
  ON s.arxiv_id = 'p' || k.doc_id AND s.summarizer_name = 'quality-0'
""")
def summary_multi_key(spark, sf_dir):
    ids = _label_ids(spark, sf_dir)
    keys = ids.unionByName(ids.filter(F.col("quality") == 1)).withColumn(
        "summarizer_name", F.lit("quality-0"))
    return sm.lookup_summaries(summary_table(spark, sf_dir), ("summarizer_name", "arxiv_id"), keys)


@register("summary_grouped", f"""
WITH {SUMMARIES_SQL}
SELECT summarizer_name, count(*) OVER (PARTITION BY summarizer_name) AS n_items, (pos // 7)::BIGINT AS part, pos,
       arxiv_id, summary_text
FROM (SELECT *, row_number() OVER (PARTITION BY summarizer_name ORDER BY arxiv_id) - 1 AS pos FROM summaries)
""")
def summary_grouped(spark, sf_dir):
    """Summaries per summarizer, flattened back: every pair with its part and
    its place in its group's list."""
    g = sm.summaries_by_summarizer(summary_table(spark, sf_dir), chunk=7)
    return g.select("summarizer_name", "n_items", "part", "first_position",
                    F.posexplode("items").alias("_i", "_e")).select(
        "summarizer_name", "n_items", "part", (F.col("first_position") + F.col("_i")).alias("pos"),
        F.col("_e.arxiv_id").alias("arxiv_id"), F.col("_e.summary_text").alias("summary_text"))


def _named(name, query, args, where):
    @register(name, f"WITH {SUMMARIES_SQL} SELECT * FROM summaries WHERE {where}")
    def run(spark, sf_dir):
        summary_table(spark, sf_dir).createOrReplaceTempView("summaries")
        return sm.run_named(spark, query, args)
    return run


_named("named_all", "select-all-summaries", [], "TRUE")
_named("named_primary_key", "select-summaries-by-primary-key", ["quality-1", v.FULL_MODEL, "p17"],
       "summarizer_name = 'quality-1' AND arxiv_id = 'p17'")
_named("named_paper", "select-summaries-by-arxiv-id", ["p5"], "arxiv_id = 'p5'")
_named("named_model_paper", "select-summaries-by-full-model-and-arxiv-id", [v.FULL_MODEL, "p6"], "arxiv_id = 'p6'")
_named("named_summarizer_paper", "select-summaries-by-summarizer-and-arxiv-id", ["quality-0", "p7"],
       "summarizer_name = 'quality-0' AND arxiv_id = 'p7'")
_named("named_all_three", "select-summaries-by-summarizer-and-full-model-and-arxiv-id",
       ["quality-1", v.FULL_MODEL, "p8"], "summarizer_name = 'quality-1' AND arxiv_id = 'p8'")


@register("summary_create", f"""
WITH {SUMMARIES_SQL} SELECT * FROM summaries WHERE summarizer_name = 'quality-1'
""")
def summary_create(spark, sf_dir):
    """A table created empty, created again (nothing happens), then filled."""
    path = fresh_path(spark, "summaries-created")
    sm.create_summaries_table(spark, path)
    sm.cache_summaries(_summaries_of(spark, sf_dir, agent_name="quality-1"), path)
    sm.create_summaries_table(spark, path)
    return sm.all_summaries(spark, path)


@register("summary_upsert", f"""
WITH {SUMMARIES_SQL},
old AS (SELECT 'p' || doc_id AS arxiv_id, replace(text, chr(10), '  ') AS t FROM documents)
SELECT s.summarizer_name, s.full_model_name, s.arxiv_id,
       CASE WHEN s.summarizer_name = 'quality-0' AND l.doc_id IS NULL THEN o.t
            ELSE s.summary_text END AS summary_text
FROM summaries s JOIN old o USING (arxiv_id)
LEFT JOIN labels l ON s.arxiv_id = 'p' || l.doc_id
""")
def summary_upsert(spark, sf_dir):
    """First batch: both agents, the domain expert from an earlier run.
    Second batch (papers in ``labels``, domain expert only) holds each key
    twice: a stale row, then the current one; the later row wins and the
    other agent's partition is untouched."""
    path = fresh_path(spark, "summaries-upsert")
    first = (_summaries_of(spark, sf_dir, lambda n, i: v.earlier_summarizer_fn, "quality-0")
             .unionByName(_summaries_of(spark, sf_dir, agent_name="quality-1")))
    sm.cache_summaries(first, path)
    cur = _summaries_of(spark, sf_dir, agent_name="quality-0", labelled_only=True)
    second = (cur.withColumn("summary_text", F.lit("stale")).withColumn("_ord", F.lit(0))
              .unionByName(cur.withColumn("_ord", F.lit(1))))
    sm.cache_summaries(second, path, order_col="_ord")
    return sm.all_summaries(spark, path)


@register("summary_insert_absent", f"""
WITH {SUMMARIES_SQL},
old AS (SELECT 'p' || doc_id AS arxiv_id, replace(text, chr(10), '  ') AS t FROM documents)
SELECT 'quality-0' AS summarizer_name, 'openai:demo-model' AS full_model_name,
       arxiv_id, t AS summary_text FROM old
UNION ALL
SELECT s.summarizer_name, s.full_model_name, s.arxiv_id, s.summary_text
FROM summaries s JOIN labels l ON s.arxiv_id = 'p' || l.doc_id
WHERE s.summarizer_name = 'quality-1'
""")
def summary_insert_absent(spark, sf_dir):
    """Insert-if-absent: stored keys keep their text; new keys take the
    first of their rows in the batch."""
    path = fresh_path(spark, "summaries-insert")
    base = _summaries_of(spark, sf_dir, lambda n, i: v.earlier_summarizer_fn, "quality-0")
    sm.cache_summaries(base, path)
    offered = _summaries_of(spark, sf_dir, labelled_only=True).drop("error")
    batch = (offered.withColumn("_ord", F.lit(0))
             .unionByName(offered.withColumn("summary_text", F.lit("later duplicate")).withColumn("_ord", F.lit(1)))
             .withColumn("timestamp", F.date_trunc("second", F.current_timestamp())))
    insert_absent(batch, path, SUMMARY_KEY, SUMMARY_PARTITIONS, SUMMARY_SCHEMA, order_col="_ord")
    return sm.all_summaries(spark, path)


@register("uncached_summaries", """
SELECT s.name AS summarizer_name, 'p' || d.doc_id AS arxiv_id
FROM documents d CROSS JOIN (SELECT DISTINCT 'quality-' || quality AS name FROM labels WHERE quality IS NOT NULL) s
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND s.name = 'quality-0')
""")
def uncached_summaries(spark, sf_dir):
    path = fresh_path(spark, "summaries-memo")
    _precache(spark, sf_dir, path)
    wanted = _wanted_summaries(spark, sf_dir)
    todo = memo.missing_rows(wanted, read_table(spark, path, SUMMARY_SCHEMA), SUMMARY_KEY, probe=True)
    return todo.select("summarizer_name", "arxiv_id")


def _precache(spark, sf_dir, path):
    """Summaries from an earlier run for the papers in ``labels``."""
    early = _summaries_of(spark, sf_dir, lambda n, i: v.earlier_summarizer_fn, "quality-0",
                          labelled_only=True)
    sm.cache_summaries(early, path)


def _wanted_summaries(spark, sf_dir):
    """Keys of every summary; no text."""
    names = [r.agent_name for r in tf.agent_rows(v.agents(spark, sf_dir))]
    keys = tf.agent_keys(v.papers(spark, sf_dir), names, ["id"], "summarizer_name")
    return keys.select("summarizer_name", F.lit(v.FULL_MODEL).alias("full_model_name"), F.col("id").alias("arxiv_id"))


@register("merged_summaries", f"""
WITH {SUMMARIES_SQL}
SELECT s.summarizer_name, s.full_model_name, s.arxiv_id,
       CASE WHEN l.doc_id IS NOT NULL AND s.summarizer_name = 'quality-0'
            THEN replace(d.text, chr(10), '  ') ELSE s.summary_text END AS summary_text,
       (l.doc_id IS NOT NULL AND s.summarizer_name = 'quality-0') AS cached
FROM summaries s JOIN documents d ON s.arxiv_id = 'p' || d.doc_id
LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def merged_summaries(spark, sf_dir):
    """Summarise only what the cache lacks, store it, return everything."""
    from .corpus import summarise_missing

    path = fresh_path(spark, "summaries-memo")
    _precache(spark, sf_dir, path)
    merged = summarise_missing(v.papers(spark, sf_dir), v.agents(spark, sf_dir), v.summarizer_fn, path,
                               v.MODEL_NAME, v.MODEL_SPEC)
    return merged.select("summarizer_name", "full_model_name", "arxiv_id", "summary_text", "cached")


# --- agents and batched functions -------------------------------------------

@register("agents_x_texts", """
SELECT s.name AS agent_name, 'p' || d.doc_id AS id,
       CASE s.name WHEN 'quality-0' THEN replace(d.text, chr(10), ' ')
                   ELSE replace(d.text, chr(10), ' | ') END AS summary_text,
       NULL::VARCHAR AS error
FROM documents d CROSS JOIN (SELECT DISTINCT 'quality-' || quality AS name FROM labels WHERE quality IS NOT NULL) s
""")
def agents_x_texts(spark, sf_dir):
    return tf.apply_agents(v.papers(spark, sf_dir), v.agents(spark, sf_dir), v.summarizer_fn, "abstract", ["id"])


@register("outputs_per_agent", """
SELECT s.name AS agent_name, count(*) OVER (PARTITION BY s.name) AS n_items, (pos // 7)::BIGINT AS part, pos,
       CASE s.name WHEN 'quality-0' THEN replace(d.text, chr(10), ' ')
                   ELSE replace(d.text, chr(10), ' | ') END AS output
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) d
CROSS JOIN (SELECT DISTINCT 'quality-' || quality AS name FROM labels WHERE quality IS NOT NULL) s
""")
def outputs_per_agent(spark, sf_dir):
    """Outputs regrouped per agent in input order, flattened back: every
    output with its part and its place in its agent's list."""
    res = agents_x_texts(spark, sf_dir).withColumn("_n", F.expr("cast(substring(id, 2) as bigint)"))
    g = tf.outputs_per_agent(res, "_n", chunk=7)
    return g.select("agent_name", "n_items", "part", "first_position", F.posexplode("outputs").alias("_i", "output")) \
        .select("agent_name", "n_items", "part", (F.col("first_position") + F.col("_i")).alias("pos"), "output")


def _odd_length_fails(name, instructions):
    def run(texts):
        if any(len(t) % 2 for t in texts):
            raise ValueError("odd length")
        return [t.upper() if name == "quality-1" else t for t in texts]
    return run


@register("agents_with_errors", """
SELECT s.name AS agent_name, 'p' || d.doc_id AS id,
       CASE WHEN length(d.text) % 2 = 1 THEN NULL ELSE d.text END AS summary_text,
       CASE WHEN length(d.text) % 2 = 1 THEN 'ValueError: ' || chr(39) || s.name || chr(39) || ': odd length' END AS error
FROM documents d CROSS JOIN (VALUES ('quality-0')) s(name)
""")
def agents_with_errors(spark, sf_dir):
    """A function that fails for some texts, one text to a request."""
    return tf.apply_agents(v.papers(spark, sf_dir), v.agents(spark, sf_dir), _odd_length_fails, "abstract", ["id"],
                           agent_name="quality-0", batch_size=1)


@register("text_validity", """
SELECT doc_id, length(text) AS n_chars,
       (text IS NOT NULL AND regexp_matches(text, '\\S') AND length(text) <= 8192) AS is_valid,
       CASE WHEN text IS NULL THEN 'text is NULL'
            WHEN NOT regexp_matches(text, '\\S') THEN 'text is empty or white space'
            WHEN length(text) > 8192 THEN 'text exceeds 8192 characters'
            ELSE 'valid' END AS reason
FROM documents
""")
def text_validity_q(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents")
    tv = text_validity("text")
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"),
                    tv["is_valid"].alias("is_valid"), tv["reason"].alias("reason"))


def _shape_fn(texts):
    """A user embedding function: (characters, line breaks) per text."""
    return [[float(len(t)), float(t.count("\n"))] for t in texts]


@register("embed_batched", """
SELECT doc_id, length(text)::DOUBLE AS n_chars,
       (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS n_lines, NULL::VARCHAR AS error
FROM documents WHERE regexp_matches(text, '\\S') AND length(text) <= 8192
""")
def embed_batched(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    vecs, _ = tf.embed_with(d, _shape_fn, "text", ["doc_id"], batch_size=20)
    return vecs.select("doc_id", F.col("embedding")[0].alias("n_chars"),
                       F.col("embedding")[1].alias("n_lines"), "error")


@register("embed_rejects", """
SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'text is empty or white space'
                    ELSE 'text exceeds 8192 characters' END AS reason
FROM documents WHERE NOT regexp_matches(text, '\\S') OR length(text) > 8192
""")
def embed_rejects(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    _, rej = tf.embed_with(d, _shape_fn, "text", ["doc_id"])
    return rej.select("doc_id", "reason")


# --- vectors -----------------------------------------------------------------

STORE_SQL = """
store AS (
  SELECT vec_id, 'A' || (label % 2) AS agent_name, 'openai' AS model_name, 'emb-64' AS model_spec,
         'p' || (vec_id // 3) AS arxiv_id,
         CASE vec_id % 3 WHEN 0 THEN 'abstract' WHEN 1 THEN 'title' ELSE 'summary' END AS label,
         embedding
  FROM embeddings)
"""

TOKENS_SQL = """
doc_tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents),
doc_vec AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n
            FROM doc_tok WHERE w <> '' GROUP BY ALL)
"""


def _vec_text(col="embedding"):
    return F.array_join(F.transform(col, lambda x: x.cast("bigint").cast("string")), ",")


@register("hash_embed", f"""
WITH {TOKENS_SQL},
grid AS (SELECT d.doc_id, g.b FROM documents d CROSS JOIN range(64) g(b))
SELECT g.doc_id, string_agg(coalesce(v.n, 0)::BIGINT::VARCHAR, ',' ORDER BY g.b) AS vec_text
FROM grid g LEFT JOIN doc_vec v ON v.doc_id = g.doc_id AND v.b = g.b
GROUP BY g.doc_id
""")
def hash_embed_q(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents")
    return hash_embed(d, ["doc_id"], "text", partitions=v.cores(spark, sf_dir)).select("doc_id", _vec_text().alias("vec_text"))


def _label_keys(spark, sf_dir, agent="A0", model="openai", spec="emb-64"):
    return _label_ids(spark, sf_dir).select(
        F.lit(agent).alias("agent_name"), F.lit(model).alias("model_name"), F.lit(spec).alias("model_spec"),
        "arxiv_id", F.lit("abstract").alias("label"))


@register("keys_present", f"""
WITH {STORE_SQL},
asked AS (SELECT agent_name, model_name, model_spec, arxiv_id, label FROM store
          UNION SELECT 'A0', 'openai', 'emb-64', 'p' || doc_id, 'abstract' FROM labels)
SELECT DISTINCT a.* FROM asked a JOIN store s USING (agent_name, model_name, model_spec, arxiv_id, label)
""")
def keys_present(spark, sf_dir):
    store = v.embedding_store(spark, sf_dir)
    asked = store.select(*VECTOR_KEY).unionByName(_label_keys(spark, sf_dir))
    return memo.present_keys(asked, store, list(VECTOR_KEY), probe=True)


@register("store_integrity", f"""
WITH {STORE_SQL},
asked AS (SELECT agent_name, model_name, model_spec, arxiv_id, label FROM store
          UNION SELECT 'A0', 'openai', 'emb-64', 'p' || doc_id, 'abstract' FROM labels)
SELECT a.*, EXISTS (SELECT 1 FROM store s WHERE (s.agent_name, s.model_name, s.model_spec, s.arxiv_id, s.label)
                                              = (a.agent_name, a.model_name, a.model_spec, a.arxiv_id, a.label)) AS has_value
FROM asked a
""")
def store_integrity(spark, sf_dir):
    store = v.embedding_store(spark, sf_dir)
    asked = store.select(*VECTOR_KEY).unionByName(_label_keys(spark, sf_dir))
    return memo.checked_lookup(asked, store, list(VECTOR_KEY), "embedding", on_missing="flag").drop("embedding")


def _precache_vectors(spark, sf_dir, path):
    texts = v.document_texts(spark, sf_dir).join(_label_ids(spark, sf_dir).select("arxiv_id"), "arxiv_id", "left_semi")
    upsert(hash_embed(texts, list(VECTOR_KEY), "text", partitions=v.cores(spark, sf_dir)), path, list(VECTOR_KEY),
           VECTOR_PARTITIONS, VECTOR_SCHEMA)


@register("uncached_vectors", """
SELECT 'p' || doc_id AS arxiv_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def uncached_vectors(spark, sf_dir):
    path = fresh_path(spark, "vectors-memo")
    _precache_vectors(spark, sf_dir, path)
    todo = memo.missing_rows(v.document_texts(spark, sf_dir), read_table(spark, path, VECTOR_SCHEMA), list(VECTOR_KEY))
    return todo.select("arxiv_id")


@register("merged_vectors", f"""
WITH {TOKENS_SQL},
grid AS (SELECT d.doc_id, g.b FROM documents d CROSS JOIN range(64) g(b)),
vecs AS (SELECT g.doc_id, string_agg(coalesce(v.n, 0)::BIGINT::VARCHAR, ',' ORDER BY g.b) AS vec_text
         FROM grid g LEFT JOIN doc_vec v ON v.doc_id = g.doc_id AND v.b = g.b GROUP BY g.doc_id)
SELECT 'A0' AS agent_name, 'p' || vecs.doc_id AS arxiv_id, vec_text,
       vecs.doc_id IN (SELECT doc_id FROM labels) AS cached
FROM vecs
""")
def merged_vectors(spark, sf_dir):
    """Embed only the documents without a stored vector, store, return all."""
    path = fresh_path(spark, "vectors-memo")
    _precache_vectors(spark, sf_dir, path)

    def compute(todo):
        return hash_embed(todo, list(VECTOR_KEY), "text", partitions=v.cores(spark, sf_dir))

    merged = memo.memoised(v.document_texts(spark, sf_dir), list(VECTOR_KEY), compute, path,
                           VECTOR_PARTITIONS, VECTOR_SCHEMA)
    return merged.select("agent_name", "arxiv_id", _vec_text().alias("vec_text"), "cached")


@register("key_build_parse", f"""
WITH {STORE_SQL}
SELECT agent_name || ':' || model_name || ':' || model_spec || ':' || arxiv_id || ':' || label AS cache_key,
       agent_name, model_name, model_spec, arxiv_id, label,
       'sec:' || label AS nested_label
FROM store
""")
def key_build_parse(spark, sf_dir):
    s = v.embedding_store(spark, sf_dir)
    k = cache_key("agent_name", "model_name", "model_spec", "arxiv_id", "label")
    nested = cache_key("agent_name", "model_name", "model_spec", "arxiv_id", F.concat(F.lit("sec:"), F.col("label")))
    p, q = parse_key(k), parse_key(nested)
    return s.select(k.alias("cache_key"), *[p[c].alias(c) for c in VECTOR_KEY], q["label"].alias("nested_label"))


@register("model_parts", f"""
WITH {STORE_SQL}
SELECT agent_name, arxiv_id, label, upper(model_name) || ':' || model_spec AS model_string,
       model_name, model_spec, model_name IN ('openai') AS is_supported,
       model_name || ':' || model_spec AS full_model_name
FROM store
""")
def model_parts_q(spark, sf_dir):
    s = v.embedding_store(spark, sf_dir).withColumn(
        "model_string", F.concat(F.upper("model_name"), F.lit(":"), F.col("model_spec")))
    m = model_parts("model_string")
    return s.select("agent_name", "arxiv_id", "label", "model_string",
                    m["model_name"].alias("model_name"), m["model_spec"].alias("model_spec"),
                    m["is_supported"].alias("is_supported"),
                    full_model_name(m["model_name"], m["model_spec"]).alias("full_model_name"))


@register("agent_vectors", f"""
WITH {STORE_SQL}
SELECT arxiv_id, list_sum(embedding::DOUBLE[]) AS total, len(embedding) AS dims FROM store
WHERE agent_name = 'A1' AND model_name = 'openai' AND model_spec = 'emb-64' AND label = 'abstract'
""")
def agent_vectors(spark, sf_dir):
    from ..operators.vectors import vectors_of_agent

    s = vectors_of_agent(v.embedding_store(spark, sf_dir), "A1", "openai", "emb-64")
    return s.select("arxiv_id", F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b).alias("total"),
                    F.size("embedding").cast("bigint").alias("dims"))


@register("vector_dims", f"""
WITH {STORE_SQL}
SELECT count(*) AS n_vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM store
""")
def vector_dims(spark, sf_dir):
    from ..operators.vectors import dimension_stats

    return dimension_stats(v.embedding_store(spark, sf_dir))


_TOPK_SQL = f"""
WITH {STORE_SQL},
pairs AS (
  SELECT q.vec_id AS query_id, s.agent_name, s.model_name, s.model_spec, s.arxiv_id, s.label,
         list_sum(list_transform(list_zip(q.embedding, s.embedding),
                  lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS dist
  FROM embeddings q CROSS JOIN store s)
"""


@register("topk_many", _TOPK_SQL + """
SELECT query_id, rank, agent_name, model_name, model_spec, arxiv_id, label, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id
                               ORDER BY dist, agent_name, model_name, model_spec, arxiv_id, label) AS rank
  FROM pairs) WHERE rank <= 5
""")
def topk_many(spark, sf_dir):
    res = top_k(v.embedding_queries(spark, sf_dir), v.embedding_store(spark, sf_dir), 5,
                query_key=["query_id"], vector_key=list(VECTOR_KEY))
    return res.withColumn("rank", F.col("rank").cast("bigint"))


@register("topk_cells", _TOPK_SQL + """
SELECT query_id, rank, agent_name, model_name, model_spec, arxiv_id, label, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id
                               ORDER BY dist, agent_name, model_name, model_spec, arxiv_id, label) AS rank
  FROM pairs) WHERE rank <= 5
""")
def topk_cells(spark, sf_dir):
    """The same search over vectors stored by cells, of which each query reads
    only those that can hold one of its nearest."""
    path = fresh_path(spark, "cells")
    write_cells(v.embedding_store(spark, sf_dir), path, list(VECTOR_KEY))
    res = top_k_cells(v.embedding_queries(spark, sf_dir), path, 5, ["query_id"], list(VECTOR_KEY))
    return res.withColumn("rank", F.col("rank").cast("bigint"))


@register("topk_dedupe", _TOPK_SQL + """
SELECT query_id, rank, agent_name, model_name, model_spec, arxiv_id, label, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id
                               ORDER BY dist, agent_name, model_name, model_spec, arxiv_id, label) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, arxiv_id
                    ORDER BY dist, agent_name, model_name, model_spec, arxiv_id, label) AS g FROM pairs)
  WHERE g = 1) WHERE rank <= 5
""")
def topk_dedupe(spark, sf_dir):
    res = top_k(v.embedding_queries(spark, sf_dir), v.embedding_store(spark, sf_dir), 5,
                query_key=["query_id"], vector_key=list(VECTOR_KEY), group_col="arxiv_id")
    return res.withColumn("rank", F.col("rank").cast("bigint"))


# --- retrieval and context --------------------------------------------------

RETRIEVE_SQL = f"""
WITH {TOKENS_SQL},
q_tok AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark),
q_vec AS (SELECT item_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n
          FROM q_tok WHERE w <> '' GROUP BY ALL),
dn AS (SELECT d.doc_id, coalesce(sum(v.n * v.n), 0) AS nn FROM documents d LEFT JOIN doc_vec v USING (doc_id) GROUP BY d.doc_id),
qn AS (SELECT q.item_id, coalesce(sum(v.n * v.n), 0) AS nn FROM benchmark q LEFT JOIN q_vec v USING (item_id) GROUP BY q.item_id),
dots AS (SELECT q.item_id, d.doc_id, sum(q.n * d.n) AS dot FROM q_vec q JOIN doc_vec d USING (b) GROUP BY ALL),
dist AS (SELECT qn.item_id, dn.doc_id, qn.nn + dn.nn - 2 * coalesce(dots.dot, 0) AS dist
         FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.item_id = qn.item_id AND dots.doc_id = dn.doc_id),
ranked AS (SELECT item_id AS question_id, 'p' || doc_id AS arxiv_id, dist,
                  row_number() OVER (PARTITION BY item_id ORDER BY dist, 'p' || doc_id) AS rank
           FROM dist QUALIFY rank <= 5),
hits AS (SELECT r.*, 'Document ' || d.doc_id || ' (' || d.lang || ', ' || d.source || ')' AS title,
                d.text AS abstract
         FROM ranked r JOIN documents d ON r.arxiv_id = 'p' || d.doc_id)
"""


def _hits(spark, sf_dir):
    return ctx.retrieve(v.questions(spark, sf_dir), v.document_store(spark, sf_dir), v.papers_of(spark, sf_dir),
                        k=5, question_key=["question_id"])


@register("retrieve_papers", RETRIEVE_SQL + """
SELECT question_id, rank::BIGINT AS rank, arxiv_id, dist, title FROM hits
""")
def retrieve_papers(spark, sf_dir):
    return _hits(spark, sf_dir).select("question_id", F.col("rank").cast("bigint").alias("rank"),
                                       "arxiv_id", "dist", "title")


@register("context_text", RETRIEVE_SQL + """
SELECT b.item_id AS question_id,
       'Question: ' || b.text || chr(10) || chr(10) || 'Context:' || chr(10) ||
       coalesce(string_agg('arXiv:' || h.arxiv_id || chr(10) || 'Abstract: ' || h.abstract || chr(10) || chr(10),
                           '' ORDER BY h.rank), '') AS context
FROM benchmark b LEFT JOIN hits h ON h.question_id = b.item_id
GROUP BY b.item_id, b.text
""")
def context_text_q(spark, sf_dir):
    qs = v.questions(spark, sf_dir)
    return ctx.context_text(_hits(spark, sf_dir), qs, ["question_id"], "question")


@register("context_sources", RETRIEVE_SQL + """
SELECT question_id, string_agg('- arXiv:' || arxiv_id || ' Title: ' || title, chr(10) ORDER BY rank) AS sources
FROM hits GROUP BY question_id
""")
def context_sources_q(spark, sf_dir):
    return ctx.context_sources(_hits(spark, sf_dir), ["question_id"])


# --- feed -------------------------------------------------------------------

FEED_SQL = """
feed AS (
  SELECT 'Document ' || doc_id AS title,
         'Author of ' || source || '; ' || 'Editor ' || lang AS authors,
         replace(text, chr(10), ' ') AS summary,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS published,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60 + n_chars), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS updated,
         'https://papers.example/pdf/p' || doc_id AS pdf_url,
         'https://papers.example/abs/p' || doc_id AS entry_id
  FROM documents)
"""


def _feed(spark, sf_dir):
    f = fd.normalise_feed(v.raw_feed(spark, sf_dir))
    return f.withColumn("authors", F.array_join("authors", "; "))


@register("feed_normalise", f"WITH {FEED_SQL} SELECT * FROM feed")
def feed_normalise(spark, sf_dir):
    return _feed(spark, sf_dir)


@register("feed_newest", f"WITH {FEED_SQL} SELECT * FROM feed ORDER BY published DESC, entry_id LIMIT 100")
def feed_newest(spark, sf_dir):
    return fd.newest(_feed(spark, sf_dir), 100)


@register("feed_round_trip", f"WITH {FEED_SQL} SELECT title, authors, summary, published, updated, pdf_url, entry_id FROM feed")
def feed_round_trip(spark, sf_dir):
    """The normalised feed saved as JSON and read back."""
    path = fresh_path(spark, "feed")
    fd.write_feed(fd.normalise_feed(v.raw_feed(spark, sf_dir)), path)
    back = fd.read_saved_feed(spark, path, array_file=False)
    return back.withColumn("authors", F.array_join("authors", "; "))


@register("feed_fractions", """
SELECT 'https://papers.example/abs/p' || doc_id AS entry_id,
       strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.' || strftime(t, '%f') END || '+00:00' AS published
FROM (SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(doc_id * 60000000 + (doc_id % 3) * 250001) AS t
      FROM documents)
""")
def feed_fractions(spark, sf_dir):
    """Publication instants with fractions of a second."""
    raw = v.raw_feed(spark, sf_dir).withColumn("_d", F.regexp_extract("entry_id", "p([0-9]+)$", 1).cast("bigint"))
    base = 1704067200000000
    raw = raw.withColumn("published", F.timestamp_micros(
        F.lit(base) + F.col("_d") * 60000000 + (F.col("_d") % 3) * 250001))
    return fd.normalise_feed(raw).select("entry_id", "published")


# --- the whole corpus build -------------------------------------------------

@register("corpus_build", f"""
WITH {TOKENS_SQL},
sel AS (SELECT doc_id, text FROM documents
        WHERE contains(source, 'src1')
          AND TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id % 50) * 3600 + (doc_id % 3 + 1) * 60)
              BETWEEN TIMESTAMP '2024-01-01 10:00:00' AND TIMESTAMP '2024-01-01 20:02:00'),
summ AS (SELECT s.name AS agent_name, sel.doc_id,
                CASE s.name WHEN 'quality-0' THEN replace(sel.text, chr(10), ' ')
                            ELSE replace(sel.text, chr(10), ' | ') END AS summary
         FROM sel CROSS JOIN (SELECT DISTINCT 'quality-' || quality AS name FROM labels WHERE quality IS NOT NULL) s),
ok AS (SELECT * FROM summ WHERE regexp_matches(summary, '\\S') AND length(summary) <= 8192),
grid AS (SELECT ok.agent_name, ok.doc_id, g.b FROM ok CROSS JOIN range(64) g(b))
SELECT g.agent_name, 'p' || g.doc_id AS arxiv_id, 'abstract' AS label,
       string_agg(coalesce(v.n, 0)::BIGINT::VARCHAR, ',' ORDER BY g.b) AS vec_text
FROM grid g LEFT JOIN doc_vec v ON v.doc_id = g.doc_id AND v.b = g.b
GROUP BY g.agent_name, g.doc_id
""")
def corpus_build(spark, sf_dir):
    """Index, select ('src1', 10:00 to 20:02), summarise with both
    summarizers, embed the summaries, snapshot. Summaries fold newlines
    into separators, so each vector equals the hash vector of the text."""
    from .catalog import RANGE
    from .corpus import CorpusPaths, build_corpus

    paths = CorpusPaths(*(fresh_path(spark, n) for n in ("index", "summaries", "vectors", "snapshot")))
    out = build_corpus(spark, v.paper_files(spark, sf_dir), paths, "src1", RANGE, v.agents(spark, sf_dir),
                       v.summarizer_fn, (v.MODEL_NAME, v.MODEL_SPEC), ("hash", "64"), embed_partitions=v.cores(spark, sf_dir))
    return out.snapshot.select("agent_name", "arxiv_id", "label", _vec_text().alias("vec_text"))


def _length_answer(contexts):
    """A user answer function: how much context the question received."""
    return [f"{len(c)} characters of context" for c in contexts]


def _embed_even(texts):
    """A user embedder that refuses texts of odd length."""
    if any(len(t) % 2 for t in texts):
        raise ValueError("odd length")
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@register("answers", RETRIEVE_SQL + """,
ctx AS (
  SELECT b.item_id AS question_id,
         'Question: ' || b.text || chr(10) || chr(10) || 'Context:' || chr(10) ||
         coalesce(string_agg('arXiv:' || h.arxiv_id || chr(10) || 'Abstract: ' || h.abstract || chr(10) || chr(10),
                             '' ORDER BY h.rank), '') AS context,
         string_agg('- arXiv:' || h.arxiv_id || ' Title: ' || h.title, chr(10) ORDER BY h.rank) AS sources
  FROM benchmark b LEFT JOIN hits h ON h.question_id = b.item_id
  GROUP BY b.item_id, b.text)
SELECT question_id, context, length(context) || ' characters of context' AS answer, sources, NULL::VARCHAR AS error
FROM ctx
""")
def answers_q(spark, sf_dir):
    from .answers import answer_questions

    qs = v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"),
                                                     F.col("text").alias("question"))
    out = answer_questions(qs, v.document_store(spark, sf_dir), v.papers_of(spark, sf_dir), _length_answer)
    return out.answers.select("question_id", "context", "answer", "sources", "error")


@register("answers_failed", """
WITH d AS (SELECT doc_id, length(text) AS c, length(text) - length(replace(text, ' ', '')) AS s, text, lang, source
           FROM documents),
q AS (SELECT item_id, text, length(text) AS c, length(text) - length(replace(text, ' ', '')) AS s FROM benchmark),
r AS (SELECT q.item_id, d.doc_id, d.text,
             row_number() OVER (PARTITION BY q.item_id
               ORDER BY (d.c - q.c) * (d.c - q.c) + (d.s - q.s) * (d.s - q.s), 'p' || d.doc_id) AS k
      FROM q CROSS JOIN d WHERE q.c % 2 = 0 QUALIFY k <= 5)
SELECT q.item_id AS question_id,
       CASE WHEN q.c % 2 = 0 THEN 'Question: ' || any_value(q.text) || chr(10) || chr(10) || 'Context:' || chr(10) ||
         string_agg('arXiv:p' || r.doc_id || chr(10) || 'Abstract: ' || r.text || chr(10) || chr(10), '' ORDER BY k)
       END AS context,
       CASE WHEN q.c % 2 = 1 THEN 'ValueError: odd length' END AS error
FROM q LEFT JOIN r USING (item_id) GROUP BY q.item_id, q.c
""")
def answers_failed(spark, sf_dir):
    """Questions that the embedder refuses keep their row, with the error."""
    from .answers import answer_questions

    qs = v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"),
                                                     F.col("text").alias("question"))
    spaces = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    store = v.table(spark, sf_dir, "documents").select(
        F.lit("A0").alias("agent_name"), F.lit("shape").alias("model_name"), F.lit("2").alias("model_spec"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("arxiv_id"), F.lit("abstract").alias("label"),
        F.array(F.length("text").cast("double"), spaces.cast("double")).alias("embedding"))
    out = answer_questions(qs.repartition(4, "question_id"), store, v.papers_of(spark, sf_dir), _length_answer,
                           embed=_embed_even, embed_batch=1)
    return out.answers.select("question_id", "context", "error")


@register("topk_nonfinite", f"""
WITH {STORE_SQL},
pairs AS (
  SELECT q.vec_id AS query_id, s.vec_id,
         list_sum(list_transform(list_zip(q.embedding, s.embedding),
                  lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS dist
  FROM embeddings q CROSS JOIN store s WHERE s.vec_id % 5 > 1)
SELECT query_id, rank, vec_id, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM pairs) WHERE rank <= 5
""")
def topk_nonfinite(spark, sf_dir):
    """A store with NaN and infinite vectors: they are left out, the others
    are all found."""
    e = v.table(spark, sf_dir, "embeddings")
    odd = F.when(F.col("vec_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    spoilt = F.transform("embedding", lambda x, i: F.when(i == 3, odd).otherwise(x.cast("double")))
    store = e.select("vec_id", F.when(F.col("vec_id") % 5 <= 1, spoilt).otherwise(
        F.col("embedding").cast("array<double>")).alias("embedding"))
    res = top_k(v.embedding_queries(spark, sf_dir), store, 5, query_key=["query_id"], vector_key=["vec_id"],
                nonfinite="skip")
    return res.withColumn("rank", F.col("rank").cast("bigint"))


@register("store_groups", f"""
WITH {STORE_SQL} SELECT DISTINCT agent_name, model_name, model_spec FROM store
""")
def store_groups_q(spark, sf_dir):
    from ..operators.vectors import store_groups

    return store_groups(v.embedding_store(spark, sf_dir))


@register("summaries_with_assistant", """
SELECT s.name AS agent_name, 'p' || d.doc_id AS id, 'reader' AS agent_link, 'reader' AS linked_class,
       replace(d.text, chr(10), CASE s.name WHEN 'quality-0' THEN ' ' ELSE ' | ' END) AS summary_text
FROM documents d CROSS JOIN (SELECT DISTINCT 'quality-' || quality AS name FROM labels WHERE quality IS NOT NULL) s
""")
def summaries_with_assistant(spark, sf_dir):
    """Each summary row with the assistant its summarizer links to (J12)."""
    from ..sources.agents import agent_links

    links = agent_links(v.agents(spark, sf_dir)).select("agent_name", "agent_link", "linked_class")
    out = tf.apply_agents(v.papers(spark, sf_dir), v.agents(spark, sf_dir), v.summarizer_fn, "abstract", ["id"])
    # The catalogue is small (its agents are functions of the driver).
    return out.join(F.broadcast(links), "agent_name").select(
        "agent_name", "id", "agent_link", "linked_class", "summary_text")


@register("retrieve_agent_dedupe", f"""
WITH {STORE_SQL},
pairs AS (
  SELECT q.vec_id AS question_id, s.agent_name, s.model_name, s.model_spec, s.arxiv_id, s.label,
         list_sum(list_transform(list_zip(q.embedding, s.embedding),
                  lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS dist
  FROM embeddings q CROSS JOIN store s WHERE s.agent_name = 'A1'),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY question_id, arxiv_id
           ORDER BY dist, agent_name, model_name, model_spec, arxiv_id, label) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id
             ORDER BY dist, agent_name, model_name, model_spec, arxiv_id, label) AS rank
           FROM best QUALIFY rank <= 5)
SELECT r.question_id, r.rank::BIGINT AS rank, r.arxiv_id, r.dist,
       'Document ' || d.doc_id || ' (' || d.lang || ', ' || d.source || ')' AS title
FROM ranked r JOIN documents d ON r.arxiv_id = 'p' || d.doc_id
""")
def retrieve_agent_dedupe(spark, sf_dir):
    """Retrieval over one agent's vectors, k distinct papers per question,
    each by its nearest vector (the rank is kept)."""
    qs = v.embedding_queries(spark, sf_dir).withColumnRenamed("query_id", "question_id")
    hits = ctx.retrieve(qs, v.embedding_store(spark, sf_dir), v.papers_of(spark, sf_dir), k=5,
                        question_key=["question_id"], agent_name="A1", dedupe_papers=True,
                        paper_fields=("title",))
    return hits.select("question_id", F.col("rank").cast("bigint").alias("rank"), "arxiv_id", "dist", "title")


@register("vector_upsert", f"""
WITH {TOKENS_SQL},
grid AS (SELECT d.doc_id, g.b FROM documents d CROSS JOIN range(64) g(b)),
text_vec AS (SELECT g.doc_id, string_agg(coalesce(v.n, 0)::BIGINT::VARCHAR, ',' ORDER BY g.b) AS vec_text
             FROM grid g LEFT JOIN doc_vec v ON v.doc_id = g.doc_id AND v.b = g.b GROUP BY g.doc_id),
tag_tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(source || ' ' || lang), '[^\\p{{L}}\\p{{N}}]+')) AS w
            FROM documents),
tag_bkt AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n
            FROM tag_tok WHERE w <> '' GROUP BY ALL),
tag_vec AS (SELECT g.doc_id, string_agg(coalesce(v.n, 0)::BIGINT::VARCHAR, ',' ORDER BY g.b) AS vec_text
            FROM grid g LEFT JOIN tag_bkt v ON v.doc_id = g.doc_id AND v.b = g.b GROUP BY g.doc_id)
SELECT 'A0' AS agent_name, 'p' || t.doc_id AS arxiv_id,
       CASE WHEN l.doc_id IS NULL THEN t.vec_text ELSE g.vec_text END AS vec_text
FROM text_vec t JOIN tag_vec g USING (doc_id) LEFT JOIN labels l USING (doc_id)
""")
def vector_upsert(spark, sf_dir):
    """Store the vectors of every document, then replace those of the
    papers in ``labels`` with vectors of their source and language tags."""
    path = fresh_path(spark, "vectors-upsert")
    docs = v.document_texts(spark, sf_dir)
    upsert(v.document_store(spark, sf_dir), path, list(VECTOR_KEY), VECTOR_PARTITIONS, VECTOR_SCHEMA)
    d = v.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("arxiv_id"),
        F.concat(F.col("source"), F.lit(" "), F.col("lang")).alias("tags"))
    tagged = (docs.join(_label_ids(spark, sf_dir).select("arxiv_id"), "arxiv_id", "left_semi")
              .join(d, "arxiv_id").drop("text"))
    upsert(hash_embed(tagged, list(VECTOR_KEY), "tags"), path, list(VECTOR_KEY), VECTOR_PARTITIONS,
           VECTOR_SCHEMA)
    return read_table(spark, path, VECTOR_SCHEMA).select("agent_name", "arxiv_id", _vec_text().alias("vec_text"))


@register("corpus_incremental", """
WITH sel AS (
  SELECT doc_id, text,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id % 50) * 3600 + (doc_id % 3 + 1) * 60) AS created
  FROM documents WHERE contains(source, 'src1'))
SELECT s.name AS summarizer_name, 'p' || sel.doc_id AS arxiv_id,
       replace(text, chr(10), CASE s.name WHEN 'quality-0' THEN ' ' ELSE ' | ' END) AS summary_text,
       sel.created BETWEEN TIMESTAMP '2024-01-01 10:00:00' AND TIMESTAMP '2024-01-01 20:02:00' AS cached
FROM sel CROSS JOIN (SELECT DISTINCT 'quality-' || quality AS name FROM labels WHERE quality IS NOT NULL) s
WHERE sel.created BETWEEN TIMESTAMP '2024-01-01 05:00:00' AND TIMESTAMP '2024-01-02 00:00:00'
""")
def corpus_incremental(spark, sf_dir):
    """Build for 10:00-20:02, then rebuild for 05:00-24:00 into the same
    tables: the second build reuses the first one's summaries (``cached``)
    and summarises only the papers new to the wider window."""
    import datetime as dt

    from .catalog import RANGE
    from .corpus import CorpusPaths, build_corpus

    paths = CorpusPaths(*(fresh_path(spark, n) for n in ("index", "summaries", "vectors", "snapshot")))
    common = (v.agents(spark, sf_dir), v.summarizer_fn, (v.MODEL_NAME, v.MODEL_SPEC), ("hash", "64"))
    lines = v.paper_files(spark, sf_dir)
    build_corpus(spark, lines, paths, "src1", RANGE, *common, embed_partitions=v.cores(spark, sf_dir))
    wider = [dt.datetime(2024, 1, 1, 5, 0, 0), dt.datetime(2024, 1, 2, 0, 0, 0)]
    second = build_corpus(spark, lines, paths, "src1", wider, *common, embed_partitions=v.cores(spark, sf_dir))
    return second.summaries.select("summarizer_name", "arxiv_id", "summary_text", "cached")


@register("topk_one", RETRIEVE_SQL + """,
all_q AS (SELECT b, sum(n) AS n FROM q_vec GROUP BY b),
all_qn AS (SELECT coalesce(sum(n * n), 0) AS nn FROM all_q),
one_dots AS (SELECT d.doc_id, sum(q.n * d.n) AS dot FROM all_q q JOIN doc_vec d USING (b) GROUP BY d.doc_id),
one AS (SELECT 'p' || dn.doc_id AS arxiv_id, all_qn.nn + dn.nn - 2 * coalesce(one_dots.dot, 0) AS dist
        FROM dn CROSS JOIN all_qn LEFT JOIN one_dots USING (doc_id))
SELECT row_number() OVER (ORDER BY dist, arxiv_id)::BIGINT AS rank, arxiv_id, dist
FROM one QUALIFY rank <= 5
""")
def topk_one(spark, sf_dir):
    """One query: all benchmark questions taken together (the sum of their
    token-count vectors), against every document vector."""
    qs = v.questions(spark, sf_dir)
    summed = (qs.select(F.posexplode("embedding").alias("i", "x"))
              .groupBy("i").agg(F.sum("x").alias("x"))
              .agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("_e"))
              .select(F.lit(0).cast("bigint").alias("question_id"),
                      F.transform("_e", lambda e: e["x"]).alias("embedding")))
    hits = top_k(summed, v.document_store(spark, sf_dir), 5, ["question_id"], list(VECTOR_KEY))
    return hits.select(F.col("rank").cast("bigint").alias("rank"), "arxiv_id", "dist")
