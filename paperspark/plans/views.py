"""Views derived from the shared test tables, in the reference's data model.

``documents`` plays the paper corpus: each row becomes one NDJSON metadata
line (id ``p<doc_id>``, categories ``"<source> <lang>"``, the whole text as
the abstract, ``doc_id % 3 + 1`` versions whose last one was created at
2024-01-01 + ``doc_id % 50`` hours + (number of versions) minutes). The lines
then go through the real parser, so every query exercises it.
All derivations are Spark expressions over whole tables.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import format_version_date
from ..session import fresh_path
from ..sources.papers import POS

BASE_TIME = "2024-01-01 00:00:00"
LINES_PER_FILE = 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pos(part: int, row) -> F.Column:
    return F.struct(F.lit(f"part-{part}").alias("file"), F.lit(0).cast("bigint").alias("block"),
                    row.cast("bigint").alias("row"))


def paper_title(doc_id, lang, source) -> F.Column:
    return F.concat(F.lit("Document "), doc_id.cast("string"), F.lit(" ("), lang, F.lit(", "),
                    source, F.lit(")"))


def version_time(doc_id, i) -> F.Column:
    base = F.lit(BASE_TIME).cast("timestamp_ntz")
    return base + F.make_dt_interval(F.lit(0), (doc_id % 50).cast("int"), i.cast("int"), F.lit(0))


def paper_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed paper rows as a metadata snapshot would hold them."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    versions = F.transform(
        F.sequence(F.lit(1), (doc % 3 + 1).cast("int")),
        lambda i: F.struct(F.concat(F.lit("v"), i.cast("string")).alias("version"),
                           format_version_date(version_time(doc, i)).alias("created")))
    return d.select(
        doc,
        F.concat(F.lit("p"), doc.cast("string")).alias("id"),
        paper_title(doc, F.col("lang"), F.col("source")).alias("title"),
        F.concat(F.col("source"), F.lit(" "), F.col("lang")).alias("categories"),
        F.col("text").alias("abstract"),
        versions.alias("versions"),
    )


def paper_lines(spark: SparkSession, sf_dir: str, bad_lines: bool = False,
                later_duplicates: bool = False) -> DataFrame:
    """NDJSON lines ``(value, _pos)`` for the paper corpus.

    ``bad_lines`` adds every ``benchmark`` text as a raw (non-JSON) line.
    ``later_duplicates`` adds, after all originals, one line per ``labels``
    row repeating that paper's id with a new title, so the later line must win.
    """
    recs = paper_records(spark, sf_dir)
    rec = F.struct("id", "title", "categories", "abstract", "versions")
    out = recs.select(F.to_json(rec).alias("value"), _pos(0, F.col("doc_id")).alias(POS))
    if later_duplicates:
        labels = table(spark, sf_dir, "labels")
        dup = (recs.join(labels, "doc_id")
               .withColumn("title", F.concat(F.lit("Relabelled: quality="), F.col("quality").cast("string"),
                                             F.lit(" toxic="), F.col("toxic").cast("string"))))
        out = out.unionByName(dup.select(F.to_json(rec).alias("value"), _pos(1, F.col("doc_id")).alias(POS)))
    if bad_lines:
        bench = table(spark, sf_dir, "benchmark")
        out = out.unionByName(bench.select(F.col("text").alias("value"),
                                           _pos(2, F.col("item_id")).alias(POS)))
    return out


def event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a second index: category = event_type, created = ts."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("category"), F.col("ts").alias("created"),
                    F.col("event_id").cast("string").alias("id"))


# --- Agents, summarisers and vector stores used by the registered queries --

MODEL = "OpenAI:demo-model"
MODEL_NAME, MODEL_SPEC = "openai", "demo-model"
FULL_MODEL = f"{MODEL_NAME}:{MODEL_SPEC}"
def summarizer_fn(agent_name: str, instructions: str | None = None):
    """Deterministic stand-ins for model calls; each reads the whole text."""
    separators = {"quality-0": " ", "quality-1": " | "}
    if agent_name not in separators:
        raise ValueError(f"no summariser for {agent_name}")
    mark = separators[agent_name]
    return lambda texts: [None if t is None else t.replace("\n", mark) for t in texts]


def earlier_summarizer_fn(texts):
    """The output of an earlier run, found in the cache."""
    return [None if t is None else t.replace("\n", "  ") for t in texts]


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summarizer for each quality that ``labels`` gives, and one reader
    that they link to."""
    from ..sources.agents import normalise_agents

    name = F.concat(F.lit("quality-"), F.col("quality").cast("string"))
    summarizers = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select(
        F.lit("Summarizer").alias("agent_class"), name.alias("agent_name"),
        F.concat(F.lit("For texts of quality "), F.col("quality").cast("string")).alias("instructions"),
        F.lit("reader").alias("agent_link"))
    reader = summarizers.agg(F.lit("Reader").alias("agent_class"), F.lit("reader").alias("agent_name"),
                             F.lit("Answers from the context").alias("instructions"),
                             F.min("agent_name").alias("agent_link"))
    return normalise_agents(summarizers.unionByName(reader))


_stores: dict = {}
_lock = threading.RLock()


def paper_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the paper corpus as packed NDJSON files, written once per
    session. A packed file is read by one task, so it holds few lines."""
    return _built(spark, sf_dir, "files", lambda path: paper_lines(spark, sf_dir).select("value").write
                  .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
                  .option("maxRecordsPerFile", LINES_PER_FILE).text(path))


def paper_store(spark: SparkSession, sf_dir: str) -> str:
    """The stored corpus (``sources.corpus_store``) of those files, built once
    per session."""
    from ..sources.corpus_store import refresh

    return _built(spark, sf_dir, "store", lambda path: refresh(spark, path, paper_files(spark, sf_dir)))


def _built(spark: SparkSession, sf_dir: str, what: str, build) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, what)
    with _lock:
        if key not in _stores:
            path = fresh_path(spark, f"corpus-{what}")
            build(path)
            _stores[key] = path
    return _stores[key]


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers (id, title, categories, abstract) of the stored corpus."""
    from ..sources.corpus_store import stored_papers

    return stored_papers(spark, paper_store(spark, sf_dir), ["title", "categories", "abstract"])


def papers_of(spark: SparkSession, sf_dir: str):
    """A function that gives the stored papers of some ids."""
    from ..sources.corpus_store import stored_papers

    path = paper_store(spark, sf_dir)
    return lambda ids: stored_papers(spark, path, ["title", "abstract"], ids)


def cores(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for array work on documents that come in one split; None, for no
    shuffle of their texts, if there is a split for every core."""
    want = spark.sparkContext.defaultParallelism
    splits = table(spark, sf_dir, "documents")._jdf.queryExecution().toRdd().getNumPartitions()
    return want if splits < want else None


def embedding_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a keyed vector store: three vectors per paper
    (abstract, title, summary) spread over two agents."""
    e = table(spark, sf_dir, "embeddings")
    vid = F.col("vec_id")
    return e.select(
        F.concat(F.lit("A"), (F.col("label") % 2).cast("string")).alias("agent_name"),
        F.lit(MODEL_NAME).alias("model_name"),
        F.lit("emb-64").alias("model_spec"),
        F.concat(F.lit("p"), F.floor(vid / 3).cast("string")).alias("arxiv_id"),
        F.when(vid % 3 == 0, "abstract").when(vid % 3 == 1, "title").otherwise("summary").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def embedding_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def document_texts(spark: SparkSession, sf_dir: str, agent: str = "A0") -> DataFrame:
    """Documents keyed like stored vectors (label ``abstract``)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit(agent).alias("agent_name"), F.lit("hash").alias("model_name"),
                    F.lit("64").alias("model_spec"),
                    F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("arxiv_id"),
                    F.lit("abstract").alias("label"), F.col("text"))


def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-hash vectors of every whole document."""
    from ..functions.embed import hash_embed
    from ..schemas import VECTOR_KEY

    return hash_embed(document_texts(spark, sf_dir), list(VECTOR_KEY), "text", partitions=cores(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` items as questions with feature-hash vectors."""
    from ..functions.embed import hash_embed

    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"),
                                                  F.col("text").alias("question"))
    return hash_embed(b, ["question_id", "question"], "question")


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API feed records as fetched: padded titles, multi-line summaries."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    base = F.lit(BASE_TIME).cast("timestamp_ntz")
    published = base + F.make_dt_interval(F.lit(0), F.lit(0), doc.cast("int"), F.lit(0))
    return d.select(
        F.concat(F.lit("  Document "), doc.cast("string"), F.lit(" \n")).alias("title"),
        F.array(F.struct(F.concat(F.lit("Author of "), F.col("source")).alias("name")),
                F.struct(F.concat(F.lit("Editor "), F.col("lang")).alias("name"))).alias("authors"),
        F.col("text").alias("summary"),
        published.alias("published"),
        (published + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("n_chars").cast("decimal(18,6)"))).alias("updated"),
        F.concat(F.lit("https://papers.example/pdf/p"), doc.cast("string")).alias("pdf_url"),
        F.concat(F.lit("https://papers.example/abs/p"), doc.cast("string")).alias("entry_id"),
    )


def index_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper lines plus records the index must quarantine: every
    ``benchmark`` item as a record with empty categories, every
    ``conversations`` turn as a record whose version time is not a date."""
    rec = F.struct("id", "categories", "versions")
    bench = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.lit("").alias("categories"),
        F.array(F.struct(F.lit("v1").alias("version"),
                         F.lit("Mon, 1 Jan 2024 00:00:00 GMT").alias("created"))).alias("versions"),
        F.col("item_id").alias("_n"))
    conv = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.col("role").alias("categories"),
        F.array(F.struct(F.lit("v1").alias("version"),
                         F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("created"))).alias("versions"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("_n"))
    return (paper_lines(spark, sf_dir)
            .unionByName(bench.select(F.to_json(rec).alias("value"), _pos(3, F.col("_n")).alias(POS)))
            .unionByName(conv.select(F.to_json(rec).alias("value"), _pos(4, F.col("_n")).alias(POS))))
