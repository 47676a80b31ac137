"""Schemas, key column lists and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values (must equal the reference's for the same results) -------
# Metadata fields a paper record may be asked for, in the snapshot's order.
METADATA_FIELDS = [
    "id", "submitter", "authors", "title", "comments", "journal-ref", "doi",
    "report-no", "categories", "license", "abstract", "versions",
    "update_date", "authors_parsed",
]
# Version timestamps look like "Mon, 2 Apr 2007 19:18:42 GMT"
# (strptime pattern "%a, %d %b %Y %H:%M:%S %Z"); see functions/dates.py.
# Longest text accepted by the embedder, in characters.
MAX_TEXT_CHARS = 8192
# Texts per embedding request.
EMBED_BATCH_SIZE = 20
# Neighbours returned by retrieval.
DEFAULT_TOP_K = 5
# Papers returned by a feed fetch.
DEFAULT_FEED_SIZE = 100
# Separator inside a composite cache key: agent:model:spec:paper:label.
KEY_SEPARATOR = ":"
# Label under which abstract-derived vectors are stored.
ABSTRACT_LABEL = "abstract"
# Model providers accepted in a "name:spec" model string.
SUPPORTED_MODELS = ["openai"]
# ---------------------------------------------------------------------------

# Every metadata field read as text first, so that no value can be rejected
# for its type; versions and authors_parsed are decoded in a second step.
RAW_CORRUPT_COL = "_corrupt_record"
RAW_PAPER_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in METADATA_FIELDS]
    + [T.StructField(RAW_CORRUPT_COL, T.StringType())]
)
VERSIONS_TYPE = T.ArrayType(T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("created", T.StringType()),
]))
AUTHORS_PARSED_TYPE = T.ArrayType(T.ArrayType(T.StringType()))
FIELD_TYPES = {f: T.StringType() for f in METADATA_FIELDS}
FIELD_TYPES["versions"] = VERSIONS_TYPE
FIELD_TYPES["authors_parsed"] = AUTHORS_PARSED_TYPE

INDEX_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("created", T.TimestampNTZType()),
    T.StructField("id", T.StringType()),
])

SUMMARY_KEY = ["summarizer_name", "full_model_name", "arxiv_id"]
SUMMARY_PARTITIONS = ["summarizer_name", "full_model_name"]
SUMMARY_SCHEMA = T.StructType([
    T.StructField("summarizer_name", T.StringType()),
    T.StructField("full_model_name", T.StringType()),
    T.StructField("arxiv_id", T.StringType()),
    T.StructField("summary_text", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

VECTOR_KEY = ["agent_name", "model_name", "model_spec", "arxiv_id", "label"]
VECTOR_PARTITIONS = ["agent_name", "model_name", "model_spec"]
VECTOR_SCHEMA = T.StructType([
    T.StructField("agent_name", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_spec", T.StringType()),
    T.StructField("arxiv_id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
])

AGENT_SCHEMA = T.StructType([
    T.StructField("agent_class", T.StringType()),
    T.StructField("agent_name", T.StringType()),
    T.StructField("instructions", T.StringType()),
    T.StructField("agent_link", T.StringType()),
])

FEED_RAW_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    T.StructField("summary", T.StringType()),
    T.StructField("published", T.TimestampNTZType()),
    T.StructField("updated", T.TimestampNTZType()),
    T.StructField("pdf_url", T.StringType()),
    T.StructField("entry_id", T.StringType()),
])
