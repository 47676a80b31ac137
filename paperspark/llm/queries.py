"""Registered queries of the training-text operators, with their oracles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperspark.llm import (
    bpe, chat, decontaminate, html_text, jaccard_join, language_model, oracles, passage_dedup, piece_bpe,
    quality_model, quality_rules, repair, token_counts, vector_codes,
)
from paperspark.llm.common import table


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, and whether they pass 2048."""
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and maximum-entropy score of every document."""
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the robust-outlier verdict for every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and texts."""
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that earlier documents hold too."""
    return passage_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with benchmark items."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with near-equal shingle sets."""
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and read turns and loss text back."""
    planted = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = chat.read_chat(chat.format_chat(rows.unionByName(planted)))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    lines = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        lines.alias("lines"), loss.alias("loss"),
    ).select(
        "conv_id", "n_turns", F.sha2(F.col("lines").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by pieces; digests of ids and texts."""
    decoded = piece_bpe.decode(piece_bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every usable vector, beside its label's error."""
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digits = ",".join(str(x) for book in books for x in book.ravel().tolist())
    return vector_codes.with_label_error(codes).select(
        "vec_id", "code", "error", "label_error",
        F.lit(hashlib.sha256(digits.encode()).hexdigest()).alias("codebooks_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage every conversation and find its cheapest repair."""
    return repair.repaired(repair.damage(table(spark, sf_dir, "conversations")))


_ESC = r"""regexp_replace({}, '([<\[])(\\*(?:/?s>|/?INST\]|/?ROLE\]|TURN\]))', '\1\\\2', 'g')"""

OP10_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
    length({_ESC.format('text')}) AS text_chars, length({_ESC.format('role')}) AS role_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN opens THEN 20 + role_chars ELSE 6 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_model": op1_quality_model,
    "op2_token_counts": op2_token_counts,
    "op3_language_model": op3_language_model,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_text": op5_html_text,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_passage_dedup": op7_passage_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_chat_format": op10_chat_format,
    "op11_piece_codec": op11_piece_codec,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op4_quality_rules": oracles.RULES_SQL,
    "op9_jaccard_join": oracles.JACCARD_SQL,
    "op8_decontaminate": decontaminate.OVERLAPS_SQL,
    "op10_chat_format": OP10_SQL,
    "op12_vector_codes": oracles.CODES_SQL,
    "op13_conversation_repair": oracles.REPAIR_SQL,
}
