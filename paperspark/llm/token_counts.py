"""Token counts without token ids.

The pieces of a pre-token are counted once per distinct pre-token; the counts
are joined to the pre-token frequencies of the documents and summed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperspark.llm.bpe import tokenizer_path
from paperspark.llm.common import staged
from paperspark.llm.postings import Terms, blocks, sums_by_document

TOKENIZER = "word_bpe_49k.json"
# str.split() also cuts at these, which are no white space to a tokenizer.
SEPARATORS = re.compile(r"[\x1c-\x1f]").search
ASCII_SPLIT = re.compile(r"[\x20\x09-\x0D]+").split
# The tokenizer's published pre-token pattern, as far as it
# concerns printable lower-case ASCII.
ASCII_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ASCII_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall


@lru_cache(maxsize=2)
def library(name: str):
    """The tokenizer, a pattern of its special strings (None: has none), these
    strings, and whether ASCII follows the pattern above."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name))
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    pattern = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    spec = json.loads(tok.to_str())
    plain = (ASCII_PATTERN in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
             and any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", [])))
    return tok, pattern, frozenset(special), plain


class Numbers(dict):
    """Numbers keys in the order they come."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class PreTokens(Terms):
    """Pre-tokens of white-space-separated pieces. No pre-token holds white
    space, and the normaliser changes no piece because of another."""

    def __init__(self, name: str):
        self.tok, self.special_re, _, self.plain = library(name)
        self.pieces = Numbers()

    def add(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        words = list(filter(None, ASCII_SPLIT(text))) if SEPARATORS(text) else text.split()
        return np.array(list(map(self.pieces.__getitem__, words)), np.int32)

    def split(self, piece: str) -> list[str]:
        if self.plain and "<" not in piece and piece.isascii() and piece.isprintable():
            return ASCII_TOKENS(piece.lower())
        parts = self.special_re.split(piece) if self.special_re and "<" in piece else [piece]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
            elif part:
                normal = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                out.extend(t for t, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal))
        return out

    def finish(self):
        terms, numbers, ends = Numbers(), [], []
        for piece in self.pieces:
            numbers.extend(map(terms.__getitem__, self.split(piece)))
            ends.append(len(numbers))
        return list(terms), np.array(ends, np.int64), np.array(numbers, np.int64)


def count_pieces(terms: DataFrame, name: str) -> DataFrame:
    """``term, pieces`` for every distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, _, special, _ = library(name)
        for batch in batches:
            found = batch.column(0).to_pylist()
            n = [1 if t in special else len(tok.model.tokenize(t)) for t in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["term", "pieces"])

    return terms.select("term").distinct().mapInArrow(run, "term string, pieces bigint")


def token_counts(docs: DataFrame, name: str = TOKENIZER, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row's whole text (null: empty),
    as the tokenizer counts without begin, end, truncation or padding;
    special strings inside a text count as one token each. Repeated rows stay
    repeated; other columns are ignored; an empty table gives no rows."""
    pieces = staged(count_pieces(blocks(
        docs, lambda: PreTokens(name), only_terms=True, id_col=id_col, text_col=text_col), name), "pieces")
    postings = blocks(docs, lambda: PreTokens(name), id_col=id_col, text_col=text_col)
    return sums_by_document(postings, pieces, ["pieces"]).select(
        "doc_id", "n_bytes", F.round("pieces").cast("long").alias("n_tokens"))
