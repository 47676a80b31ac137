"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of adjacent bytes that occurs inside no vocabulary token can never be
joined by a merge, so it marks a certain cut. Each pre-token is cut there,
the fragments are encoded independently and their ids are concatenated,
which gives the same ids as encoding the pre-token whole.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from paperspark.llm.common import slices

# The published byte-level pre-token pattern.
PRE_TOKEN_RE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "byte_bpe_50k.json"
# Entries of each memo of a worker; a full one is emptied, and both are at the
# end of a task.
MEMO_ENTRIES = 400_000
SLICE_CHARS = 1 << 20
# Fragments longer than this are merged with a heap.
SHORT = 64


def tokenizer_path(name: str) -> str:
    """``name`` as a path, or a file of the installed vocabulary package."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The published printable stand-in of each byte, mapped back to it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCodec:
    """Vocabulary, merges and the forced-boundary table of one tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_alphabet()
        model = spec["model"]
        self.token_bytes = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items()}
        id_of = {t: i for i, t in self.token_bytes.items()}
        self.byte_ids = [id_of[bytes([b])] for b in range(256)]
        self.ranks, self.made = {}, []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = (bytes(byte_of[c] for c in x) for x in (left, right))
            self.ranks.setdefault((id_of[a], id_of[b]), rank)
            self.made.append(id_of[a + b])
        self.joined = bytearray(1 << 16)
        for t in id_of:
            for x, y in zip(t, t[1:]):
                self.joined[x << 8 | y] = 1
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self.special_re = regex.compile(
            "(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(PRE_TOKEN_RE).findall
        self.runs_of_space = regex.compile(r"\s[ ]|[ ]\s|^\s|\s$").search
        self.memo: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def cut(self, data: bytes) -> list[bytes]:
        """``data`` cut wherever no token can span two adjacent bytes."""
        joined = self.joined
        cuts = [k for k, (a, b) in enumerate(zip(data, data[1:]), 1) if not joined[a << 8 | b]]
        if not cuts:
            return [data]
        return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]

    def merge_short(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        get, none, made = self.ranks.get, len(self.made), self.made
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            k = pairs.index(best)
            ids[k:k + 2] = [made[best]]
            del pairs[k]
            if k:
                pairs[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(pairs):
                pairs[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges over a linked list with a heap of ranks."""
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(k: int) -> None:
            j = after[k]
            if j < n and (rank := ranks.get((ids[k], ids[j]))) is not None:
                heapq.heappush(heap, (rank, k, ids[k], ids[j]))

        for k in range(n - 1):
            push(k)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = self.made[rank], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            push(k)
            if before[k] >= 0:
                push(before[k])
        return [i for i in ids if i >= 0]

    def encode_fragment(self, data: bytes) -> bytes:
        ids = [self.byte_ids[b] for b in data]
        ids = self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids)
        return array("I", ids).tobytes()

    def encode_pre_token(self, token: str) -> bytes:
        return b"".join(map(self.encode_fragment, self.cut(token.encode())))

    def encode_pre_tokens(self, text: str) -> bytes:
        memo, out = self.memo, []
        for token in self.find(text):
            ids = memo.get(token)
            if ids is None:
                ids = self.encode_pre_token(token)
                if len(token) <= SHORT:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[token] = ids
            out.append(ids)
        return b"".join(out)

    def encode_plain(self, text: str) -> bytes:
        """A pre-token always ends where white space follows a character that
        is none, so where all spaces stand alone, the parts between them can
        be pre-tokenised, and remembered, one by one."""
        if not text or self.runs_of_space(text):
            return self.encode_pre_tokens(text)
        spaced, parts = self.spaced, text.split(" ")
        out = [self.encode_pre_tokens(parts[0])]
        for part in parts[1:]:
            ids = spaced.get(part)
            if ids is None:
                ids = self.encode_pre_tokens(" " + part)
                if len(part) <= SHORT:
                    if len(spaced) >= MEMO_ENTRIES:
                        spaced.clear()
                    spaced[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed little-endian unsigned 32-bit integers;
        special strings inside the text become their own ids."""
        if self.special_re is None or "<" not in text:
            return self.encode_plain(text)
        parts = self.special_re.split(text)
        return b"".join(
            self.special[p].to_bytes(4, "little") if k % 2 else self.encode_plain(p)
            for k, p in enumerate(parts))

    def forget(self) -> None:
        """Empty the memos and give back what batches took: a worker that
        waits for its next task, or decodes in it, holds the vocabulary only."""
        self.memo.clear()
        self.spaced.clear()
        pa.default_memory_pool().release_unused()

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that form no character become the
        replacement character, as in the library."""
        found = memoryview(ids).cast("I").tolist()
        return b"".join(map(self.token_bytes.__getitem__, found)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(name: str) -> BytePairCodec:
    return BytePairCodec(tokenizer_path(name))


def encode(docs: DataFrame, name: str = TOKENIZER, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Returns ``doc_id, ids, n_tokens``: the ids of each whole text (null:
    empty) as packed little-endian unsigned 32-bit integers. Every input row
    gives one row, repeated rows included; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(name)
        try:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in slices((len(t or "") for t in texts), SLICE_CHARS):
                    ids = [enc.encode(t or "") for t in texts[a:b]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()),
                         pa.array([len(x) // 4 for x in ids], pa.int64())],
                        names=["doc_id", "ids", "n_tokens"])
        finally:
            enc.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, ids binary, n_tokens bigint")


def decode(encoded: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """Returns ``doc_id, ids, n_tokens, decoded``, special tokens kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(name)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for a, b in slices((len(x or b"") for x in ids), 4 * SLICE_CHARS):
                texts = [enc.decode(x or b"") for x in ids[a:b]]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())],
                    names=["doc_id", "ids", "n_tokens", "decoded"])
        enc.forget()

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(
        run, f"doc_id {kind}, ids binary, n_tokens bigint, decoded string")
