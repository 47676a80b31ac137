"""SentencePiece BPE encoding by backtracking, and decoding.

A sequence of tokens is the encoding of a text exactly if every two adjacent
tokens, merged again from their characters, come out as those two tokens. So
the encoder needs no merges over the text: an Aho-Corasick pass gives the
longest token that starts at each position; tokens are laid from the left,
the longest first; one that does not agree with the token before it, or that
ends where no encoding goes on, is replaced by its next shorter prefix; when
none is left, the position is marked in a bitfield of failed positions and the
token before it is taken back. No position fails twice, so the work is linear
in the text's length.
"""

from __future__ import annotations

import codecs
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from paperspark.llm.bpe import tokenizer_path
from paperspark.llm.common import slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Entries of each memo of a worker; a full one is emptied.
MEMO_ENTRIES = 400_000
# Longer chunks are encoded but not remembered.
MEMO_CHARS = 64
SLICE_CHARS = 1 << 20
# Chunks that may be encoded apart, the finest first: words and other
# characters, each with the spaces before; the same, not told apart; all.
CHUNK_RES = (
    rf"{SPACE}*[\p{{L}}\p{{M}}]+|{SPACE}*[^\p{{L}}\p{{M}}{SPACE}\n]+|{SPACE}+|\n+",
    rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+",
    r"(?s).+",
)

# Fixed values of the model file's format: fields and enumerations.
PIECE_FIELD, TRAINER_FIELD, NORMALIZER_FIELD = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MODEL_TYPE_FIELD, BPE_TYPE, BYTE_FALLBACK_FIELD = 3, 2, 35
CHARSMAP_FIELD, DUMMY_PREFIX_FIELD, EXTRA_SPACES_FIELD, ESCAPE_FIELD = 2, 3, 4, 5


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at:at + size]
        at += size


def lone_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """Every byte that belongs to no character is one replacement character."""
    return "�", error.start + 1


codecs.register_error("piece_bytes", lone_byte)


class PieceCodec:
    """Vocabulary, automaton and memos of one model. Supported are BPE models
    with byte fallback that leave characters as they are; others raise."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        pieces, trainer, rules = [], {}, {}
        for field, value in fields(data):
            if field == PIECE_FIELD:
                got = dict(fields(value))
                pieces.append((got[1].decode(), struct.unpack("<f", got.get(2, bytes(4)))[0], got.get(3, NORMAL)))
            elif field == TRAINER_FIELD:
                trainer = dict(fields(value))
            elif field == NORMALIZER_FIELD:
                rules = dict(fields(value))
        if (trainer.get(MODEL_TYPE_FIELD) != BPE_TYPE or not trainer.get(BYTE_FALLBACK_FIELD)
                or rules.get(CHARSMAP_FIELD) or rules.get(EXTRA_SPACES_FIELD, 1) or not rules.get(ESCAPE_FIELD, 1)
                or any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in pieces)):
            raise ValueError(f"{path}: only BPE models with byte fallback and no normalisation are supported")
        self.prefix = SPACE if rules.get(DUMMY_PREFIX_FIELD, 1) else ""
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        names = {p: i for i, (p, _, kind) in enumerate(pieces)}
        self.begin, self.end = names["<s>"], names["</s>"]
        self.byte_ids = [names[f"<0x{b:02X}>"] for b in range(256)]
        # Equal scores share a rank; of equal ranks the leftmost pair merges first.
        order = {s: r for r, s in enumerate(sorted({pieces[i][1] for i in self.id_of.values()}, reverse=True))}
        self.rank = {p: order[pieces[i][1]] for p, i in self.id_of.items()}
        self.no_rank = len(order)
        # What each id stands for in a decoded text.
        self.bytes_of = [
            b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN
            else bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode()
            for p, _, kind in pieces]
        self.spaced = {i for p, i in self.id_of.items() if p[0] == SPACE}
        # Tokens that merging their own characters gives back; no other piece
        # can come out of any text.
        self.agreed: dict[tuple[str, str], bool] = {}
        made = [p for p in self.id_of if len(p) == 1 or self.merged(list(p)) == [p]]
        self.shorter: dict[str, str] = {}
        known = set(made)
        for p in made:
            k = next((k for k in range(len(p) - 1, 1, -1) if p[:k] in known), 1)
            if k < len(p):
                self.shorter[p] = p[:k]
        # Single characters need no search.
        self.tokens = ahocorasick.Automaton()
        for p in made:
            if len(p) > 1:
                self.tokens.add_word(p, (len(p) - 1, p))
        self.tokens.make_automaton()
        # Each pattern cuts between certain kinds of neighbours. Where it
        # leaves all pieces whole, no token can span one of its cuts.
        inner = [p for p in self.id_of if len(p) > 1]
        finds = (regex.compile(p).findall for p in CHUNK_RES)
        self.chunks = next(f for f in finds if all(len(f(p)) == 1 for p in inner))
        self.memo: dict[str, bytes] = {}

    def merged(self, parts: list[str]) -> list[str]:
        """Merge the adjacent pair of lowest rank, the leftmost first, until
        no two adjacent parts form a piece."""
        get, none = self.rank.get, self.no_rank
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def agree(self, left: str, right: str) -> bool:
        """Whether the two tokens merge again to themselves."""
        if len(self.agreed) >= MEMO_ENTRIES:
            self.agreed.clear()
        fits = self.agreed[left, right] = self.merged([*left, *right]) == [left, right]
        return fits

    def split(self, text: str) -> list[str]:
        """The tokens of ``text``, characters without a piece among them."""
        longest = list(text)
        for last, (more, token) in self.tokens.iter(text):
            # Of tokens with one start the longer ones end later.
            longest[last - more] = token
        n = len(text)
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        agreed, agree, shorter = self.agreed, self.agree, self.shorter
        at, token = 0, longest[0]
        while True:
            end = at + len(token)
            if not failed[end >> 3] >> (end & 7) & 1:
                if out:
                    fits = agreed.get((out[-1], token))
                    if fits is None:
                        fits = agree(out[-1], token)
                else:
                    fits = True
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, token = end, longest[end]
                    continue
            less = shorter.get(token)
            while less is None:
                # Nothing goes on from here: go back by one token.
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= len(token)
                less = shorter.get(token)
            token = less

    def chunk_ids(self, chunk: str) -> bytes:
        ids: list[int] = []
        for token in self.split(chunk):
            i = self.id_of.get(token)
            if i is None:
                ids.extend(self.byte_ids[b] for b in token.encode())
            else:
                ids.append(i)
        return array("I", ids).tobytes()

    def encode(self, text: str, begin: bool = True, end: bool = True) -> bytes:
        """Ids of a text as packed little-endian unsigned 32-bit integers."""
        memo, out = self.memo, [self.begin.to_bytes(4, "little")] if begin else []
        if text:
            for chunk in self.chunks(self.prefix + text.replace(" ", SPACE)):
                ids = memo.get(chunk)
                if ids is None:
                    ids = self.chunk_ids(chunk)
                    if len(chunk) <= MEMO_CHARS:
                        if len(memo) >= MEMO_ENTRIES:
                            memo.clear()
                        memo[chunk] = ids
                out.append(ids)
        if end:
            out.append(self.end.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: control tokens are silent, and the space
        that encoding puts before a text is taken off."""
        found = memoryview(ids).cast("I").tolist()
        data = b"".join(map(self.bytes_of.__getitem__, found))
        if self.prefix and next((i for i in found if self.bytes_of[i]), None) in self.spaced:
            data = data[1:]
        return data.decode("utf-8", "piece_bytes")


@lru_cache(maxsize=4)
def codec(name: str) -> PieceCodec:
    return PieceCodec(tokenizer_path(name))


def encode(docs: DataFrame, name: str = MODEL, id_col: str = "doc_id", text_col: str = "text",
           begin: bool = True, end: bool = True) -> DataFrame:
    """Returns ``doc_id, ids, n_tokens``: the ids of each whole text as packed
    little-endian unsigned 32-bit integers, ``begin`` and ``end`` ids included.

    Every input row gives one row, rows with equal or null ids included; a
    null text is empty, and an empty text has only its begin and end ids. A
    text without any space is one chunk, encoded in time linear in its length.
    An empty table gives an empty table; other columns are ignored, whatever
    their names. Rows need nothing of each other, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(name)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices((len(t or "") for t in texts), SLICE_CHARS):
                ids = [enc.encode(t or "", begin, end) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()),
                     pa.array([len(x) // 4 for x in ids], pa.int64())],
                    names=["doc_id", "ids", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens bigint")


def decode(encoded: DataFrame, name: str = MODEL) -> DataFrame:
    """Returns ``doc_id, ids, n_tokens, decoded`` for rows of :func:`encode`;
    null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(name)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for a, b in slices((len(x or b"") for x in ids), 4 * SLICE_CHARS):
                texts = [enc.decode(x or b"") for x in ids[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(texts, pa.string())],
                    names=["doc_id", "ids", "n_tokens", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(
        run, f"doc_id {kind}, ids binary, n_tokens bigint, decoded string")
