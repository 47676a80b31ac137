"""Term postings per block of documents, and sums of term weights by document.

A block is a run of documents of one input partition. For every distinct term
of a block there is one row with the frequencies of the term in the block's
documents, so a join on the term moves a frequent term once per block rather
than once per document. After the join, frequency x weight is summed by
document: first within each task, then per block.

The input's partitions must hold the same rows in the same order each time
they are computed, as those of a Parquet scan do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A block ends at so many characters or documents.
BLOCK_CHARS = 32 << 20
BLOCK_DOCS = 1 << 16
# Entries held by a task before its sums are reduced, and sent on.
BUFFER_ENTRIES = 1 << 20

ENTRY = np.dtype([("gap", "<u2"), ("n", "u1")])


class Terms:
    """The terms of one block. ``add`` takes a text and returns the numbers
    of its pieces; ``finish`` lists the terms of every piece."""

    def add(self, text: str | None) -> np.ndarray:
        raise NotImplementedError

    def posted(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        """The pieces of every text that postings are made of (after
        ``finish``)."""
        return pieces

    def finish(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Terms; for each piece the end of its part of the third array,
        which holds term numbers."""
        raise NotImplementedError


def reduced(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``value`` rows by equal ``key``, keys ascending."""
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(value[order], first, axis=0)


def block_frequencies(terms: Terms, pieces: list[np.ndarray]):
    """Sorted (term, document, count) of a block, and its terms."""
    names, ends, numbers = terms.finish()
    pieces = terms.posted(pieces)
    n_docs = max(1, len(pieces))
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    piece = np.concatenate(pieces).astype(np.int64) if pieces else np.zeros(0, np.int64)
    key, n = np.unique(piece * n_docs + np.repeat(np.arange(len(pieces)), lens), return_counts=True)
    piece, doc = key // n_docs, key % n_docs
    if ends is not None:
        begins = np.concatenate(([0], ends[:-1]))
        many = ends[piece] - begins[piece]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begins[piece], many)
        key, n = reduced(numbers[at] * n_docs + np.repeat(doc, many), np.repeat(n, many))
        piece, doc = key // n_docs, key % n_docs
    return names, piece, doc, n


def packed(term: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Term numbers present, and their entries as binary rows. A count above
    255 becomes several entries of the same document."""
    extra = (n - 1) // 255
    if extra.any():
        term, doc = np.repeat(term, extra + 1), np.repeat(doc, extra + 1)
        last = np.cumsum(extra + 1) - 1
        full = np.full(len(term), 255, np.int64)
        full[last] = n - 255 * extra
        n = full
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
    gap = np.diff(doc, prepend=0)
    gap[starts] = doc[starts]
    entries = np.empty(len(term), ENTRY)
    entries["gap"], entries["n"] = gap, n
    ends = np.append(starts, len(term)).astype(np.int32) * ENTRY.itemsize
    rows = pa.Array.from_buffers(pa.binary(), len(starts), [
        None, pa.py_buffer(ends.tobytes()), pa.py_buffer(entries.tobytes())])
    return term[starts], rows


def blocks(docs: DataFrame, make: Callable[[], Terms], only_terms: bool = False,
           id_col: str = "doc_id", text_col: str = "text", keep: str | None = None,
           facts: list[str] = []) -> DataFrame:
    """``term, block, entries, ids, n_bytes, facts``: the postings of every
    block, and one row per block with its ids, text sizes and, if named, the
    ``facts`` that ``Terms`` gathers for each text, under a term that no text
    holds. ``only_terms``: just the distinct terms of every block
    and their counts over the documents that the boolean column ``keep``
    names (all without one)."""
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 16

        def flush(terms, ids, sizes, kept, pieces):
            if only_terms:
                names, ends, numbers = terms.finish()
                lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
                count = np.bincount(np.concatenate(pieces), np.repeat(np.array(kept, float), lens),
                                    minlength=len(names) if ends is None else len(ends))
                if ends is not None:
                    count = np.bincount(numbers, np.repeat(count, np.diff(ends, prepend=0)), minlength=len(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(count.astype(np.int64))], names=["term", "n"])
                return
            names, term, doc, n = block_frequencies(terms, pieces)
            present, entries = packed(term, doc, n)
            m = len(present)
            for a in range(0, m, 20_000):
                b = min(m, a + 20_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[i] for i in present[a:b]], pa.string()),
                    pa.array(np.full(b - a, block), pa.int64()), entries.slice(a, b - a),
                    pa.nulls(b - a, pa.list_(id_type)), pa.nulls(b - a, pa.list_(pa.int64())),
                    pa.nulls(b - a, pa.binary())],
                    names=["term", "block", "entries", "ids", "n_bytes", "facts"])
            yield pa.RecordBatch.from_arrays([
                pa.array([f"\0{block}"]), pa.array([block], pa.int64()), pa.array([b""], pa.binary()),
                pa.array([ids], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([np.array(terms.facts if facts else [], float).tobytes()], pa.binary())],
                names=["term", "block", "entries", "ids", "n_bytes", "facts"])

        state, chars = (make(), [], [], [], []), 0
        for batch in batches:
            kept = batch.column(2).to_pylist()
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                terms, ids, sizes, marks, pieces = state
                ids.append(doc_id)
                sizes.append(len(text.encode()) if text else 0)
                marks.append(bool(kept[i]))
                pieces.append(terms.add(text))
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield from flush(*state)
                    block, state, chars = block + 1, (make(), [], [], [], []), 0
        if state[1]:
            yield from flush(*state)

    name = kind.simpleString()
    schema = "term string, n bigint" if only_terms else (
        f"term string, block bigint, entries binary, ids array<{name}>, n_bytes array<bigint>, facts binary")
    mark = F.col(keep) if keep else F.lit(True)
    return docs.select(F.col(id_col), F.col(text_col), mark.alias("kept")).mapInArrow(run, schema)


def sums_by_document(postings: DataFrame, weights: DataFrame, names: list[str],
                     facts: list[str] = []) -> DataFrame:
    """``doc_id, n_bytes``, the facts and, for each weight column of ``weights`` (keyed
    by ``term``), the sum of frequency x weight. Every input row gives one
    row; a term without a weight is an error.

    The join is Spark's own, so a hot term is split by adaptive execution;
    its rows are as many as the blocks that hold it. The weights of a
    partition's terms are hashed, which spares sorting postings by term.
    """
    k = len(names)
    kind = postings.schema["ids"].dataType.elementType.simpleString()
    joined = postings.join(weights.withColumn("known", F.lit(True)).hint("shuffle_hash"), "term", "left").select(
        "block", "entries", "ids", "n_bytes", "facts",
        (F.col("known").isNull() & F.col("ids").isNull()).alias("missing"),
        *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"w{i}") for i, n in enumerate(names)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held, ids_type = [], [], 0, None

        def send(key, value):
            block = key >> 16
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            ends = np.append(starts[1:], len(key))
            return pa.RecordBatch.from_arrays([
                pa.array(block[starts], pa.int64()),
                pa.array([(key[a:b] & 0xFFFF).astype("<u2").tobytes() for a, b in zip(starts, ends)], pa.binary()),
                pa.array([value[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                pa.nulls(len(starts), ids_type),
                pa.nulls(len(starts), pa.list_(pa.int64())), pa.nulls(len(starts), pa.binary())],
                names=["block", "docs", "sums", "ids", "n_bytes", "facts"])

        for batch in batches:
            ids_type = batch.schema.field("ids").type
            if any(batch.column(5).to_pylist()):
                raise RuntimeError("a term has no weight")
            ids = batch.column(2)
            if ids.null_count < len(ids):
                own = batch.filter(ids.is_valid())
                yield pa.RecordBatch.from_arrays([
                    own.column(0), pa.array([b""] * len(own), pa.binary()), pa.array([b""] * len(own), pa.binary()),
                    own.column(2), own.column(3), own.column(4)],
                    names=["block", "docs", "sums", "ids", "n_bytes", "facts"])
            data = batch.column(1).to_pylist()
            lens = np.fromiter(map(len, data), np.int64, len(data)) // ENTRY.itemsize
            entries = np.frombuffer(b"".join(data), ENTRY)
            if not len(entries):
                continue
            gap = np.cumsum(entries["gap"], dtype=np.int64)
            starts = np.cumsum(lens) - lens
            full = lens > 0
            base = np.zeros(len(lens), np.int64)
            base[full] = gap[starts[full]] - entries["gap"][starts[full]]
            doc = gap - np.repeat(base, lens)
            block = np.repeat(batch.column(0).to_numpy(), lens)
            n = entries["n"].astype(np.float64)
            weight = np.stack([np.repeat(batch.column(6 + i).to_numpy(), lens) * n for i in range(k)], axis=1)
            keys.append(block << 16 | doc)
            values.append(weight)
            held += len(doc)
            if held >= BUFFER_ENTRIES:
                key, value = reduced(np.concatenate(keys), np.concatenate(values))
                keys, values, held = [key], [value], len(key)
                if held >= BUFFER_ENTRIES // 2:
                    yield send(key, value)
                    keys, values, held = [], [], 0
        if held:
            yield send(*reduced(np.concatenate(keys), np.concatenate(values)))

    partials = joined.mapInArrow(
        partial, f"block bigint, docs binary, sums binary, ids array<{kind}>, n_bytes array<bigint>, facts binary")

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, known = [], [], b""
        for own, size, fact in zip(rows["ids"], rows["n_bytes"], rows["facts"]):
            if own is not None:
                ids, sizes, known = list(own), list(size), fact
        known = np.frombuffer(known).reshape(len(ids), len(facts))
        sums = np.zeros((len(ids), k))
        for docs, values in zip(rows["docs"], rows["sums"]):
            if docs:
                sums[np.frombuffer(docs, "<u2")] += np.frombuffer(values).reshape(-1, k)
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "n_bytes": sizes,
                             **{n: known[:, i] for i, n in enumerate(facts)},
                             **{n: sums[:, i] for i, n in enumerate(names)}})

    cols = ", ".join(f"`{n}` double" for n in [*facts, *names])
    return partials.groupBy("block").applyInPandas(total, f"doc_id {kind}, n_bytes bigint, {cols}")
