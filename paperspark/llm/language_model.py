"""LM scoring with a hashed maximum-entropy model.

Words are factored into classes: the most frequent words fill the head
classes, all others share tail classes by their ending. P(class | history)
and, in a head class, P(word | class, history) are softmaxes over hashed
n-gram and skip features; in a tail class a word has its add-one share. The
model is a distribution over the known words and one unknown word per tail
class.

Training makes one pass over all training tokens, in rounds. Each round takes
its part of the documents, computes observed and expected feature counts (the
gradient is their difference) in every task, sums them over the cluster and
updates the weights by the scaled log ratio of the two.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperspark.llm.common import byte_words, staged, sum_vectors
from paperspark.llm.postings import Terms, blocks, sums_by_document
from paperspark.llm.token_counts import Numbers

END = b"\n"  # no word holds white space
HEAD_CLASSES, HEAD_SIZE, TAIL_CLASSES = 16, 64, 32
HEAD = HEAD_CLASSES * HEAD_SIZE
CLASSES = HEAD_CLASSES + TAIL_CLASSES
BEGIN = HEAD + TAIL_CLASSES  # symbol before a text
HISTORY = 3
SYMBOLS = BEGIN + 1
BUCKETS = 1 << 13  # at most 2^16
ROUNDS, STEP, PRIOR = 4, 0.35, 10.0
CHUNK = 1 << 12  # histories at a time
BLOCK = 1 << 19  # tokens whose histories are compared
PARTS = 64
MEMO_ENTRIES = 400_000
# A word that is one of so many tokens, or of fewer, is common: there are no more
# such words than this, and the model holds their scores.
COMMON = 1 << 18
LN10 = float(np.log(10.0))


def tail_class(word: bytes) -> int:
    """Words of one ending, punctuation aside, share a class."""
    return zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % TAIL_CLASSES


class Symbols(dict):
    """Word to symbol: its place in the head, or ``HEAD`` + tail class."""

    def __init__(self, head: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(head))
        self.head = head

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
            self.update((w, i) for i, w in enumerate(self.head))
        symbol = self[word] = HEAD + tail_class(word)
        return symbol


def tokens_of(text: str | None) -> list[bytes]:
    words = byte_words(text)
    words.append(END)
    return words


def hashed(k: int, *symbols: np.ndarray) -> np.ndarray:
    """Bucket of feature ``k`` of one or more symbols."""
    h = np.full(len(symbols[0]), k * 0x9E3779B1 & 0xFFFFFFFF, np.uint64)
    for s in symbols:
        h = (h ^ s.astype(np.uint64)) * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF)
        h ^= h >> np.uint64(15)
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def grams(texts: list[np.ndarray]) -> np.ndarray:
    """Every token of all texts in a row as one number: the symbols before
    it, third last, last but one and last, then its own."""
    pad = np.full(HISTORY, BEGIN, np.int64)
    flat = np.concatenate([x for t in texts for x in (pad, t)]) if texts else pad
    at = np.ones(len(flat), bool)
    starts = np.cumsum([0] + [len(t) + HISTORY for t in texts[:-1]]) if texts else np.zeros(1, int)
    for k in range(HISTORY):
        at[starts + k] = False
    at = np.flatnonzero(at)
    p1, p2, p3 = (flat[at - k] for k in (1, 2, 3))
    return ((p1 * SYMBOLS + p2) * SYMBOLS + p3) * SYMBOLS + flat[at]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of equal values, and each place's run."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


@dataclass
class Model:
    head: list[bytes]
    bias: np.ndarray  # class
    head_bias: np.ndarray  # head class x place
    weight: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, CLASSES), np.float32))
    head_weight: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, HEAD_SIZE), np.float32))
    # Frequent words, each with its place in the arrays of their scores.
    common: dict[bytes, int] = field(default_factory=dict)
    base_score: np.ndarray = field(default_factory=lambda: np.zeros(0))
    tail_score: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def symbols(self) -> Symbols:
        return Symbols(self.head)


def class_of(symbol: np.ndarray) -> np.ndarray:
    return np.where(symbol < HEAD, symbol // HEAD_SIZE, symbol - HEAD + HEAD_CLASSES)


def row_max(x: np.ndarray) -> np.ndarray:
    """The greatest value of each row, by halves: whole columns are fast."""
    while x.shape[1] % 2 == 0:
        half = x.shape[1] // 2
        x = np.maximum(x[:, :half], x[:, half:])
    return x.max(axis=1, keepdims=True)


class Step:
    """One factor of some histories in ascending order, ``near`` the last two
    symbols (and the head class) and ``far`` the third last. Feature buckets
    are those of each run of equal ``near``, and of each history: last word,
    last but one, and the last two together; third last."""

    def __init__(self, bias: np.ndarray, weight: np.ndarray, near: np.ndarray, far: np.ndarray, group=None):
        self.starts, self.run = runs(near)
        near = near[self.starts]
        if group is not None:
            group = group[self.starts]
            near = near // HEAD_CLASSES
        p1, p2 = near // SYMBOLS, near % SYMBOLS
        self.near, self.far = [hashed(1, p1), hashed(2, p2), hashed(4, p1, p2)], hashed(3, far)
        total = np.repeat(bias[None], len(near), axis=0) if group is None else np.take(bias, group, axis=0)
        if group is not None:
            self.near = [(b * 31 + group * 2053) % BUCKETS for b in self.near]
            self.far = (self.far * 31 + group[self.run] * 2053) % BUCKETS
        for b in self.near:
            total += np.take(weight, b, axis=0)
        total = np.take(total, self.run, axis=0)
        total += np.take(weight, self.far, axis=0)
        total -= row_max(total)
        self.total = total

    def chances(self) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of each history's row, and their sums."""
        chance = np.exp(self.total)
        return chance, chance @ np.ones(chance.shape[1], chance.dtype)


def steps(model: Model, gram: np.ndarray):
    """For both factors and some histories at a time of the distinct ``gram``
    in ascending order: the step, the grams concerned, their histories in the
    step and their targets."""
    symbol = gram % SYMBOLS
    group, past = class_of(symbol), gram // SYMBOLS
    head = np.flatnonzero(symbol < HEAD)
    # In the head the class is part of the history, before the third last.
    inner = (past[head] // SYMBOLS * HEAD_CLASSES + group[head]) * SYMBOLS + past[head] % SYMBOLS
    order = np.argsort(inner, kind="stable")
    for level, (history, rows, target) in enumerate((
            (past, np.arange(len(gram)), group), (inner[order], head[order], symbol[head[order]] % HEAD_SIZE))):
        starts, at = runs(history)
        ends = np.append(starts, len(history))
        for a in range(0, len(starts), CHUNK):
            b = min(len(starts), a + CHUNK)
            own = history[starts[a:b]]
            near, far = own // SYMBOLS, own % SYMBOLS
            step = Step(model.head_bias, model.head_weight, near, far, near % HEAD_CLASSES) if level else Step(
                model.bias, model.weight, near, far)
            cut = slice(ends[a], ends[b])
            yield level, step, rows[cut], at[cut] - a, target[cut]


def score_texts(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each text's classes and head words."""
    gram, place = np.unique(grams(texts), return_inverse=True)
    logs = np.zeros(len(gram))
    for _, step, rows, at, target in steps(model, gram):
        logs[rows] += step.total[at, target] - np.log(step.chances()[1])[at]
    ends = np.cumsum([len(t) for t in texts])
    total = np.concatenate(([0.0], np.cumsum(logs[place])))
    return (total[ends] - total[ends - [len(t) for t in texts]]) / LN10


class Gradient:
    """Observed and expected counts of (bucket, outcome) for both factors.
    Tokens that share a history are one row, as often as they occur."""

    def __init__(self):
        self.seen = [np.zeros(BUCKETS * n, np.float32) for n in (CLASSES, HEAD_SIZE)]
        self.expected = [np.zeros((BUCKETS, n), np.float32) for n in (CLASSES, HEAD_SIZE)]

    def add(self, model: Model, texts: list[np.ndarray]) -> None:
        gram, n = np.unique(grams(texts), return_counts=True)
        seen = [[], []]
        for level, step, rows, at, target in steps(model, gram):
            chance, total = step.chances()
            width = chance.shape[1]
            count = n[rows].astype(np.float32)
            chance *= (np.bincount(at, count, len(chance)) / total)[:, None].astype(np.float32)
            self.collect(level, step.far, chance)
            chance = np.add.reduceat(chance, step.starts, axis=0)
            for b in step.near:
                self.collect(level, b, chance)
            run = step.run[at]
            seen[level].extend((b * width + target, count) for b in [step.far[at], *(b[run] for b in step.near)])
        for level, found in enumerate(seen):
            if found:
                key, count = (np.concatenate(x) for x in zip(*found))
                self.seen[level] += np.bincount(key, count, len(self.seen[level])).astype(np.float32)

    def collect(self, level: int, bucket: np.ndarray, chance: np.ndarray) -> None:
        bucket = bucket.astype(np.uint16)  # sorted by radix
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        first, _ = runs(bucket)
        self.expected[level][bucket[first]] += np.add.reduceat(np.take(chance, order, axis=0), first, axis=0)

    def vector(self) -> np.ndarray:
        return np.concatenate([*self.seen, *(e.ravel() for e in self.expected)])


def update(model: Model, vector: np.ndarray) -> None:
    """Move every weight by the scaled log ratio of observed to expected."""
    sizes = [BUCKETS * n for n in (CLASSES, HEAD_SIZE)] * 2
    seen, head_seen, expected, head_expected = np.split(vector, np.cumsum(sizes)[:-1])
    prior = PRIOR * np.exp(model.bias) / np.exp(model.bias).sum()
    for weight, s, e, p in ((model.weight, seen, expected, prior[None]),
                            (model.head_weight, head_seen, head_expected, PRIOR / HEAD_SIZE)):
        s, e = s.reshape(weight.shape), e.reshape(weight.shape)
        weight += STEP * np.log((s + p) / (e + p))


def gradient_sum(docs: DataFrame, model: Model) -> np.ndarray:
    """Counts over all of ``docs``. Each task sends one vector of fixed size;
    vectors are summed as they stream by, part by part."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total, used = shared.value, Gradient(), False
        symbols = model.symbols()
        for batch in batches:
            texts, held = [], 0
            for text in batch.column(0).to_pylist():
                tokens = tokens_of(text)
                texts.append(np.fromiter(map(symbols.__getitem__, tokens), np.int64, len(tokens)))
                held += len(tokens)
                if held >= BLOCK:
                    total.add(model, texts)
                    texts, held = [], 0
            if texts:
                total.add(model, texts)
            used = True
        if used:
            for part, values in enumerate(np.array_split(total.vector(), PARTS)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["part", "vector"])

    sums = sum_vectors(docs.select("text").mapInArrow(run, "part int, vector binary"), "<f4", "<f4")
    parts = np.array_split(np.zeros(2 * BUCKETS * (CLASSES + HEAD_SIZE), np.float32), PARTS)
    for row in sums.collect():
        parts[row["part"]] = np.frombuffer(row["vector"], "<f4")
    shared.unpersist()
    return np.concatenate(parts)


class Words(Terms):
    """Lower-cased words and one end per text. With a model, each text also
    has facts: its token count, the log probability of its classes and head
    words, and the number, base score and tail score of its common words. These
    words, which are most of a text, have no postings."""

    def __init__(self, model: Model | None = None):
        self.words, self.model = Numbers(), model
        self.symbols = model.symbols() if model is not None else None
        self.symbol_of = np.zeros(0, np.int64)  # by word number
        self.common_of = np.zeros(0, np.int64)  # place, or the number of common words
        self.texts: list[np.ndarray] = []
        self.facts: list[tuple[float, ...]] = []
        self.held = 0

    def add(self, text: str | None) -> np.ndarray:
        tokens = tokens_of(text)
        numbers = np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens))
        if self.model is not None:
            self.texts.append(numbers)
            self.held += len(tokens)
            if self.held >= BLOCK:
                self.score()
        return numbers

    def score(self) -> None:
        if self.texts:
            # Symbols are looked up once per distinct word of the block.
            fresh = list(itertools.islice(self.words, len(self.symbol_of), None))
            self.symbol_of = np.concatenate(
                [self.symbol_of, np.array([self.symbols[w] for w in fresh], np.int64)])
            texts = [self.symbol_of[t] for t in self.texts]
            m = self.model
            self.common_of = np.concatenate(
                [self.common_of, np.array([m.common.get(w, len(m.common)) for w in fresh], np.int64)])
            sizes = np.array(list(map(len, texts)))
            starts = np.cumsum(sizes) - sizes  # no text is without its end
            place = self.common_of[np.concatenate(self.texts)]
            values = (place < len(m.common)), *(np.append(x, 0.0)[place] for x in (m.base_score, m.tail_score))
            sums = [np.add.reduceat(x.astype(float), starts).tolist() for x in values]
            self.facts.extend(zip(sizes.astype(float).tolist(), score_texts(m, texts).tolist(), *sums))
        self.texts, self.held = [], 0

    def posted(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        return pieces if self.model is None else [
            p[self.common_of[p] == len(self.model.common)] for p in pieces]

    def finish(self):
        if self.model is not None:
            self.score()
        return [w.decode() for w in self.words], None, None


def term_counts(docs: DataFrame, train: Column) -> DataFrame:
    """``term, n, tail``: every token of the documents, its count in the
    training documents, and its tail class."""
    rows = docs.withColumn("__train", train)
    counts = blocks(rows, Words, only_terms=True, keep="__train").groupBy("term").agg(F.sum("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tail = [tail_class(t.encode()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tail, pa.int32())], names=["term", "n", "tail"])

    return staged(counts.mapInArrow(run, "term string, n bigint, tail int"), "term-counts")


def first_model(counts: DataFrame) -> tuple[Model, DataFrame, int]:
    """The model before training, each term's fixed weights, and the number
    of training tokens."""
    known = counts.where("n > 0")
    size = known.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    top = known.orderBy(F.desc("n"), "term").limit(HEAD).select("term", "n")
    head = top.collect()
    in_head = counts.join(F.broadcast(top.select("term", F.lit(True).alias("head"))), "term", "left").withColumn(
        "head", F.coalesce("head", F.lit(False)))
    tails = {r["tail"]: (r["n"], r["v"]) for r in in_head.where("NOT head AND n > 0").groupBy("tail").agg(
        F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    mass = np.zeros(CLASSES)
    place = np.zeros((HEAD_CLASSES, HEAD_SIZE))
    for i, r in enumerate(head):
        mass[i // HEAD_SIZE] += r["n"]
        place[i // HEAD_SIZE, i % HEAD_SIZE] = r["n"]
    totals = np.ones(TAIL_CLASSES)
    for t in range(TAIL_CLASSES):
        n, v = tails.get(t, (0, 0))
        mass[HEAD_CLASSES + t] = n + 1
        totals[t] = n + v + 1
    with np.errstate(divide="ignore"):
        bias = np.maximum(np.log(mass / mass.sum()), -60.0)
        share = np.maximum(np.log(place / np.maximum(1.0, place.sum(axis=1, keepdims=True))), -60.0)
    total = F.element_at(F.array(*[F.lit(float(t)) for t in totals]), F.col("tail") + 1)
    weights = in_head.select(
        "term", "n", F.log10((F.col("n") + 1) / F.lit(float(size["n"] + size["v"] + 1))).alias("base_score"),
        (F.col("n") > 0).cast("double").alias("n_known"),
        F.when(F.col("head"), 0.0).otherwise(F.log10((F.col("n") + 1) / total)).alias("tail_score"))
    common = weights.where((F.col("n") > 0) & (F.col("n") * COMMON >= F.lit(int(size["n"])))).select(
        "term", "base_score", "tail_score").collect()
    model = Model([r["term"].encode() for r in head], bias.astype(np.float32), share.astype(np.float32),
                  common={r["term"].encode(): i for i, r in enumerate(common)},
                  base_score=np.array([r["base_score"] for r in common], float),
                  tail_score=np.array([r["tail_score"] for r in common], float))
    return model, weights.drop("n"), int(size["n"])


def held_out(doc_id: Column, parts: int = 7, out: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == out, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    of every row's whole text (null: empty, one end token).

    Learns from all rows that are not held out; repeated rows count each
    time. Without training rows every token is unknown. Other columns are
    ignored, and an empty table gives no rows. The model's size is fixed; the
    counts it rests on are of all training tokens.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = ~held_out(F.col("doc_id"))
    counts = term_counts(docs, train)
    model, weights, n_train = first_model(counts)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(rounds))
    for r in range(rounds if n_train else 0):
        update(model, gradient_sum(docs.where(train & (part == r)), model))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    facts = ["n_tokens", "class_score", "common_known", "common_base", "common_tail"]
    postings = blocks(docs, lambda: Words(shared.value), facts=facts)
    sums = sums_by_document(postings, weights, ["base_score", "n_known", "tail_score"], facts=facts)
    return sums.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("n_tokens").cast("long").alias("n_tokens"),
        F.round(F.col("n_known") + F.col("common_known")).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("common_base")).alias("base_score"), (F.col("class_score") + F.col("common_tail") + F.col("tail_score")).alias("score"))
