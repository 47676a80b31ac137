"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperspark.session import apply_required_conf, fresh_path

# Words are maximal runs without ASCII white space.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RE = "[ \\t\\n\\x0B\\f\\r]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Rows of two numbers that may be broadcast: 16 bytes each, 16 MB at most.
BROADCAST_ROWS = 1 << 20

# Rows hold whole texts, so Arrow batches stay small in rows and bytes.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Settings and package shipping that the Python stages rely on."""
    apply_required_conf(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    Cuts the lineage, so a lost executor never re-runs what came before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def word_array(text):
    """Column: the words of ``text`` in order (null: none)."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_RE)
    return F.filter(parts, lambda w: w != "")


def byte_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows holding at most ``most`` units each (a
    longer single row stands alone)."""
    start = total = end = 0
    for end, n in enumerate(lengths):
        if total and total + n > most:
            yield start, end
            start, total = end, 0
        total += n
    if total or end >= start:
        yield start, end + 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words, given the words' hashes."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    factor = 1
    for k in range(n):
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
        total += words[k:k + len(total)] * np.uint64(factor | 1)
    return mixed(total)


def sum_vectors(df: DataFrame, kind: str, total_kind: str) -> DataFrame:
    """Element-wise sums (as ``total_kind``) of the binary vectors (of
    ``kind``) of ``df(part, vector)`` by part. Rows stream through a task
    that holds one vector per part only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(vector.as_buffer(), kind)
                if part in total:
                    total[part] += values
                else:
                    total[part] = values.astype(total_kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
            names=["part", "vector"])

    return df.select("part", "vector").repartition("part").mapInArrow(run, "part int, vector binary")


def join_by_id(big: DataFrame, small: DataFrame, on: str, how: str = "inner", size=None) -> DataFrame:
    """``big`` joined to a staged table of ids. Up to ``BROADCAST_ROWS`` rows
    of the small side (counted; with ``size``, a column of the entries of a
    row, up to so many entries) it is broadcast, so whole texts stay where
    they are; beyond, both sides are shuffled and hot keys split by AQE."""
    if size is None:
        entries = small.count()
    else:
        entries = small.agg(F.sum(size + 1)).first()[0] or 0
    return big.join(F.broadcast(small) if entries <= BROADCAST_ROWS else small, on, how)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of
    the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
