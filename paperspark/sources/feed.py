"""API feed records: normalisation, newest-first selection, JSON sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.dates import iso_utc
from ..functions.text import newline_to_space, strip_ws
from ..schemas import DEFAULT_FEED_SIZE


def normalise_feed(raw: DataFrame) -> DataFrame:
    """Trim titles, list author names, strip summaries and fold their
    newlines into spaces, render times as ISO-8601 with a UTC offset. A
    TIMESTAMP is an instant; a TIMESTAMP_NTZ is a UTC wall clock."""
    def iso(c):
        return iso_utc(c, instant=isinstance(raw.schema[c].dataType, T.TimestampType)).alias(c)

    return raw.select(
        strip_ws("title").alias("title"),
        F.transform("authors", lambda a: a["name"]).alias("authors"),
        newline_to_space(strip_ws("summary")).alias("summary"),
        iso("published"), iso("updated"),
        "pdf_url", "entry_id",
    )


def newest(feed: DataFrame, n: int = DEFAULT_FEED_SIZE) -> DataFrame:
    """The ``n`` most recently published records (ties by entry id)."""
    return feed.orderBy(F.desc("published"), "entry_id").limit(n)


def write_feed(feed: DataFrame, path: str) -> None:
    """JSON lines, one record per line (read back with ``spark.read.json``)."""
    feed.write.mode("overwrite").json(path)


SAVED_FEED_DDL = ("title string, authors array<string>, summary string, published string, "
                  "updated string, pdf_url string, entry_id string")


def read_saved_feed(spark, path: str, array_file: bool = True) -> DataFrame:
    """Normalised feed records saved as one JSON array per file (the
    pretty-printed form) or, with ``array_file=False``, as JSON lines.
    Times stay ISO-8601 text, as saved."""
    reader = spark.read.schema(SAVED_FEED_DDL)
    if array_file:
        reader = reader.option("multiLine", "true")
    return reader.json(path)
