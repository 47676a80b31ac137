"""Paper metadata: NDJSON lines to typed records, with a quarantine.

Every line is parsed once with an all-text schema, so a value can never be
rejected for its type; a line is rejected only when it is not a JSON object
(blank, malformed, an array or a scalar) or has no ``id``. The rejected
lines are returned as their own DataFrame instead of being dropped.

Each line carries ``_pos``, its position in the input (file path, split
start, row within the split), so "the later line wins" stays exact when the
same id occurs twice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import (
    AUTHORS_PARSED_TYPE, FIELD_TYPES, METADATA_FIELDS, RAW_CORRUPT_COL, RAW_PAPER_SCHEMA,
    VERSIONS_TYPE,
)

POS = "_pos"


class Parsed(NamedTuple):
    records: DataFrame
    rejects: DataFrame


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines of one or more NDJSON files with their input position.

    Splits are read in parallel; ``(file_path, file_block_start, row id)``
    orders lines as they appear in the files, because a split lies inside
    one task and row ids grow within a task.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.text(paths)
    return df.select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(POS),
    )


def parse_lines(lines: DataFrame, line_col: str = "value", pos_col: str | None = POS) -> Parsed:
    """Decode lines into typed paper records and quarantined rejects."""
    tagged = tag_lines(lines, line_col, pos_col)
    return Parsed(tagged.filter(F.col("_reason").isNull()).select(*[f"`{f}`" for f in METADATA_FIELDS], POS),
                  tagged.filter(F.col("_reason").isNotNull()).select(
                      F.col("_line").alias("line"), F.col("_reason").alias("reason"), POS))


def tag_lines(lines: DataFrame, line_col: str = "value", pos_col: str | None = POS) -> DataFrame:
    """Every line once: the typed fields and ``_pos``, ``_reason`` (NULL for a
    record) and ``_line`` (the text of a line that is none)."""
    if pos_col is None or pos_col not in lines.columns:
        lines = lines.withColumn(POS, F.struct(F.monotonically_increasing_id().alias("row")))
        pos_col = POS
    opts = {"columnNameOfCorruptRecord": RAW_CORRUPT_COL, "allowSingleQuotes": "false",
            "mode": "PERMISSIVE"}
    # The parse sits behind a one-row explode: filters on its result cannot
    # be pushed below a Generate, so each line is parsed exactly once
    # (pushed below a plain projection, the filter would carry its own copy
    # of the parse).
    raw = lines.select(
        F.col(line_col).alias("_line"),
        F.col(pos_col).alias(POS),
        F.explode(F.array(F.from_json(F.col(line_col), RAW_PAPER_SCHEMA, opts))).alias("_r"),
    )
    line = F.col("_line")
    reason = (
        F.when(line.isNull() | (F.trim(line) == ""), F.lit("blank line"))
        .when(F.col("_r").isNull() | F.col(f"_r.{RAW_CORRUPT_COL}").isNotNull(),
              F.when(line.rlike(r"^\s*\{"), F.lit("malformed JSON"))
              .otherwise(F.lit("not a JSON object")))
        .when(~line.rlike(r"\}\s*$"), F.lit("text after the JSON object"))
        .when(F.col("_r.id").isNull(), F.lit("missing id"))
    )
    tagged = raw.withColumn("_reason", reason)
    typed = [
        (F.from_json(F.col(f"_r.`{f}`"), FIELD_TYPES[f]) if f in ("versions", "authors_parsed")
         else F.col(f"_r.`{f}`")).alias(f)
        for f in METADATA_FIELDS
    ]
    return tagged.select(*typed, POS, "_reason", F.when(F.col("_reason").isNotNull(), F.col("_line")).alias("_line"))


def check_fields(fields: list[str] | None) -> list[str]:
    """Whitelisted field list; empty or None means every field."""
    if not fields:
        return list(METADATA_FIELDS)
    unknown = [f for f in fields if f not in METADATA_FIELDS]
    if unknown:
        raise ValueError(f"no such paper field: {', '.join(unknown)} (known: {', '.join(METADATA_FIELDS)})")
    return list(fields)


def _id_filter(records: DataFrame, ids) -> DataFrame:
    if ids is None:
        return records
    if isinstance(ids, DataFrame):
        id_col = "id" if "id" in ids.columns else ids.columns[0]
        keys = ids.select(F.col(id_col).alias("id")).distinct()
        # Let the planner (and AQE at run time) choose broadcast or shuffle
        # from the measured size of the key set.
        return records.join(keys, "id", "left_semi")
    ids = list(ids)
    if not ids:
        return records.limit(0)
    if len(ids) <= 10_000:
        return records.filter(F.col("id").isin(ids))
    spark = records.sparkSession
    return records.join(spark.createDataFrame([(i,) for i in ids], "id string"), "id", "left_semi")


def latest_per_id(records: DataFrame, value_cols: list[str], pos_col: str = POS) -> DataFrame:
    """Keep the last occurrence of every id (the later line wins).

    ``max_by`` is a partial aggregate: each task reduces its rows per id
    before the shuffle, so an id repeated millions of times ships one row
    per task, not all of them to one reducer.
    """
    packed = F.struct(*[F.col(f"`{c}`") for c in value_cols])
    return (records.groupBy("id")
            .agg(F.max_by(packed, F.col(pos_col)).alias("_v"))
            .select("id", *[F.col(f"_v.`{c}`").alias(c) for c in value_cols]))


def load_papers(records: DataFrame, fields: list[str] | None = None, ids=None,
                limit: int | None = None) -> DataFrame:
    """Papers keyed by id with the requested fields.

    ``ids``: None = all, a list/set or a one-column DataFrame of ids (an
    empty list gives no rows). ``limit``: the first ``limit`` matching lines
    in input order are read, then duplicates collapse (later line wins);
    None = no limit.
    """
    fields = [f for f in check_fields(fields) if f != "id"]
    sel = _id_filter(records, ids)
    if limit is not None:
        if limit <= 0:
            sel = sel.limit(0)
        else:
            sel = sel.orderBy(POS).limit(int(limit))
    return latest_per_id(sel.select("id", *[F.col(f"`{f}`") for f in fields], POS), fields)


def versions_created(col: Column | str = "versions") -> Column:
    """``created`` text of the last listed version (position, not date)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_element_at(c, F.lit(-1))["created"]


__all__ = ["Parsed", "read_lines", "parse_lines", "tag_lines", "check_fields", "load_papers",
           "latest_per_id", "versions_created", "POS", "VERSIONS_TYPE", "AUTHORS_PARSED_TYPE"]
