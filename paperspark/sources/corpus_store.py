"""The parsed corpus and its index, stored once and kept up to date.

``refresh`` compares the files of a corpus with a ledger of the files stored
so far (path, length, modification time) and parses only what is new or has
changed. Every refresh writes one data folder:

* ``papers``: every valid line as a typed row, range-sorted by id, in small
  row groups with a Bloom filter of their ids; the last line of an id in the
  folder is marked, so that a corpus of one folder is read without a shuffle;
* ``index``: ``(category, created, id)`` of every indexable line, sorted by
  category and time;
* ``rejects``: lines that are no records, and records that cannot be indexed;
* ``files``: the ledger rows of the files these lines come from.

Lines of files that are gone or have changed leave by an anti-join on the
file, which rewrites only the data folders that hold such lines. The folders
that count are published in one step (see ``versions``), so a refresh that
dies leaves the old state, and a stored corpus equals one built anew from the
same files. When there are more than ``MAX_FOLDERS``, a refresh joins them.
"""

from __future__ import annotations

import re
from contextlib import ExitStack
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_version_date
from ..functions.text import first_token
from ..schemas import FIELD_TYPES, INDEX_SCHEMA, METADATA_FIELDS
from ..session import STORED_CODEC, apply_required_conf, shuffles_dropped, staged, staged_for
from .papers import POS, check_fields, latest_per_id, read_lines, tag_lines, versions_created
from .versions import new_folder, publish, read_state

MAX_FOLDERS = 16
# Column of the mark, and what a published folder that has it is listed with.
LAST = "_last"
MARKED = 2
# Up to so many ids are pushed into the Parquet scan; beyond, they are joined.
PUSHED_IDS = 2_000
# They go in lists of so many (the session's pushdown threshold): Spark hands a
# list to Parquet as a chain of comparisons, and a long chain overflows a stack.
LIST_IDS = 100
# Rows of a corpus are whole texts: a row group holds some thousands.
ROW_GROUP_BYTES = 16 << 20
ROW_GROUP_IDS = 20_000

POS_TYPE = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()),
                         T.StructField("row", T.LongType())])
PAPERS = T.StructType([*[T.StructField(f, FIELD_TYPES[f]) for f in METADATA_FIELDS], T.StructField(POS, POS_TYPE)])
INDEX = T.StructType([*INDEX_SCHEMA.fields, T.StructField("file", T.StringType())])
REJECTS = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "line", "reason", "file")])
FILES = T.StructType([T.StructField("file", T.StringType()), T.StructField("path", T.StringType()),
                      T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType())])


class Refresh(NamedTuple):
    """What a refresh did: the published version, the files it parsed, the
    files whose lines it removed, and the data folders it rewrote."""

    version: int
    parsed: int
    removed: int
    rewritten: int


def _part(spark: SparkSession, path: str, folders, name: str, schema: T.StructType) -> DataFrame:
    paths = [f"{path}/_version={f}/{name}" for f in sorted(folders)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def _folders(spark: SparkSession, path: str):
    state = read_state(spark, path)
    return state["folders"] if state else {}


def list_files(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """``file, path, length, modified`` of every file; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files)
    return found.select(F.col("_metadata.file_path").alias("file"), "path", "length",
                        F.col("modificationTime").alias("modified"))


def _ledger(spark: SparkSession, path: str, folders) -> DataFrame:
    out = spark.createDataFrame([], T.StructType([*FILES.fields, T.StructField("folder", T.StringType())]))
    for f in sorted(folders):
        out = out.unionByName(_part(spark, path, [f], "files", FILES).withColumn("folder", F.lit(f)))
    return out


def _escaped(path: str) -> str:
    """A path whose characters are taken as they are, not as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _write_papers(rows: DataFrame, target: str) -> None:
    # A range holds all lines of an id in order: the window needs no shuffle.
    next_line = F.lead(F.lit(True)).over(Window.partitionBy("id").orderBy(POS))
    (rows.repartitionByRange("id").sortWithinPartitions("id", POS).withColumn(LAST, next_line.isNull()).write
     .option("compression", STORED_CODEC)
     .option("parquet.block.size", ROW_GROUP_BYTES)
     .option("parquet.bloom.filter.enabled#id", "true")
     .option("parquet.bloom.filter.expected.ndv#id", ROW_GROUP_IDS)
     .parquet(target))


def _indexed(rows: DataFrame) -> DataFrame:
    """Paper rows with their category, time and the reason not to index them."""
    rows = rows.select("id", first_token("categories").alias("category"),
                       parse_version_date(versions_created("versions")).alias("created"),
                       F.col(f"{POS}.file").alias("file"))
    reason = (F.when(F.col("id") == "", "missing id").when(F.col("category").isNull(), "missing category")
              .when(F.col("created").isNull(), "missing or unparsable version time"))
    return rows.withColumn("reason", reason)


def _any_of(ids: list[str]):
    """Filter for ids, as a balanced tree of short lists."""
    if len(ids) <= LIST_IDS:
        # As text: a list of literals crosses to the JVM one by one.
        quoted = ", ".join("'" + i.replace("\\", "\\\\").replace("'", "\\'") + "'" for i in ids)
        return F.expr(f"id IN ({quoted})") if ids else F.lit(False)
    half = len(ids) // 2
    return _any_of(ids[:half]) | _any_of(ids[half:])


def refresh(spark: SparkSession, path: str, files: str | list[str], rebuild: bool = False) -> Refresh:
    """Bring the stored corpus in line with ``files`` (NDJSON files or folders
    of them) and publish it. Nothing is parsed or written if nothing has
    changed; ``rebuild`` parses everything anew.

    The driver sees the paths of new files, as Spark's reader does, and the
    names of at most ``MAX_FOLDERS`` data folders.
    """
    apply_required_conf(spark)
    state = read_state(spark, path) or {"version": 0, "folders": {}}
    held = {} if rebuild else state["folders"]
    # Staged: the files may change while this runs, the ledger may not.
    now = staged(list_files(spark, files), "listed-files")
    dirty, removed, lost = set(), 0, None
    fresh = now
    if held:
        before = _ledger(spark, path, held)
        same = ["file", "length", "modified"]
        fresh = now.join(before.select(same), same, "left_anti")
        gone = staged(before.join(now.select(same), same, "left_anti").select("file", "folder"), "gone-files")
        per_folder = gone.groupBy("folder").agg(F.count("*").alias("n")).collect()
        dirty, removed = {r["folder"] for r in per_folder}, sum(r["n"] for r in per_folder)
        lost = gone.select(F.col("file").alias("__file"))
    paths = [r["path"] for r in fresh.select("path").collect()]
    if held and not paths and not dirty:
        return Refresh(state["version"], 0, 0, 0)
    if len(held) - len(dirty) + 1 > MAX_FOLDERS:
        dirty = set(held)

    def survivors(name: str, schema: T.StructType, file: str) -> DataFrame:
        old = _part(spark, path, dirty, name, schema)
        return old.join(lost, F.col(file) == F.col("__file"), "left_anti") if removed else old

    version = state["version"] + 1
    folder = new_folder(version)
    top = f"{path}/_version={folder}"
    rows, index, rejects, ledger = (survivors(name, schema, file) for name, schema, file in (
        ("papers", PAPERS, f"{POS}.file"), ("index", INDEX, "file"), ("rejects", REJECTS, "file"),
        ("files", FILES, "file")))
    with ExitStack() as until_written:
        if paths:
            # Parsed once: what follows sorts, and samples its input for that.
            parsed = until_written.enter_context(
                staged_for(tag_lines(read_lines(spark, [_escaped(p) for p in paths])), "parsed"))
            new_rows = parsed.where("_reason IS NULL").select(*PAPERS.names)
            tagged = _indexed(new_rows)
            rows = rows.unionByName(new_rows)
            index = index.unionByName(tagged.where("reason IS NULL").select(*INDEX.names))
            rejects = (rejects.unionByName(parsed.where("_reason IS NOT NULL").select(
                "id", F.col("_line").alias("line"), F.col("_reason").alias("reason"), F.col(f"{POS}.file").alias("file")))
                .unionByName(tagged.where("reason IS NOT NULL").select(
                    "id", F.lit(None).cast("string").alias("line"), "reason", "file")))
            ledger = ledger.unionByName(fresh.select(*FILES.names))
        until_written.enter_context(shuffles_dropped(spark))
        _write_papers(rows, f"{top}/papers")
        order = ["category", "created", "id"]
        index.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{top}/index")
        rejects.write.parquet(f"{top}/rejects")
        ledger.coalesce(1).write.parquet(f"{top}/files")
    live = {f: n for f, n in held.items() if f not in dirty}
    publish(spark, path, {"version": version, "folders": {**live, folder: MARKED}})
    return Refresh(version, len(paths), removed, len(dirty))


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    """``(category, created, id)`` of every indexed line; filters on category
    and time reach the Parquet scan."""
    return _part(spark, path, _folders(spark, path), "index", INDEX).select(*INDEX_SCHEMA.names)


def stored_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``id, line, reason, file`` of everything quarantined."""
    return _part(spark, path, _folders(spark, path), "rejects", REJECTS)


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: ``file, path, length, modified`` of the files stored."""
    return _ledger(spark, path, _folders(spark, path)).drop("folder")


def stored_papers(spark: SparkSession, path: str, fields: list[str] | None = None, ids=None) -> DataFrame:
    """Papers keyed by id with the requested fields; the last line of an id in
    file order wins. ``ids``: None for all, a list or set, or a DataFrame
    whose first column (or ``id``) holds them; an empty one gives no rows.

    Up to ``PUSHED_IDS`` ids (counted) become a filter of the scan: a row
    group is read only if its id range and its Bloom filter admit one of
    them. More ids are joined.
    """
    apply_required_conf(spark)
    fields = [f for f in check_fields(fields) if f != "id"]
    folders = _folders(spark, path)
    # In a single folder the marked lines are the last ones; of several, or of
    # one written without the mark, lines are compared.
    marked = list(folders.values()) == [MARKED]
    rows = _part(spark, path, folders, "papers", T.StructType([*PAPERS.fields, T.StructField(LAST, T.BooleanType())]))
    rows = rows.select("id", *[F.col(f"`{f}`") for f in fields], POS, LAST)
    if ids is not None:
        if not isinstance(ids, DataFrame):
            wanted = set(ids)
            if len(wanted) > PUSHED_IDS:
                ids = spark.createDataFrame([(i,) for i in wanted], "id string")
        if isinstance(ids, DataFrame):
            ids = ids.select(F.col("id" if "id" in ids.columns else ids.columns[0]).alias("id")).distinct()
            found = ids.limit(PUSHED_IDS + 1).collect()
            wanted = {r["id"] for r in found} if len(found) <= PUSHED_IDS else None
        wanted = None if wanted is None else sorted(i for i in wanted if i is not None)
        rows = rows.join(ids, "id", "left_semi") if wanted is None else rows.where(_any_of(wanted))
    if marked:
        return rows.where(F.col(LAST).eqNullSafe(True)).drop(POS, LAST)
    return latest_per_id(rows, fields)
