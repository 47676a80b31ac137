"""Published versions of a table folder: write beside, then point to it.

Data folders are written once and never changed. What a reader sees is named
by the newest file under ``_published``: a small JSON file per version, which
lists the live folders. A writer writes new data folders, then the next of
these files under another name, and renames it. The rename is one step of the
file system: a reader sees all of a version or nothing of it, a job that dies
before it leaves the old version whole, and of two writers of the same version
the second one fails. A reader keeps the version it opened.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

POINTERS = "_published"


def hadoop_path(spark: SparkSession, path: str):
    """``(file system, path)`` of a path on any Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists."""
    fs, p = hadoop_path(spark, path)
    return bool(fs.exists(p))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, the oldest first."""
    fs, p = hadoop_path(spark, f"{path}/{POINTERS}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def read_state(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version (the newest by default) says; None if nothing is
    published."""
    known = versions(spark, path)
    if not known:
        return None
    fs, p = hadoop_path(spark, f"{path}/{POINTERS}/{known[-1] if version is None else version:08d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def new_folder(version: int) -> str:
    """Name of a data folder for a version to come; another attempt at the
    same version never writes to it."""
    return f"{version:08d}-{uuid.uuid4().hex[:12]}"


def publish(spark: SparkSession, path: str, state: dict) -> None:
    """Make ``state`` the version ``state["version"]``; fails if another
    writer has published that version."""
    base = f"{path}/{POINTERS}"
    target = f"{base}/{state['version']:08d}.json"
    fs, temporary = hadoop_path(spark, f"{base}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, False)
    try:
        out.write(json.dumps(state).encode())
    finally:
        out.close()
    _, p = hadoop_path(spark, target)
    if fs.exists(p) or not fs.rename(temporary, p):
        fs.delete(temporary, False)
        raise RuntimeError(f"version {state['version']} of {path} was published by another writer")


def folders_in(state: dict) -> set[str]:
    """Data folders that a state refers to."""
    return set(state["folders"])


def drop_old(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all versions but the newest ``keep`` and the data folders that
    none of those refers to. No reader may still use an older version, and no
    writer may be at work. Returns the names of the deleted data folders."""
    if keep < 1:
        raise ValueError("at least the newest version is kept")
    known = versions(spark, path)
    kept = known[-keep:]
    live = set().union(*(folders_in(read_state(spark, path, v)) for v in kept)) if kept else set()
    fs, p = hadoop_path(spark, path)
    if not kept:
        return []
    gone = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("_version=") and name.removeprefix("_version=") not in live:
            fs.delete(status.getPath(), True)
            gone.append(name.removeprefix("_version="))
    for v in known[:-keep]:
        fs.delete(hadoop_path(spark, f"{path}/{POINTERS}/{v:08d}.json")[1], False)
    return sorted(gone)
