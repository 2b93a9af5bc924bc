"""Versioned folders behind a pointer that is switched last.

A table is written whole into a folder of its own; only then a pointer entry
names it. Pointer entries are numbered files that come into being by a rename,
so a reader sees the old version or the new one, never a part, and a job that
fails before the switch leaves the old rows as they were. Old versions stay for
readers that have opened them until ``remove_old`` is called.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, version folder) of every switch, oldest first."""
    fs, at = _fs(spark, f"{root.rstrip('/')}/_current")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if n[0].isdigit())


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the version that readers see; None before the first one."""
    known = _pointers(spark, root)
    return f"{root.rstrip('/')}/{known[-1][1]}" if known else None


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a fresh folder, then make it the current version."""
    root = root.rstrip("/")
    name = f"v{uuid.uuid4().hex}"
    write(f"{root}/{name}")
    known = _pointers(spark, root)
    number = known[-1][0] + 1 if known else 1
    fs, folder = _fs(spark, f"{root}/_current")
    fs.mkdirs(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft = path(f"{root}/_current/_draft-{name}")
    fs.create(draft).close()
    if not fs.rename(draft, path(f"{root}/_current/{number:012d}-{name}")):
        raise OSError(f"could not switch {root} to {name}")
    return f"{root}/{name}"


def remove_old(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove all but the newest ``keep`` published versions; returns how many went."""
    root = root.rstrip("/")
    gone = _pointers(spark, root)[: -max(keep, 1)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    for number, name in gone:
        fs, _ = _fs(spark, root)
        fs.delete(path(f"{root}/_current/{number:012d}-{name}"), False)
        fs.delete(path(f"{root}/{name}"), True)
    return len(gone)


def remove(spark: SparkSession, root: str) -> None:
    """Remove all versions and pointers, published or not: for folders that only one job knows."""
    fs, at = _fs(spark, root.rstrip("/"))
    fs.delete(at, True)
