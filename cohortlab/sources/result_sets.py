"""Sets of result tables that change all at once.

Below a root, each set is written to a folder of its own and counts only once a marker in ``published`` names it.
Making that empty file is the only step that readers can see, and it is one step on any file system; the set of the
greatest marker is the current one. A writer that dies leaves a folder that nobody reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortlab.sources.tables import write_table


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _published(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, folder name) of every published set, oldest first."""
    fs, p = _path(spark, f"{root}/published")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    found = [n.split(".", 1) for n in names if n[:1].isdigit() and "." in n]
    return sorted((int(number), folder) for number, folder in found)


def new_set(root: str) -> str:
    """A folder to write the tables of the next set to; unseen by readers until ``publish``."""
    return f"{root.rstrip('/')}/sets/{uuid.uuid4().hex}"


def publish(spark: SparkSession, folder: str) -> int:
    """Make the set in ``folder`` the current one; its number is returned. Of two writers that publish at once
    one set, whole, is the current one for all readers."""
    root, name = folder.rsplit("/sets/", 1)
    before = _published(spark, root)
    number = before[-1][0] + 1 if before else 1
    fs, p = _path(spark, f"{root}/published/{number:012d}.{name}")
    fs.create(p, False).close()
    return number


def current_set(spark: SparkSession, root: str) -> str | None:
    """The folder of the current set; None before the first one. A reader that asks once reads all its tables of one set."""
    root = root.rstrip("/")
    found = _published(spark, root)
    return f"{root}/sets/{found[-1][1]}" if found else None


def write_set(spark: SparkSession, root: str, tables: dict[str, DataFrame], keep: int = 2) -> int:
    """Write ``tables`` as the next set, publish it and drop all sets but the last ``keep``. The tables may be computed from
    the current set."""
    folder = new_set(root)
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}")
    number = publish(spark, folder)
    drop_superseded(spark, root, keep)
    return number


def read_result(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current set."""
    folder = current_set(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no result set is published below {root}")
    return spark.read.parquet(f"{folder}/{name}")


def drop_superseded(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all published sets but the last ``keep``, marker first. Readers of the set before the current one go on
    undisturbed while ``keep`` is 2; folders not published are left alone, as they may be in writing."""
    root = root.rstrip("/")
    for number, name in _published(spark, root)[:-max(1, keep)]:
        for path in (f"{root}/published/{number:012d}.{name}", f"{root}/sets/{name}"):
            fs, p = _path(spark, path)
            fs.delete(p, True)
