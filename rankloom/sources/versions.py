"""Tables in versioned folders with commits that are single, complete steps.

    root/NAME/versions/ID            the files of one version, written by one writer only
    root/NAME/commits/NUMBER-ID      an empty marker; the last one in order names the version that counts

A writer fills a folder of its own and then creates one marker.  Creating a file is atomic in
every file system that Hadoop reads, object stores included, so a reader sees the old version
or the new one, never none and never both.  Two writers never touch the same path: if both
take the same number, the identifier orders them, and every reader agrees on the order.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Versions that stay readable for plans made before the last commits.
KEEP = 2


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of what lies in a folder; none if the folder is missing."""
    files, hadoop = _files(spark, path)
    try:
        found = files.listStatus(hadoop)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileNotFoundException":
            return []
        raise
    listed = [(s.getPath().getName(), s.getModificationTime()) for s in found]
    return sorted(n for n in listed if not n[0].startswith((".", "_")))


def _commits(spark: SparkSession, table: str) -> list[str]:
    return [name for name, _ in _names(spark, f"{table}/commits")]


def _delete(spark: SparkSession, path: str) -> None:
    files, hadoop = _files(spark, path)
    files.delete(hadoop, True)


def new_version(table: str) -> str:
    """A folder that no other writer uses; it counts only once it is committed."""
    return f"{table}/versions/{uuid.uuid4().hex}"


def discard(spark: SparkSession, version: str) -> None:
    """Remove a version that will not be committed."""
    _delete(spark, version)


def commit(spark: SparkSession, table: str, version: str, keep: int = KEEP) -> None:
    """Make a complete version the one that counts.

    Committed versions before the last ``keep`` are removed, data after their marker, so a
    crash in between leaves an unnamed folder (see :func:`vacuum`) and no marker without data.
    """
    if keep < 1:
        raise ValueError("at least one version stays")
    earlier = _commits(spark, table)
    number = 1 + int(earlier[-1].partition("-")[0]) if earlier else 0
    files, marker = _files(spark, f"{table}/commits/{number:012d}-{version.rsplit('/', 1)[1]}")
    files.create(marker, False).close()
    for name in _commits(spark, table)[:-keep]:
        _delete(spark, f"{table}/commits/{name}")
        _delete(spark, f"{table}/versions/{name.partition('-')[2]}")


def current(spark: SparkSession, table: str) -> str | None:
    """Folder of the version that counts; None if the table has no commits."""
    named = _commits(spark, table)
    return f"{table}/versions/{named[-1].partition('-')[2]}" if named else None


def history(spark: SparkSession, table: str) -> list[str]:
    """Folders of the versions that can still be read, oldest first."""
    return [f"{table}/versions/{name.partition('-')[2]}" for name in _commits(spark, table)]


def vacuum(spark: SparkSession, table: str, older_than_seconds: float = 7 * 86400) -> int:
    """Remove folders that no marker names and that have not changed for so long; returns how many.

    The time must exceed the longest write: a younger folder may belong to a writer at work.
    """
    limit = (time.time() - older_than_seconds) * 1000
    found = _names(spark, f"{table}/versions")
    # Listed after the folders: a version committed meanwhile is named.
    named = {name.partition("-")[2] for name in _commits(spark, table)}
    left = [name for name, changed in found if name not in named and changed <= limit]
    for name in left:
        _delete(spark, f"{table}/versions/{name}")
    return len(left)
