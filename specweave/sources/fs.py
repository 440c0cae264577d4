"""Driver-side file-system metadata through the session's Hadoop FileSystem.

Only listings, existence tests and small marker files (summary, READY)
go through here -- never data rows.  Works for any Hadoop URI the cluster
is configured for (hdfs://, s3a://, abfs://, file://).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p)) and bool(fs.getFileStatus(p).isFile())


def is_readable_input(spark: SparkSession, path: str) -> bool:
    """A file, or a directory of part files (as Spark writes them)."""
    return exists(spark, path)


def size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return 0
    return int(fs.getContentSummary(p).getLength())


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p))


@dataclass(frozen=True)
class FileStatus:
    uri: str
    raw_path: str  # encoded path of the URI, without scheme and authority
    size: int
    modified: int  # milliseconds


def list_files(spark: SparkSession, path: str) -> list[FileStatus]:
    """The file, or the data files of the folder, as Spark's readers see them
    (no hidden ones, no subfolders)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for s in fs.listStatus(p):
        q = s.getPath()
        if s.isFile() and str(q.getName())[:1] not in "._":
            out.append(FileStatus(str(q.toString()), str(q.toUri().getRawPath()), int(s.getLen()), int(s.getModificationTime())))
    return out


def part_number(path: str) -> int:
    """Numeric id of a part file written by Spark, -1 for any other name."""
    found = re.search(r"/part-(\d{1,18})[^/]*$", path)
    return int(found.group(1)) if found else -1


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small marker file atomically (temp name, then rename)."""
    fs, p = _fs(spark, path)
    jvm = spark._jvm
    tmp = jvm.org.apache.hadoop.fs.Path(path + "._tmp")
    out = fs.create(tmp, True)
    try:
        data = text.encode("utf-8")
        out.write(bytearray(data))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"could not publish {path}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def rename(spark: SparkSession, src: str, dst: str) -> None:
    fsys, p = _fs(spark, src)
    _, q = _fs(spark, dst)
    if not fsys.rename(p, q):
        raise OSError(f"could not rename {src} to {dst}")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder; one that is not there is fine."""
    fsys, p = _fs(spark, path)
    fsys.delete(p, True)
