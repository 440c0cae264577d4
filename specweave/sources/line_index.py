"""Line counts of text files, kept between reads (A2, F1).

Two tables, both as small as a file listing:

* ``files``: (file, size, modified, lines). It turns a range of lines into the
  files that hold it, so the first N lines, or one failing line, cost a read of
  those files only. An entry holds for a file of the same size and modification
  time; a changed file is counted again, the others are not. Files are counted
  as they are needed: the first ones of a view for its first lines.
* ``scans``: the chunk table of one scan (see :mod:`specweave.sources.text`), kept
  under a digest of its files and of the settings that decide how Spark splits
  them, so that reading the same lines again does not count them again.

The index lies in a folder of its own (a view may be read-only): by default a
scratch folder of this process, or a lasting one that the caller names.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import fs

# Settings that decide how a scan is split into partitions.
LAYOUT = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum",
          "spark.sql.files.maxPartitionNum", "spark.sql.leafNodeDefaultParallelism")

_GLOB = str.maketrans({c: "\\" + c for c in "\\{[*?"})


@dataclass(frozen=True)
class TextFile:
    """A file as listed: ``path`` to read it by, ``key`` as in ``_metadata.file_path``
    without scheme and authority."""

    path: str
    key: str
    size: int
    modified: int

    @property
    def stamp(self) -> tuple[str, int, int]:
        return self.key, self.size, self.modified


def text_files(spark: SparkSession, path: str) -> list[TextFile]:
    """The files of a text input in line order: numeric part order, then name."""
    found = [TextFile(s.uri.translate(_GLOB), s.raw_path, s.size, s.modified) for s in fs.list_files(spark, path)]
    return sorted(found, key=lambda f: (fs.part_number(f.key), f.key))


_OPEN: dict[str, LineIndex] = {}


class LineIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.lasting = True
        self._lines: dict[tuple[str, int, int], int] = {}
        if fs.exists(spark, f"{self.folder}/files"):
            for r in spark.read.parquet(f"{self.folder}/files").collect():  # as many rows as files counted
                self._lines[r["file"], r["size"], r["modified"]] = int(r["lines"])

    @staticmethod
    def open(spark: SparkSession, folder: str | None = None) -> LineIndex:
        """The index in ``folder``; without one, that of this process."""
        key = f"{spark.sparkContext.applicationId} {folder or ''}"
        if key not in _OPEN or not (folder or fs.exists(spark, _OPEN[key].folder)):
            made = folder or scratch_path(spark, "line-index")
            fs.mkdirs(spark, made)
            _OPEN[key] = LineIndex(spark, made)
            _OPEN[key].lasting = bool(folder)
        return _OPEN[key]

    # --- counts of files

    def count(self, files: list[TextFile]) -> list[int]:
        """Lines of each file; those without an entry are read."""
        new = [f for f in files if f.stamp not in self._lines]
        if new:
            raw = self.spark.read.text([f.path for f in new]).select(F.col("_metadata.file_path").alias("_file"))
            self.learn(new, {r["_file"]: r["lines"] for r in raw.groupBy("_file").agg(F.count(F.lit(1)).alias("lines")).collect()})
        return [self._lines[f.stamp] for f in files]

    def learn(self, files: list[TextFile], counted: dict[str, int]) -> None:
        """Keep the line counts of ``files``, by path as in ``_metadata.file_path``; one
        that is not in ``counted`` has no line."""
        from .text import URI_PREFIX_RX

        new = [f for f in files if f.stamp not in self._lines]
        if not new:
            return
        got = {re.sub(URI_PREFIX_RX, "", path): int(n) for path, n in counted.items()}
        for f in new:
            self._lines[f.stamp] = got.get(f.key, 0)
        if self.lasting:  # the scratch folder of a process is read by no other
            rows = [(*f.stamp, self._lines[f.stamp]) for f in new]
            table = self.spark.createDataFrame(rows, "file string, size long, modified long, lines long")
            table.coalesce(1).write.mode("append").parquet(f"{self.folder}/files")

    def holding(self, files: list[TextFile], low: int, high: int | None) -> tuple[list[TextFile], int]:
        """The files of one input that hold lines ``low`` to ``high`` (None: to the
        end), and the lines before the first of them. Files beyond are not read."""
        before, first, step = 0, 0, 1
        while first < len(files) - 1:  # the last file needs no count to be taken
            if any(f.stamp not in self._lines for f in files[first:first + step]):
                self.count(files[first:min(first + step, len(files) - 1)])
                step *= 2
            n = self._lines[files[first].stamp]
            if before + n >= low:
                break
            before, first = before + n, first + 1
        if high is None:
            return files[first:], before
        last, upto, step = first, before, 1
        while last < len(files) - 1:
            if files[last].stamp not in self._lines:
                self.count(files[last:min(last + step, len(files) - 1)])
                step *= 2
            upto += self._lines[files[last].stamp]
            if upto >= high:
                break
            last += 1
        return files[first:last + 1], before

    # --- chunk tables of scans

    def scan_path(self, groups: dict[str, str], files: dict[str, list[TextFile]]) -> str:
        """Where the chunk table of a scan of these files is kept."""
        conf = [self.spark.conf.get(name, None) for name in LAYOUT]
        told = [sorted(groups.items()), {g: [f.stamp for f in fs_] for g, fs_ in files.items()}, conf,
                self.spark.sparkContext.defaultParallelism]
        return f"{self.folder}/scans/{hashlib.sha256(json.dumps(told).encode()).hexdigest()}"
