"""Line-aligned text sources (A1, A2, A4) and the positional join.

Line numbers without a global sort
----------------------------------
Spark splits text files into byte ranges.  Inside one split, rows arrive in
file order, and ``monotonically_increasing_id`` (evaluated directly above
the scan) counts them.  A *chunk table* -- one row per (file, split start):
line count and first id -- is summed in file order to give each chunk its
first line number; every line then gets ``offset + (id - first id) + 1``.

The chunk table is written once, kept in the line index
(:mod:`specweave.sources.line_index`) and always broadcast.  Its rows are a few
longs, one per file and scan split, so it is smaller than the file listing
that the driver holds before such a scan can start, whatever the input.  A
line whose chunk is not in the table (the scan was split differently in
between) fails the job instead of losing lines.

File order is numeric: ``part-100000`` follows ``part-99999``.

Alignment
---------
The chunk table also gives the number of lines, so lines are dealt to
partitions by ``(line_number - 1) div lines_per_partition``: one exchange
brings both sides of a line together *and* keeps line order, and partitions
hold equally many lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import SPLITS
from . import fs
from .line_index import LineIndex, text_files

# Bytes of text per partition of the alignment, and of written text files.
TARGET_PARTITION_BYTES = 128 << 20
# Beyond this many partitions they grow instead (a sort spills): a shuffle keeps
# a size per map task and partition, which the driver must hold.
MAX_PARTITIONS = 20_000


def part_number(path: Column) -> Column:
    """Numeric id of a part file written by Spark, -1 for any other name."""
    return F.coalesce(F.regexp_extract(path, r"/part-(\d{1,18})[^/]*$", 1).try_cast("long"), F.lit(-1).cast("long"))


def chunk_offsets(df: DataFrame, row_col: str, group_cols: list[str]) -> DataFrame:
    """``(group.., _file, _file_key, _block, _part_id, _first, _n, _off)`` of each chunk.

    ``df`` has ``_file``, ``_block`` and ``_part_id`` (scan partition); chunks
    are ordered by part number, file name and block.
    """
    keys = [*group_cols, "_file", "_block", "_part_id"]
    chunks = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(row_col).alias("_first"))
    # One row per file and scan split: an ordered window over it is cheap.
    before = Window.partitionBy(*group_cols).orderBy(part_number(F.col("_file")), "_file", "_block", "_part_id").rowsBetween(
        Window.unboundedPreceding, -1)
    return chunks.select(
        *group_cols, "_file", F.xxhash64("_file").alias("_file_key"), "_block", "_part_id", "_first", "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))


def number_chunks(df: DataFrame, offsets: DataFrame, row_col: str, out_col: str = "line_number") -> DataFrame:
    """Turn a within-chunk position into a global 1-based position.

    ``row_col`` increases by one per row inside a chunk; ``offsets`` comes from
    :func:`chunk_offsets` over the same scan.
    """
    table = offsets.select("_file_key", "_block", "_part_id", "_first", "_off")
    keyed = df.withColumn("_file_key", F.xxhash64("_file"))
    joined = keyed.join(F.broadcast(table), ["_file_key", "_block", "_part_id"], "left")
    lost = F.raise_error(F.concat(F.lit("the scan was split differently while numbering lines of "), F.col("_file")))
    number = F.coalesce(F.col("_off"), lost) + F.col(row_col) - F.col("_first") + F.lit(1)
    return joined.withColumn(out_col, number.cast("long")).drop("_off", "_first", "_file_key", "_file", "_block", "_part_id", row_col)


def _qualified(spark: SparkSession, path: str) -> str:
    """Encoded path component of the qualified URI (spaces -> %20), as in
    ``_metadata.file_path``; scheme and authority are compared separately
    spelled (``file:/`` vs ``file:///``), so they are left out."""
    fsys, p = fs._fs(spark, path)
    return str(fsys.makeQualified(p).toUri().getRawPath()).rstrip("/")


URI_PREFIX_RX = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"


#: Lines ``low`` to ``high`` (both included; None: to the end).
Range = tuple[int, int | None]


def line_groups(spark: SparkSession, groups: dict[str, str], value_col: str = "value", ranges: dict[str, Range] | None = None,
                index: LineIndex | None = None) -> tuple[DataFrame, dict[str, int], int]:
    """``(group, line_number, value)`` of several text inputs, the number of the
    last line of each (that is read), and the bytes of the files read.

    ``groups`` maps a name to a text file or a directory of part files; each
    group is numbered on its own, across its part files in file order.  The
    text is read twice: once for the chunk table (unless the line index has it),
    once for the lines.  ``ranges`` limits groups to some of their lines; then
    only files that hold these are read.
    """
    index = index or LineIndex.open(spark)
    names = list(groups)
    prefixes = {g: _qualified(spark, groups[g]) for g in names}
    files = {g: text_files(spark, groups[g]) for g in names}
    before = dict.fromkeys(names, 0)
    paths = [groups[g] for g in names]
    if ranges:
        for g, (low, high) in ranges.items():
            files[g], before[g] = index.holding(files[g], low, high)
        paths = [f.path for g in names for f in files[g]]
    lines = dict(before)
    if not any(files.values()):
        empty = spark.createDataFrame([], f"group string, line_number long, {value_col} string")
        return empty, lines, 0
    raw = spark.read.text(paths).select(
        F.col("value").alias(value_col),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.spark_partition_id().alias("_part_id"),
        F.monotonically_increasing_id().alias("_row"),
    )
    group = None
    file_path = F.regexp_replace(F.col("_file"), URI_PREFIX_RX, "")
    for g in names:
        hit = (file_path == prefixes[g]) | file_path.startswith(prefixes[g] + "/")
        group = F.when(hit, F.lit(g)) if group is None else group.when(hit, F.lit(g))
    # Every scanned file belongs to exactly one group; anything else is a bug
    # that would silently drop lines, so it fails the job instead.
    raw = raw.withColumn("group", F.coalesce(group, F.raise_error(F.concat(
        F.lit("input file outside every group: "), F.col("_file")))))
    kept = index.scan_path(groups, files)
    if not fs.exists(spark, f"{kept}/_SUCCESS"):
        chunk_offsets(raw, "_row", ["group"]).write.mode("overwrite").option("compression", "zstd").parquet(kept)
    offsets = spark.read.parquet(kept)
    counts = offsets.groupBy("group", "_file").agg(F.sum("_n").alias("n")).collect()  # a row per file, as in the listing
    index.learn([f for g in names for f in files[g]], {r["_file"]: r["n"] for r in counts})
    for r in counts:
        lines[r["group"]] += int(r["n"])
    numbered = number_chunks(raw, offsets, "_row").select("group", "line_number", value_col)
    if ranges:
        skipped, wanted = F.lit(0), F.lit(True)
        for g, (low, high) in ranges.items():
            skipped = F.when(F.col("group") == g, F.lit(before[g])).otherwise(skipped)
            inside = (F.col("line_number") >= low) if high is None else F.col("line_number").between(low, high)
            wanted = F.when(F.col("group") == g, inside).otherwise(wanted)
            lines[g] = lines[g] if high is None else min(lines[g], high)
        numbered = numbered.withColumn("line_number", (F.col("line_number") + skipped).cast("long")).where(wanted)
    return numbered, lines, sum(f.size for g in names for f in files[g])


def read_line_groups(spark: SparkSession, groups: dict[str, str], value_col: str = "value") -> DataFrame:
    """The lines of :func:`line_groups`."""
    return line_groups(spark, groups, value_col)[0]


def read_lines(spark: SparkSession, path: str, value_col: str = "value") -> DataFrame:
    """A2: ``(line_number, value)`` for a text file or a directory of part files.

    Lines are numbered across part files in numeric part order, as if the
    parts were concatenated.  Line breaks: ``\\n``, ``\\r\\n``, ``\\r``.
    """
    return read_line_groups(spark, {"_": path}, value_col).select("line_number", value_col)


def split_paths(view: str, split: str) -> tuple[str, str]:
    stem = SPLITS[split]
    base = f"{view.rstrip('/')}/data"
    return f"{base}/src-{stem}.txt", f"{base}/tgt-{stem}.txt"


def require_inputs(spark: SparkSession, view: str, kind: str = "hcir") -> dict[str, tuple[str, str]]:
    """A4: every split needs both files; checked for all splits up front."""
    paths = {}
    for split in SPLITS:
        src, tgt = split_paths(view, split)
        if not fs.is_readable_input(spark, src) or not fs.is_readable_input(spark, tgt):
            if kind == "hcir":
                raise FileNotFoundError(f"missing {split} source/target files")
            raise FileNotFoundError(f"missing aligned files for {split}")
        paths[split] = (src, tgt)
    return paths


def partitions_for(spark: SparkSession, total: int) -> int:
    """Partitions of about 128 MB for so many bytes, at least the default and
    at most MAX_PARTITIONS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_PARTITIONS, -(-total // TARGET_PARTITION_BYTES)))


def align(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """D1 on tables of unknown line counts: zip-longest = full outer join on
    ``(split, line_number)``.  Keys are unique, so there is no skew."""
    return src.join(tgt, ["split", "line_number"], "full_outer")


def align_lines(src: DataFrame, tgt: DataFrame, ranges: dict[str, tuple[int, int]], n_partitions: int) -> DataFrame:
    """D1 in line order with one exchange.

    ``ranges`` bounds the line numbers of each split.  Both sides go to the
    partition of their line; there a sorted aggregate pairs the at most two
    rows of a line.  Partitions in order hold the splits in order, and each
    is sorted by line.  Further columns of ``tgt`` come along.
    """
    size = {s: max(0, high - low + 1) for s, (low, high) in ranges.items()}
    per = max(1, -(-sum(size.values()) // n_partitions))
    bucket, total = F.lit(0), 0
    for split in [s for s in SPLITS if s in ranges]:
        here = F.lit(total) + F.floor((F.col("line_number") - F.lit(ranges[split][0])) / F.lit(per))
        bucket = F.when(F.col("split") == split, here).otherwise(bucket)
        total += max(1, -(-size[split] // per))
    keys = ["split", "line_number"]
    both = src.unionByName(tgt, allowMissingColumns=True).withColumn("_bucket", bucket.cast("int"))
    values = [c for c in both.columns if c not in (*keys, "_bucket")]
    dealt = both.repartitionById(max(1, total), F.col("_bucket"))
    paired = dealt.groupBy(*keys, "_bucket").agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])
    return paired.drop("_bucket")


def read_aligned(spark: SparkSession, view: str, *args, **kwargs) -> DataFrame:
    """A1: the lines of :func:`read_aligned_spans`."""
    return read_aligned_spans(spark, view, *args, **kwargs)[0]


def read_aligned_spans(spark: SparkSession, view: str, splits=None, max_molecules: int = 0,
                       with_target: Callable[[DataFrame, int], DataFrame] | None = None, ranges: dict[str, Range] | None = None,
                       index: LineIndex | None = None, only: Column | None = None) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """A1: ``(split, line_number, source, target)`` for all splits of a view,
    in line order, and the first and last line of each split that is read.

    All source files are read by one scan, all target files by another.  With
    ``max_molecules`` N, lines up to N+1 are read: alignment is checked up to
    line N+1 and lines up to N are parsed.  ``ranges`` names the lines of each
    split to read instead (splits it leaves out are not read).  Either way, files
    without such lines are skipped.  ``only`` is a predicate on split and line
    number, ``with_target`` may add columns to the target lines, whose number (at
    most) it is told; both come before the shuffle.
    """
    if ranges is None and max_molecules:
        ranges = {s: (1, max_molecules + 1) for s in splits or SPLITS}
    splits = list(splits or (SPLITS if ranges is None else ranges))
    paths = {split: split_paths(view, split) for split in splits}
    src, src_last, src_bytes = line_groups(spark, {s: p[0] for s, p in paths.items()}, "source", ranges, index)
    tgt, tgt_last, tgt_bytes = line_groups(spark, {s: p[1] for s, p in paths.items()}, "target", ranges, index)
    src = src.withColumnRenamed("group", "split")
    tgt = tgt.withColumnRenamed("group", "split")
    spans = {s: (ranges[s][0] if ranges else 1, max(src_last[s], tgt_last[s])) for s in splits}
    if only is not None:
        src, tgt = src.where(only), tgt.where(only)
    if with_target is not None:
        tgt = with_target(tgt, sum(max(0, high - low + 1) for low, high in spans.values()))
    return align_lines(src, tgt, spans, partitions_for(spark, src_bytes + tgt_bytes)), spans


def line_waves(spark: SparkSession, view: str, index: LineIndex, first_bytes: int, growth: int = 4) -> Iterator[dict[str, Range] | None]:
    """Consecutive ranges of lines of a view, in order of splits and lines: the
    first ones of about ``first_bytes`` of source text (at least a 64th), each
    further one ``growth`` times as much, cut at source files. Files are counted
    when their wave comes. One wave without ranges (None) for a smaller view."""
    files = {s: text_files(spark, split_paths(view, s)[0]) for s in SPLITS}
    total = sum(f.size for fs_ in files.values() for f in fs_)
    if total <= first_bytes:
        yield None
        return
    size, held, wave = max(first_bytes, total // 64), 0, {}
    for split in SPLITS:
        low, pending = 1, []
        for f in files[split][:-1]:
            pending.append(f)
            held += f.size
            if held >= size:
                n = sum(index.count(pending))
                if n:
                    yield wave | {split: (low, low + n - 1)}
                    low, size, held, wave = low + n, size * growth, 0, {}
                pending = []
        wave[split] = (low, None)
        held += files[split][-1].size if files[split] else 0
    yield wave


def write_text_view(df: DataFrame, view: str, parts: int | None = None) -> None:
    """Write ``(split, line_number, source, target)`` as a text view.

    Each split becomes ``src-<stem>.txt`` / ``tgt-<stem>.txt`` directories
    of part files, range-partitioned on line number (by the session's shuffle
    partitions, or ``parts`` of them) so that part files, in order, hold
    consecutive lines.  One write per side (partitioned by
    split, then renamed); rows with a NULL side are skipped on that side.
    """
    base = view.rstrip("/")
    fs.mkdirs(spark_of(df), f"{base}/data")
    for col, prefix in (("source", "src"), ("target", "tgt")):
        tmp = f"{base}/_{prefix}"
        (
            df.where(F.col(col).isNotNull())
            .select("split", "line_number", F.col(col).alias("value"))
            .repartitionByRange(*([parts * len(SPLITS)] if parts else []), "split", "line_number")
            .sortWithinPartitions("split", "line_number")
            .select("split", "value")
            .write.mode("errorifexists").partitionBy("split").text(tmp)
        )
        for split, stem in SPLITS.items():
            target = f"{base}/data/{prefix}-{stem}.txt"
            if fs.exists(spark_of(df), f"{tmp}/split={split}"):
                fs.rename(spark_of(df), f"{tmp}/split={split}", target)
            else:
                fs.mkdirs(spark_of(df), target)


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession
