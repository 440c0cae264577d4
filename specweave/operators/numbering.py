"""Exact, skew-safe row numbering without a global single-task window.

``row_number() OVER (PARTITION BY split ORDER BY key)`` puts a whole split
into one task.  Two ways avoid that:

* Even keys: the ordering key is cut into fixed-width buckets, the
  per-(group, bucket) counts are summed in bucket order on the small count
  table, and each bucket is numbered locally plus its offset.
* Uneven keys (an outlier, ties, NULL keys: the *counted* size of a bucket is
  over the bound): a range-partitioned sort by group, key and a random number,
  whose edges Spark takes from a sample, cuts the rows into equally full parts,
  equal keys as well.  It is written once; a row's number is its place in its
  part plus the rows of its group in the parts before.

So no task holds more than about ``max_rows`` rows at once in memory order,
however hot one group or one key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKET_ROWS = 1 << 20
MIN_BUCKET_ROWS = 4096


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores before them until no column of ``df`` has one."""
    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def same_on(columns: list[str], others: list[str]) -> Column:
    """NULL-safe equality of two lists of columns."""
    on = F.lit(True)
    for a, b in zip(columns, others, strict=True):
        on = on & F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))
    return on


def width_for(df: DataFrame, order_col: str, max_rows: int = MAX_BUCKET_ROWS) -> tuple[int, int]:
    """(key units per bucket, rows) for a few buckets per core, each of about
    MIN_BUCKET_ROWS to ``max_rows`` rows if keys are even: wide for sparse keys, so
    the count table stays a small fraction of the rows.  One pass over one column."""
    r = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi"), F.count(order_col).alias("n"), F.count(F.lit(1)).alias("all")).first()
    if not r["n"]:
        return max_rows, int(r["all"])
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = min(max_rows, max(MIN_BUCKET_ROWS, -(-int(r["n"]) // (4 * cores))))
    return max(1, (int(r["hi"]) - int(r["lo"]) + 1) * rows // int(r["n"])), int(r["all"])


def number_rows(df: DataFrame, group_cols: list[str], order_col: str, out_col: str = "line_number",
                bucket_width: int | None = None, materialize: bool = False, max_rows: int = MAX_BUCKET_ROWS) -> DataFrame:
    """Add a 1-based dense row number per group in ``order_col`` order.

    ``order_col`` must be an integer column.  NULL keys come first; rows of equal
    keys get consecutive numbers in any order (the same for every reader where keys
    are uneven, else as they come).
    The offset join is left to the optimiser: AQE broadcasts the count
    table when its measured size is under the broadcast threshold and
    falls back to a sort-merge join otherwise.

    The input is consumed several times (key range, counts, numbering).  For an
    expensive input pass ``materialize=True``: it is written once to the shared
    checkpoint folder and all of them read that table.
    """
    if materialize:
        from ..session import materialize as _materialize

        df = _materialize(df, "numbering-input")
    bucket_col, count_col, off_col, *offset_groups = fresh_names(df, "bucket", "count", "off", *[f"o_{c}" for c in [*group_cols, "bucket"]])
    rows = 0
    if bucket_width is None:
        bucket_width, rows = width_for(df, order_col, max_rows)
    bucket = F.floor(F.col(order_col) / F.lit(bucket_width)).cast("long")
    keyed = df.withColumn(bucket_col, bucket)
    counts = keyed.groupBy(*group_cols, bucket_col).agg(F.count(F.lit(1)).alias(count_col))
    if rows > max_rows and counts.agg(F.max(count_col)).first()[0] > max_rows:
        return number_sorted(df, group_cols, [F.col(order_col)], out_col, rows, max_rows)
    before = Window.partitionBy(*group_cols).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group_cols, bucket_col, F.coalesce(F.sum(count_col).over(before), F.lit(0)).alias(off_col))
    local = Window.partitionBy(*group_cols, bucket_col).orderBy(order_col)
    # NULL groups and NULL keys are groups and a bucket like any other
    offsets = offsets.withColumnsRenamed(dict(zip([*group_cols, bucket_col], offset_groups, strict=True)))
    return (
        keyed.join(offsets, same_on([*group_cols, bucket_col], offset_groups))
        .withColumn(out_col, (F.row_number().over(local) + F.col(off_col)).cast("long"))
        .drop(bucket_col, off_col, *offset_groups)
    )


def sorted_parts(df: DataFrame, group_cols: list[str], order: list[Column], parts: int) -> tuple[DataFrame, str, str]:
    """``df`` sorted by group and order in ``parts`` equally full parts, written once,
    and the names of two more columns: part and place in it.

    A random number splits equal keys; a part of sampled edges may hold a few times
    the mean, never all rows of a hot key.
    """
    from ..session import materialize

    part, place, salt, *keys = fresh_names(df, "part", "place", "salt", *[f"k{i}" for i in range(len(order))])
    keyed = df.withColumns({**dict(zip(keys, order, strict=True)), salt: F.rand(42)})
    dealt = keyed.repartitionByRange(max(1, parts), *group_cols, *keys, salt).sortWithinPartitions(*group_cols, *keys, salt).drop(*keys, salt)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(dealt.withColumns({part: F.spark_partition_id(), place: row}), "numbering-parts"), part, place


def number_sorted(df: DataFrame, group_cols: list[str], order: list[Column], out_col: str, rows: int, max_rows: int = MAX_BUCKET_ROWS) -> DataFrame:
    """:func:`number_rows` for keys of any distribution, by several order columns."""
    placed, part, place = sorted_parts(df, group_cols, order, -(-rows // max_rows))
    first, n, off, *offset_groups = fresh_names(placed, "first", "n", "off", *[f"o_{c}" for c in [*group_cols, "part"]])
    chunks = placed.groupBy(*group_cols, part).agg(F.min(place).alias(first), F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group_cols).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(*group_cols, part, first, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    offsets = offsets.withColumnsRenamed(dict(zip([*group_cols, part], offset_groups, strict=True)))
    return (
        placed.join(offsets, same_on([*group_cols, part], offset_groups))
        .withColumn(out_col, (F.col(off) + F.col(place) - F.col(first) + 1).cast("long"))
        .drop(part, place, first, off, *offset_groups)
    )
