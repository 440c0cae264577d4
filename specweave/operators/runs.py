"""Consecutive-run detection (W1) with the idle predicate.

Semantics: per key, in order, a counter goes +1 when the predicate holds
and back to 0 otherwise; a row *fires* when the counter reaches ``n``.

A plain ``Window.partitionBy(key)`` would put a hot key (a third of all
rows) into one task.  Instead each key's sequence is cut into buckets of
the order column, runs are measured inside buckets, and the run
length carried into each bucket is a segmented prefix sum over the small
per-bucket summary table.  The result is exact.  Where a bucket's counted
size is over the bound (an outlier in the order, ties, NULL orders), the rows
of each key are first numbered by a range-partitioned sort, and the buckets
are cut from these numbers, so they are equally full.

Keys may be of any type; NULL keys form a key of their own, and rows with a
NULL order form a bucket of their own before all others.  The order is an
integer, a date or a timestamp; rows of one key with equal order values are
taken in the order of the predicate (false first), so the result is the same
whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import fresh_names, number_sorted

DEFAULT_BUCKET_WIDTH = 1 << 20


def idle_predicate(memory: Column, util: Column, max_memory_mib: float = 1000, max_util_percent: float = 10) -> Column:
    """``memory <= M and util <= U`` (launcher defaults 1000 MiB, 10 %)."""
    return (memory <= F.lit(max_memory_mib)) & (util <= F.lit(max_util_percent))


def order_number(df: DataFrame, order: str) -> Column:
    """The order as a long: microseconds of a timestamp, days of a date."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(order)).cast("long")
    return F.col(order).cast("long")


def bucket_width_for(df: DataFrame, order: str, rows_per_bucket: int = DEFAULT_BUCKET_WIDTH) -> tuple[int, int]:
    """(order units per bucket, rows) for about ``rows_per_bucket`` rows of all keys
    together, so sparse orders (microseconds) don't make a bucket per row."""
    r = df.select(order_number(df, order).alias("o")).agg(
        F.min("o").alias("lo"), F.max("o").alias("hi"), F.count("o").alias("n"), F.count(F.lit(1)).alias("all")).first()
    if not r["n"]:
        return rows_per_bucket, int(r["all"])
    return max(1, (int(r["hi"]) - int(r["lo"]) + 1) * rows_per_bucket // int(r["n"])), int(r["all"])


def _overfull(d: DataFrame, key: str, bucket: str, bound: int) -> bool:
    """Is a bucket of one key over the bound? Counted for all keys together first:
    that is one number per bucket, and mostly says no."""
    def largest(*by: str) -> int:
        return d.groupBy(*by).count().agg(F.max("count")).first()[0] or 0

    return largest(bucket) > bound and largest(key, bucket) > bound


def run_lengths(df: DataFrame, key: str, order: str, pred: Column, bucket_width: int | None = None, carry: DataFrame | None = None,
                rows_per_bucket: int = DEFAULT_BUCKET_WIDTH, reaches_back: str | None = None) -> DataFrame:
    """Add ``run_length``: the counter value after each row.

    ``bucket_width`` counts order units; by default it follows the data, for
    about ``rows_per_bucket`` rows, and no bucket of a key holds over four times
    as many.  ``carry`` (``key, run``) holds the runs open before the first row.
    ``reaches_back`` names a further column: the row's run begins with its key's
    first row.
    """
    p, o, b, rn, last, k, cb, brought, whole = fresh_names(df, "p", "o", "b", "rn", "last_break", "k", "cb", "carry", "whole")
    d = df.withColumns({p: F.coalesce(pred, F.lit(False)), o: order_number(df, order)})
    width, rows = (bucket_width, 0) if bucket_width else bucket_width_for(df, order, rows_per_bucket)

    def bucketed(d: DataFrame, width: int) -> DataFrame:
        return d.withColumn(b, F.coalesce(F.floor(F.col(o) / F.lit(width)).cast("long"), F.lit(-(1 << 62))))

    cut = bucketed(d, width)
    if rows > 4 * rows_per_bucket and _overfull(cut, key, b, 4 * rows_per_bucket):
        (number,) = fresh_names(d, "number")
        numbered = number_sorted(d, [key], [F.col(o), F.col(p)], number, rows, rows_per_bucket)
        cut = bucketed(numbered.withColumn(o, F.col(number)).drop(number), rows_per_bucket)
    d = cut
    w = Window.partitionBy(key, b).orderBy(o, p)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn(rn, F.row_number().over(w)).withColumn(last, F.max(F.when(~F.col(p), F.col(rn))).over(upto))
    # Per-bucket summary: rows, and the run still open at the bucket's end.
    narrow = d.select(F.col(key).alias(k), F.col(b).alias(cb), F.col(p).alias("_p"), F.col(rn).alias("_rn"))
    chunks = narrow.groupBy(k, cb).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(~F.col("_p"), F.col("_rn"))).alias("_lb"),
    ).select(
        k, cb,
        F.col("_lb").isNull().alias("_all"),
        F.when(F.col("_lb").isNull(), F.col("_n")).otherwise(F.col("_n") - F.col("_lb")).cast("long").alias("_contrib"),
    )
    if carry is not None:  # as a bucket before all others
        chunks = chunks.unionByName(carry.select(
            F.col(key).alias(k), F.lit(-(1 << 62) - 1).alias(cb), F.lit(False).alias("_all"), F.col("run").cast("long").alias("_contrib")))
    seq = Window.partitionBy(k).orderBy(cb)
    chunks = chunks.withColumn(
        "_seg", F.sum(F.when(F.col("_all"), 0).otherwise(1)).over(seq.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn(
        "_end", F.sum("_contrib").over(Window.partitionBy(k, "_seg").orderBy(cb).rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn(brought, F.coalesce(F.lag("_end").over(seq), F.lit(0))).select(
        k, cb, brought, F.coalesce(F.lag("_seg").over(seq) == 0, F.lit(True)).alias(whole))
    joined = d.join(chunks, F.col(key).eqNullSafe(F.col(k)) & (F.col(b) == F.col(cb)))
    run = F.when(
        F.col(p),
        F.when(F.col(last).isNull(), F.col(brought) + F.col(rn)).otherwise(F.col(rn) - F.col(last)),
    ).otherwise(F.lit(0))
    joined = joined.withColumn("run_length", run.cast("long"))
    if reaches_back:
        joined = joined.withColumn(reaches_back, F.col(p) & F.col(last).isNull() & F.col(whole))
    return joined.drop(p, o, b, rn, last, brought, k, cb, whole)


def consecutive_runs(df: DataFrame, key: str, order: str, pred: Column, n: int = 3,
                     bucket_width: int | None = None) -> DataFrame:
    """The rows at which a key's run of predicate-true samples reaches ``n``."""
    if n <= 0:
        raise ValueError("n must be positive")
    return run_lengths(df, key, order, pred, bucket_width).where(F.col("run_length") == n)
