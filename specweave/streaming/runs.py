"""K2: consecutive-run detection over a stream of metric samples.

Two Structured Streaming queries, one after the other:

1. Samples, with ``foreachBatch``: every micro-batch goes through the batch
   operator (W1) as if nothing had come before, so a hot key is cut into buckets
   there as well and no Python touches the samples.  What is certain is written: the
   rows that fire in a run that began inside the batch.  The rest is one *segment*
   per key of the batch (length of its head, the run its batch begins with; whether
   that is all; the run at its end; first and last order) and the first ``n`` rows of
   each head, one of which fires if the run before is long enough.
2. Segments, with a keyed state store: per key the run open after its last
   segment and that segment's last order.  Only keys of new segments are touched,
   however many keys there have been; Python sees one row per key and batch.

With a lasting ``checkpoint`` folder a later call goes on where the last one
ended.  A micro-batch that is run again overwrites its own files, before the second
query reads them.

Lateness: per key, samples must arrive in order across micro-batches.  A sample
whose order value is not above its key's last one fails the call with
:class:`LateSampleError`: counting it in arrival order would give other runs than
the batch operator does.

``retire_after_seconds`` (timestamp orders): a key that is idle for longer starts
anew, and the store drops its state once the watermark has passed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runs import order_number, run_lengths
from ..session import scratch_path, ship_package
from ..sources import fs

SEGMENTS = "key_id string, batch long, dated boolean, first long, last long, head long, whole boolean, tail long, at timestamp"
DECISIONS = "key_id string, batch long, i long, late_at long, late_after long"
STATE = "run long, dated boolean, last long"
LATE = -1


class LateSampleError(ValueError):
    """A sample came after a later one of its key had been counted."""


def _key_id(key: str) -> Column:
    """The key as text, NULL told from any other."""
    return F.when(F.col(key).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(key).cast("string")))


def process_batch(batch: DataFrame, batch_id: int, root: str, key: str, order: str, pred: Column, n: int) -> None:
    """One micro-batch: certain firings to ``root/out``, the first rows of each head
    to ``root/heads``, segments to ``root/segments``."""
    samples = batch.select(key, order, F.coalesce(pred, F.lit(False)).alias("_idle")).withColumn("_at", order_number(batch, order))
    counted = run_lengths(samples, key, order, F.col("_idle"), reaches_back="_head").persist()
    try:
        fired = counted.where((F.col("run_length") == n) & ~F.col("_head")).select(key, order, "run_length")
        fired.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        heads = counted.where(F.col("_head") & (F.col("run_length") <= n))
        heads = heads.select(key, order, _key_id(key).alias("key_id"), F.col("run_length").alias("i"), F.lit(batch_id).cast("long").alias("batch"))
        heads.write.mode("overwrite").parquet(f"{root}/heads/b{batch_id}")
        # of samples with equal order the idle ones count last
        newest = F.struct("_at", "_idle", "run_length")
        stamp = F.max(F.col(order)) if isinstance(batch.schema[order].dataType, T.TimestampType) else F.lit(None)
        segments = counted.groupBy(_key_id(key).alias("key_id")).agg(
            F.max("_at").isNotNull().alias("dated"), F.coalesce(F.min("_at"), F.lit(0)).alias("first"), F.coalesce(F.max("_at"), F.lit(0)).alias("last"),
            F.coalesce(F.max(F.when(F.col("_head"), F.col("run_length"))), F.lit(0)).alias("head"),
            (F.count_if(~F.col("_idle")) == 0).alias("whole"), F.max_by("run_length", newest).alias("tail"), stamp.cast("timestamp").alias("at"))
        segments = segments.withColumn("batch", F.lit(batch_id).cast("long"))
        names = [f.split()[0] for f in SEGMENTS.split(", ")]
        segments.select(*names).write.mode("overwrite").parquet(f"{root}/segments/b{batch_id}")
    finally:
        counted.unpersist()


def _fold(n: int, retire_micros: int | None):
    """Segments of one key into its state, and which row of each head fires."""
    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        count, dated, last = state.get if state.exists else (0, False, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values("batch").itertuples():
            if dated and r.dated and r.first <= last:
                out.append((key[0], r.batch, LATE, r.first, last))
            if retire_micros is not None and dated and r.dated and r.first - last > retire_micros:
                count = 0
            if count < n <= count + r.head:
                out.append((key[0], r.batch, n - count, 0, 0))
            count = int(count + r.head if r.whole else r.tail)
            if r.dated:
                dated, last = True, max(int(r.last), last) if dated else int(r.last)
        state.update((count, dated, last))
        if retire_micros is not None and dated:
            due = (last + retire_micros) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in DECISIONS.split(", ")])

    return run


def _check_settings(spark: SparkSession, root: str, settings: dict) -> None:
    """A checkpoint goes on with the settings it was begun with."""
    path = f"{root}/settings.json"
    if not fs.exists(spark, path):
        fs.mkdirs(spark, root)
        fs.write_text(spark, path, json.dumps(settings, sort_keys=True))
    elif json.loads(fs.read_text(spark, path)) != settings:
        raise ValueError(f"the checkpoint {root} was begun with other settings")


def consecutive_runs_stream(spark: SparkSession, path: str, key: str, order: str, pred_sql: str, n: int = 3,
                            max_files_per_trigger: int | None = None, checkpoint: str | None = None,
                            retire_after_seconds: int | None = None) -> DataFrame:
    """Run K2 over the new Parquet files at ``path`` to completion (``availableNow``)
    and return all firings so far as a batch DataFrame.

    ``max_files_per_trigger`` bounds a micro-batch.  ``checkpoint`` names a lasting
    folder (shared by the cluster); without it each call starts from nothing.
    """
    schema = spark.read.parquet(path).schema
    if n <= 0:
        raise ValueError("n must be positive")
    if retire_after_seconds is not None and not isinstance(schema[order].dataType, T.TimestampType):
        raise ValueError("retiring keys needs an order of type timestamp")
    if fs.is_file(spark, path):
        # The file source wants a directory or a glob; a one-character
        # class makes a glob that matches exactly this file.
        path = path[:-1] + "[" + path[-1] + "]"
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    root = (checkpoint or scratch_path(spark, "runs-stream")).rstrip("/")
    _check_settings(spark, root, {"key": key, "order": order, "predicate": pred_sql, "n": n, "retire_after_seconds": retire_after_seconds})
    for name in ("out", "heads", "segments"):
        fs.mkdirs(spark, f"{root}/{name}")

    def one(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, root, key, order, F.expr(pred_sql), n)

    samples = reader.parquet(path).writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/checkpoint")
    samples.trigger(availableNow=True).start().awaitTermination()
    kinds = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in (key, order))
    if not fs.list_names(spark, f"{root}/segments"):
        return spark.createDataFrame([], f"{kinds}, run_length long")
    segments = spark.readStream.schema(SEGMENTS).option("recursiveFileLookup", "true").parquet(f"{root}/segments")
    ship_package(spark)
    micros, timeout = None, GroupStateTimeout.NoTimeout
    if retire_after_seconds is not None:
        segments = segments.withWatermark("at", f"{retire_after_seconds} seconds")
        micros, timeout = retire_after_seconds * 1_000_000, GroupStateTimeout.EventTimeTimeout
    decided = segments.groupBy("key_id").applyInPandasWithState(_fold(n, micros), DECISIONS, STATE, "append", timeout)
    folding = decided.writeStream.format("parquet").option("path", f"{root}/decisions").option("checkpointLocation", f"{root}/state")
    folding.trigger(availableNow=True).start().awaitTermination()
    decisions = spark.read.schema(DECISIONS).parquet(f"{root}/decisions")
    late = decisions.where(F.col("i") == LATE).orderBy("batch", "key_id").limit(1).collect()
    if late:
        raise LateSampleError(_late_text(late[0], schema[order].dataType))
    certain = spark.read.schema(f"{kinds}, run_length long").parquet(f"{root}/out").select(key, order, "run_length")
    heads = spark.read.schema(f"{kinds}, key_id string, i long, batch long").option("recursiveFileLookup", "true").parquet(f"{root}/heads")
    fired = heads.join(decisions.select("key_id", "batch", "i"), ["key_id", "batch", "i"])
    return certain.unionByName(fired.select(key, order, F.lit(n).cast("long").alias("run_length")))


def _late_text(row, kind: T.DataType) -> str:
    import datetime as dt

    def told(value: int):
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=value)
        return dt.date(1970, 1, 1) + dt.timedelta(days=value) if isinstance(kind, T.DateType) else value

    name = None if row["key_id"] == "-" else row["key_id"][1:]
    return f"key {name!r}: sample at {told(row['late_at'])} after one at {told(row['late_after'])}"
