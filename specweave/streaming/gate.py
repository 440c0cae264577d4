"""K1: ready gate -- a staged dataset may be read only once its non-empty
READY marker exists; we also check the marker's rows against the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as FL
from ..sources import summary as SM


class NotReady(RuntimeError):
    pass


def ready_gate(spark: SparkSession, eval_dir: str, schema=None) -> DataFrame:
    """``(split, marker_rows, actual_rows, ok)``; raises when not ready.

    One-shot check (no polling loop): a scheduler calls it again later.
    """
    if not SM.is_ready(spark, eval_dir):
        raise NotReady(f"waiting for staged data: {eval_dir}")
    marker = SM.read_ready(spark, eval_dir)
    actual = FL.read_staged(spark, eval_dir, schema).groupBy("split").agg(F.count(F.lit(1)).alias("actual_rows"))
    j = marker.join(actual, "split", "full_outer")
    return j.select("split", F.col("rows").cast("long").alias("marker_rows"),
                    F.col("actual_rows").cast("long").alias("actual_rows"),
                    (F.col("rows") == F.col("actual_rows")).alias("ok"))
