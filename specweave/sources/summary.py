"""Summary and ready-marker sinks/sources.

The summary is the commit marker: it is written last, after every data
file and after verification, as one small JSON file (sorted keys, indent
2).  Its numbers come from Spark aggregates; only that aggregate result
(a handful of values) is brought to the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fs
from .parquet import manifest

SUMMARY_FILE = "summary.json"
READY_FILE = "READY.json"
SUCCESS_FILE = "_SUCCESS"


def dumps(obj) -> str:
    return json.dumps(obj, indent=2, sort_keys=True) + "\n"


def write_summary(spark: SparkSession, out: str, summary: dict) -> str:
    """``<out>/summary.json`` (atomic rename)."""
    path = f"{out.rstrip('/')}/{SUMMARY_FILE}"
    fs.write_text(spark, path, dumps(summary))
    return path


def summary_json(df: DataFrame, key: str = "split") -> DataFrame:
    """A8 as a DataFrame: one JSON text per ``key`` with fields in sorted order."""
    fields = sorted(c for c in df.columns if c != key)
    return df.select(F.col(key), F.to_json(F.struct(*[F.col(c) for c in fields])).alias("summary_json"))


HCIR_SPLIT_SCHEMA = T.StructType([
    T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("ir_lengths", T.MapType(T.StringType(), T.LongType())),
    T.StructField("elapsed_seconds", T.DoubleType()),
])


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    """The summary as a one-row DataFrame (multi-line JSON source)."""
    return spark.read.option("multiLine", True).json(f"{out.rstrip('/')}/{SUMMARY_FILE}")


def split_summaries(spark: SparkSession, out: str) -> DataFrame:
    """``(split, counts map, ir_lengths map)`` rows from a summary file."""
    text = spark.read.text(f"{out.rstrip('/')}/{SUMMARY_FILE}", wholetext=True)
    schema = T.StructType([T.StructField("splits", T.MapType(T.StringType(), HCIR_SPLIT_SCHEMA))])
    parsed = text.select(F.from_json("value", schema).alias("s"))
    return parsed.select(F.explode("s.splits").alias("split", "v")).select(
        "split", F.col("v.counts").alias("counts"), F.col("v.ir_lengths").alias("ir_lengths")
    )


def write_ready(spark: SparkSession, out: str, rows: dict[str, int]) -> str:
    """``READY.json`` with the verified per-split row counts."""
    path = f"{out.rstrip('/')}/{READY_FILE}"
    fs.write_text(spark, path, json.dumps({"rows": rows}, indent=2) + "\n")
    return path


def read_ready(spark: SparkSession, out: str) -> DataFrame:
    """``(split, rows)`` from a ready marker."""
    text = spark.read.text(f"{out.rstrip('/')}/{READY_FILE}", wholetext=True)
    parsed = text.select(F.from_json("value", "rows map<string,bigint>").alias("r"))
    return parsed.select(F.explode("r.rows").alias("split", "rows"))


def is_ready(spark: SparkSession, out: str) -> bool:
    """Non-empty READY.json exists (the reference's gate test)."""
    path = f"{out.rstrip('/')}/{READY_FILE}"
    return fs.exists(spark, path) and fs.size(spark, path) > 0


def is_complete(spark: SparkSession, out: str, require_nonempty: bool = True) -> bool:
    """A dataset is complete when its write succeeded (``_SUCCESS``) and
    its summary exists (and is non-empty).

    A non-empty directory without them is an interrupted run: the caller must
    refuse it rather than append to it. A manifest in ``_SUCCESS`` must be of the
    summary's run.
    """
    path = f"{out.rstrip('/')}/{SUMMARY_FILE}"
    if not fs.exists(spark, path) or not fs.exists(spark, f"{out.rstrip('/')}/{SUCCESS_FILE}"):
        return False
    named = manifest(spark, out)
    if named is not None and fs.size(spark, path) and json.loads(fs.read_text(spark, path)).get("run") != named["run"]:
        return False
    return fs.size(spark, path) > 0 if require_nonempty else True


def check_resumable(spark: SparkSession, out: str) -> bool:
    """True when conversion must run; raises on an incomplete non-empty dir."""
    if is_complete(spark, out):
        return False
    if fs.list_names(spark, out):
        raise FileExistsError(f"incomplete non-empty output directory: {out}")
    return True
