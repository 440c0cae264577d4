"""Binary-file hashing (A11) and zero-copy staged datasets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fs
from .parquet import read_path

STAGE_MANIFEST = "_staged.json"


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of whole files via the ``binaryFile`` source."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path"), F.sha2(F.col("content"), 256).alias("sha256")
    )


def sha256_text(df: DataFrame, col: str) -> DataFrame:
    """A11 on a string column (UTF-8 bytes)."""
    return df.withColumn("sha256", F.sha2(F.col(col), 256))


def stage_dataset(spark: SparkSession, eval_dir: str, members: dict[str, str]) -> None:
    """Publish splits of other datasets without copying them.

    ``members`` maps split -> directory holding that split's Parquet files.
    The staged dataset is a manifest of paths; readers union them.
    """
    fs.mkdirs(spark, eval_dir)
    fs.write_text(spark, f"{eval_dir.rstrip('/')}/{STAGE_MANIFEST}", json.dumps(members, indent=2, sort_keys=True) + "\n")


def staged_members(spark: SparkSession, eval_dir: str) -> dict[str, str]:
    return json.loads(fs.read_text(spark, f"{eval_dir.rstrip('/')}/{STAGE_MANIFEST}"))


def read_staged(spark: SparkSession, eval_dir: str, schema=None) -> DataFrame:
    """H1: the union of a staged dataset's splits, with a ``split`` column."""
    members = staged_members(spark, eval_dir)
    out = None
    for split in sorted(members):
        part = read_path(spark, members[split], schema).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out
