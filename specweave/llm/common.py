"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only ``columns`` of ``df``; extra columns, whatever their names, are
    left behind before an operator adds its own."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def like(df: DataFrame, template: DataFrame) -> DataFrame:
    """``df`` with exactly the columns and types of ``template``."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in template.schema.fields])


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job started inside go when that job ends, instead of
    when the driver happens to collect its garbage. Results do not depend on it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
