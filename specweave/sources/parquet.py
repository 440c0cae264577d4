"""Typed Parquet sinks (A5-A7), their manifest, and footer row counts (A10).

A dataset that a job publishes has a *manifest*: its ``_SUCCESS`` file names the
run and, by split and in row order, every data file of it. It is written last, as
one small file, so a run that dies before leaves nothing that a reader here would
take, and no data file is ever renamed to publish it. Readers of this module take
the files that the manifest names and no others; a folder without a manifest (an
empty or no ``_SUCCESS``) is read whole, in numeric part order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fs

MANIFEST = "_SUCCESS"

# --- fixed values: output schemas (field names and types must not change) ---
HCIR_SCHEMA = T.StructType([
    T.StructField("molecular_formula", T.StringType()),
    T.StructField("h_nmr_text", T.StringType()),
    T.StructField("ir_spectra", T.ArrayType(T.FloatType())),
    T.StructField("smiles", T.StringType()),
])
MSMS_SCHEMA = T.StructType([
    T.StructField("formula", T.StringType()),
    T.StructField("smiles", T.StringType()),
    T.StructField("spectrum", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("fingerprint", T.ArrayType(T.ByteType())),
])
# ---------------------------------------------------------------------------


def ensure_empty_output(spark: SparkSession, out: str) -> None:
    """A5: create ``out`` if needed; refuse it when it already has entries.

    An existing *empty* directory is accepted, unlike ``mode('errorifexists')``.
    """
    fs.mkdirs(spark, out)
    if fs.list_names(spark, out):
        raise FileExistsError(f"output directory is not empty: {out}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to the declared schema (``split`` kept for partitioning)."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    if "split" in df.columns:
        cols.append(F.col("split"))
    return df.select(*cols)


def write_dataset(df: DataFrame, out: str, schema: T.StructType, sorted_by: list[str] | None = None,
                  max_records_per_file: int = 0, marker: bool = True) -> None:
    """Zstd Parquet, one directory per split (``split=<name>``).

    Rows keep their partitions.  ``sorted_by`` (e.g. ``["line_number",
    "energy_ord"]``) sorts inside each of them: for rows whose partitions are in
    line order already, part files then follow line order.  Those columns are
    dropped only at the final select.  ``marker=False`` leaves ``_SUCCESS`` to
    :func:`publish`.
    """
    if sorted_by:
        df = df.sortWithinPartitions("split", *sorted_by)
    writer = conform(df, schema).write.mode("append").option("compression", "zstd")
    if not marker:
        writer = writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.partitionBy("split").parquet(out)


def split_dir(out: str, split: str) -> str:
    return f"{out.rstrip('/')}/split={split}"


def data_files(spark: SparkSession, out: str, split: str) -> list[str]:
    """The files of a split as they lie in the folder, in numeric part order,
    relative to ``out``."""
    names = [s.raw_path.rsplit("/", 1)[-1] for s in fs.list_files(spark, split_dir(out, split))]
    return [f"split={split}/{n}" for n in sorted(names, key=lambda n: (fs.part_number("/" + n), n))]


def publish(spark: SparkSession, out: str, run: str, files: dict[str, list[str]]) -> None:
    """Write the manifest: from here on the dataset exists for readers."""
    fs.write_text(spark, f"{out.rstrip('/')}/{MANIFEST}", json.dumps({"run": run, "files": files}, indent=1, sort_keys=True) + "\n")


def manifest(spark: SparkSession, out: str) -> dict | None:
    """``{"run": .., "files": {split: [..]}}`` of a published dataset."""
    path = f"{out.rstrip('/')}/{MANIFEST}"
    if not fs.exists(spark, path) or not fs.size(spark, path):
        return None
    return json.loads(fs.read_text(spark, path))


def named_files(spark: SparkSession, path: str) -> tuple[list[str] | None, str]:
    """(files that the manifest names, in row order; the dataset's folder) of a
    dataset or of one split's folder in it; None without a manifest."""
    path = path.rstrip("/")
    found = manifest(spark, path)
    if found is not None:
        return [f"{path}/{f}" for split in sorted(found["files"]) for f in found["files"][split]], path
    out, _, split = path.rpartition("/split=")
    found = manifest(spark, out) if out and "/" not in split else None
    if found is None:
        return None, path
    return [f"{out}/{f}" for f in found["files"].get(split, [])], path


def read_path(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A dataset or one split's folder: what its manifest names, else all of it."""
    files, base = named_files(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if files is None:
        return reader.parquet(path)
    if not files:
        return spark.createDataFrame([], schema or spark.read.parquet(path).schema)
    return reader.option("basePath", base).parquet(*files)


def read_dataset(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """Read a dataset written by :func:`write_dataset` with its declared schema."""
    return read_path(spark, out, T.StructType(schema.fields + [T.StructField("split", T.StringType())]))


@contextmanager
def _footer_aggregates(spark: SparkSession) -> Iterator[None]:
    """Parquet through the source that answers aggregates from footers."""
    wanted = {"spark.sql.parquet.aggregatePushdown": "true"}
    sources = [x for x in spark.conf.get("spark.sql.sources.useV1SourceList").split(",") if x.strip().lower() != "parquet"]
    wanted["spark.sql.sources.useV1SourceList"] = ",".join(sources)
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def footer_counts(df: DataFrame, *by: str) -> DataFrame:
    """Row counts of a frame read inside :func:`_footer_aggregates`, by partition columns."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")) if by else df.agg(F.count(F.lit(1)).alias("rows"))


def count_rows(spark: SparkSession, path: str) -> int:
    """A10: rows of a dataset or split, answered by Parquet footers alone."""
    with _footer_aggregates(spark):
        return int(footer_counts(read_path(spark, path)).first()["rows"] or 0)  # an empty file has no count to push down


def row_counts(spark: SparkSession, out: str) -> DataFrame:
    """A10: ``(split, rows)``, answered by Parquet footers alone (one row per split)."""
    with _footer_aggregates(spark):
        rows = [(r["split"], int(r["rows"] or 0)) for r in footer_counts(read_path(spark, out), "split").collect()]
    return spark.createDataFrame(rows, "split string, rows long")


def _offsets(spark: SparkSession, df: DataFrame, files: list[str] | None) -> DataFrame:
    """``(_file, _rank, _n, _off)`` of each file, in the manifest's order or else
    in numeric part order."""
    from .text import part_number

    counts = df.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    if files is None:
        counts = counts.withColumn("_rank", part_number(F.col("_file")))
    else:  # a row per file, as in the listing
        ranks = spark.createDataFrame([("/".join(f.split("/")[-2:]), i) for i, f in enumerate(files)], "_name string, _rank long")
        counts = counts.withColumn("_name", F.regexp_extract("_file", "([^/]+/[^/]+)$", 1)).join(F.broadcast(ranks), "_name")
    before = Window.orderBy("_rank", "_file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_file", "_rank", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))


def rows_in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """Rows with their on-disk 1-based position: ``position`` follows the order of
    files (manifest, else part number) and the row index inside each file (no sort
    of the data).

    One row per file is broadcast: less than the driver's file listing."""
    files, _ = named_files(spark, path)
    df = read_path(spark, path)
    cols = df.columns
    if files == []:
        return df.withColumn("position", F.lit(1).cast("long"))
    raw = df.select(*cols, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    placed = raw.join(F.broadcast(_offsets(spark, df, files).select("_file", "_off")), "_file")
    return placed.select(*cols, (F.col("_off") + F.col("_row") + 1).alias("position"))


def first_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """F2 on a written dataset: its first ``n`` rows in on-disk order.

    Per-file row counts come from a zero-column scan (Parquet metadata);
    the running offsets over files in order select the few files
    that hold rows 1..n, and only those files are read.  The selected file list
    has at most ``n`` entries.
    """
    files, _ = named_files(spark, path)
    df = read_path(spark, path)
    if files == []:
        return df
    offs = _offsets(spark, df, files)
    needed = offs.where((F.col("_off") < n) & (F.col("_n") > 0)).orderBy("_rank", "_file").collect()
    if not needed:
        return df.limit(0)
    df = spark.read.parquet(*[r["_file"] for r in needed])
    cols = df.columns
    off = F.broadcast(spark.createDataFrame([(r["_file"], int(r["_off"])) for r in needed], "_file string, _off long"))
    raw = df.select(*cols, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return raw.join(off, "_file").where(F.col("_off") + F.col("_row") < n).select(*cols)
