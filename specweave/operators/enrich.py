"""Molecule enrichment (D2, U1) with its two rules.

The original computes canonical SMILES, a 128-bit fingerprint and a formula
per molecule with a chemistry library.  Here they come from a supplied
reference table ``(smiles, canonical_smiles, fingerprint, formula)``; users
with a chemistry toolkit build that table once over
``df.select('smiles').distinct()`` with their own pandas UDF.

Join strategy: none is forced.  AQE measures the reference side and
broadcasts it where it is small; otherwise the left join is a sort-merge join
whose skew handling splits a hot SMILES (one molecule may be a third of all
rows) across tasks.

A reference that serves several conversions can be stored once, bucketed and
sorted by SMILES (:func:`store_reference`): then only the target lines are
exchanged, to the buckets.  AQE splits no bucket, so hot SMILES, found in a sample
of the lines, are joined by a broadcast of their reference rows instead: at most
HOT_PER_BUCKET of them for each bucket.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fs
from .rules import MSG_UNKNOWN_MOLECULE, _err

FINGERPRINT_BITS = 128
REFERENCE_COLUMNS = ("smiles", "canonical_smiles", "fingerprint", "formula")
BUCKETS_FILE = "_buckets.json"
HOT_PER_BUCKET = 4
HOT_SAMPLE_ROWS = 1_000_000


class ReferenceTableError(ValueError):
    """The reference table breaks its contract."""


def check_reference(ref: DataFrame) -> None:
    """One row per SMILES; no NULLs; fingerprints of 128 bits.

    Raises :class:`ReferenceTableError`: a duplicate would multiply molecules, a
    NULL would be written as data.
    """
    bad = ref.agg(
        F.count_if(F.col("smiles").isNull()).alias("smiles"),
        F.count_if(F.col("canonical_smiles").isNull()).alias("canonical_smiles"),
        F.count_if(F.col("formula").isNull()).alias("formula"),
        F.count_if(F.coalesce(F.size("fingerprint") != FINGERPRINT_BITS, F.lit(True))).alias("fingerprint"),
    ).first().asDict()
    for column, n in bad.items():
        if n:
            what = f"without {FINGERPRINT_BITS} bits" if column == "fingerprint" else "NULL"
            raise ReferenceTableError(f"molecule reference: {n} rows with {column} {what}")
    twice = ref.groupBy("smiles").count().where("count > 1").orderBy("smiles").limit(1).collect()
    if twice:
        raise ReferenceTableError(f"molecule reference: {twice[0]['count']} rows for SMILES {twice[0]['smiles']!r}")


def attach_reference(df: DataFrame, ref: DataFrame, smiles_col: str) -> DataFrame:
    """Left-join the reference: ``_canonical, _fp, ref_formula, _known``.

    Precondition: ``ref`` is unique on ``smiles`` (:func:`check_reference`).
    """
    r = ref.select(
        F.col("smiles").alias("_ref_smiles"),
        F.col("canonical_smiles").alias("_canonical"),
        F.col("fingerprint").alias("_fp"),
        F.col("formula").alias("ref_formula"),
        F.lit(True).alias("_known"),
    )
    return df.join(r, F.col(smiles_col) == F.col("_ref_smiles"), "left").drop("_ref_smiles")


def store_reference(ref: DataFrame, path: str, buckets: int) -> None:
    """Check the reference and write it to the folder ``path``, bucketed and sorted by
    SMILES; as many buckets as a conversion shuffles to are best."""
    spark = ref.sparkSession
    if buckets < 1:
        raise ValueError("buckets must be positive")
    if fs.list_names(spark, path):
        raise FileExistsError(f"output directory is not empty: {path}")
    check_reference(ref)
    table = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    writer = ref.select(*REFERENCE_COLUMNS).repartition(buckets, "smiles").write.bucketBy(buckets, "smiles").sortBy("smiles")
    writer.option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ref.select(*REFERENCE_COLUMNS).schema.fields)
    fs.write_text(spark, f"{path.rstrip('/')}/{BUCKETS_FILE}", json.dumps({"buckets": buckets, "schema": schema}))


def _table_name(path: str) -> str:
    return "specweave_reference_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:16]


def stored_buckets(spark: SparkSession, path: str) -> int:
    """Buckets of a stored reference, 0 for any other Parquet folder."""
    place = f"{path.rstrip('/')}/{BUCKETS_FILE}"
    return int(json.loads(fs.read_text(spark, place))["buckets"]) if fs.exists(spark, place) else 0


def open_reference(spark: SparkSession, path: str) -> DataFrame:
    """A stored reference with its buckets, known to this session's catalog under a
    name of its own; any other Parquet folder as it is."""
    buckets = stored_buckets(spark, path)
    if not buckets:
        return spark.read.parquet(path)
    table = _table_name(path)
    schema = json.loads(fs.read_text(spark, f"{path.rstrip('/')}/{BUCKETS_FILE}"))["schema"]
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet "
              f"CLUSTERED BY (smiles) SORTED BY (smiles) INTO {buckets} BUCKETS LOCATION '{location}'")
    return spark.table(table)


def hot_smiles(df: DataFrame, smiles_col: str, share: float, rows: int = 0) -> DataFrame | None:
    """The SMILES with at least ``share`` of the rows, by a sample of about
    HOT_SAMPLE_ROWS of the ``rows`` (all, if fewer): at most ``1 / share`` of them."""
    part = df.select(F.col(smiles_col).alias("smiles")).where(F.col("smiles").isNotNull())
    if rows > HOT_SAMPLE_ROWS:
        part = part.sample(HOT_SAMPLE_ROWS / rows, 42)
    counts = part.groupBy("smiles").count()
    least = max(2, int(share * min(rows, HOT_SAMPLE_ROWS)))
    found = [(r["smiles"],) for r in counts.where(F.col("count") >= least).select("smiles").collect()]
    return df.sparkSession.createDataFrame(found, "smiles string") if found else None


def attach_stored_reference(df: DataFrame, path: str, smiles_col: str, rows: int) -> DataFrame:
    """:func:`attach_reference` with the reference stored at ``path``; ``df`` has
    about ``rows`` rows."""
    spark = df.sparkSession
    ref = open_reference(spark, path)
    buckets = stored_buckets(spark, path)
    hot = hot_smiles(df, smiles_col, 1 / (HOT_PER_BUCKET * buckets), rows) if buckets else None
    if hot is None:
        return attach_reference(df, ref, smiles_col)
    few = F.broadcast(hot.select(F.col("smiles").alias("_hot")))  # at most HOT_PER_BUCKET * buckets rows, as is their reference
    here = F.col(smiles_col) == F.col("_hot")
    hot_ref = F.broadcast(ref.join(F.broadcast(hot), "smiles", "left_semi"))
    hot_rows = attach_reference(df.join(few, here, "left_semi"), hot_ref, smiles_col)
    return attach_reference(df.join(few, here, "left_anti"), ref, smiles_col).unionByName(hot_rows)


def apply_reference(df: DataFrame, smiles_col: str = "smiles_raw") -> DataFrame:
    """C15 and C18 on parsed molecules with the reference's columns attached.

    Adds ``smiles`` (canonical), ``fingerprint`` and ``formula_mismatch``;
    folds C15 into ``error`` after every earlier rule.
    """
    text, _, _ = MSG_UNKNOWN_MOLECULE.partition("{s}")
    c15 = _err("C15", F.concat(F.lit(text), F.col(smiles_col)))
    error = F.coalesce(F.col("error"), F.when(F.col("_known").isNull(), c15))
    return (
        df.withColumn("error", error)
        .withColumn("smiles", F.col("_canonical"))
        .withColumn("fingerprint", F.col("_fp"))
        .withColumn("formula_mismatch", F.col("error").isNull() & ~F.col("formula").eqNullSafe(F.col("ref_formula")))
        .drop("_canonical", "_fp", "_known")
    )


def enrich_molecules(df: DataFrame, ref: DataFrame, smiles_col: str = "smiles_raw") -> DataFrame:
    """D2 on parsed molecules: attach the reference and apply its rules.

    Run before the energy fan-out, so the join sees one row per molecule.
    """
    return apply_reference(attach_reference(df, ref, smiles_col), smiles_col)
