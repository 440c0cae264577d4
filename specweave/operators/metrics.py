"""Quality metrics and verification.

All metrics are grouped aggregates with partial (map-side) aggregation;
grouping keys are the split and small domains (IR length, energy), so the
shuffled data is a few rows per task whatever the input size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import ENERGY_MARKERS, SPLITS

EXAMPLES_PER_SPLIT = 10


def hcir_split_summary(valid: DataFrame) -> DataFrame:
    """``(split, molecules_written, multiplets_written)``."""
    return valid.groupBy("split").agg(
        F.count(F.lit(1)).alias("molecules_written"),
        F.sum("multiplets").cast("long").alias("multiplets_written"),
    )


def ir_length_histogram(valid: DataFrame) -> DataFrame:
    """``(split, ir_length string, molecules)`` rows of the histogram."""
    return valid.groupBy("split", F.col("ir_len").cast("string").alias("ir_length")).agg(
        F.count(F.lit(1)).alias("molecules")
    )


def verify_lengths(valid: DataFrame, expected_length: int) -> DataFrame:
    """The histogram must be exactly ``{expected: molecules}``.

    ``(split, molecules, at_expected, other_lengths, ok)``.
    """
    return verify_length_histogram(ir_length_histogram(valid), expected_length)


def verify_length_histogram(hist: DataFrame, expected_length: int) -> DataFrame:
    """E10 on a histogram ``(split, ir_length string, molecules)``."""
    return hist.groupBy("split").agg(
        F.sum("molecules").alias("molecules"),
        F.sum(F.when(F.col("ir_length") == str(expected_length), F.col("molecules")).otherwise(0)).alias("at_expected"),
        F.count_if(F.col("ir_length") != str(expected_length)).alias("other_lengths"),
    ).withColumn("ok", F.col("other_lengths") == 0)


def msms_split_summary(valid: DataFrame) -> DataFrame:
    """Per-split counters of the MS/MS conversion.

    ``valid`` has one row per written molecule (before fan-out); the
    spectra counters are 3 per molecule by construction.
    """
    n = F.count(F.lit(1))
    return valid.groupBy("split").agg(
        n.alias("molecules_scanned"),
        n.alias("molecules_written"),
        F.sum("zero_peaks").cast("long").alias("zero_intensity_peaks_removed"),
        F.count_if(F.col("formula_mismatch")).alias("formula_mismatches"),
        *[n.alias(m) for m in ENERGY_MARKERS],
        (n * len(ENERGY_MARKERS)).alias("spectra_written"),
    )


def energy_counts(spectra: DataFrame) -> DataFrame:
    """E6 from the fanned-out rows: ``(split, E10Pos, E20Pos, E40Pos, spectra_written)``."""
    piv = spectra.groupBy("split").pivot("energy", list(ENERGY_MARKERS)).count()
    for m in ENERGY_MARKERS:
        piv = piv.withColumn(m, F.coalesce(F.col(m), F.lit(0)).cast("long"))
    total = sum((F.col(m) for m in ENERGY_MARKERS), F.lit(0))
    return piv.withColumn("spectra_written", total.cast("long"))


def dataset_totals(split_summary: DataFrame) -> DataFrame:
    """``(total_molecules, total_spectra)`` over all splits."""
    return split_summary.agg(
        F.sum("molecules_written").cast("long").alias("total_molecules"),
        F.sum("spectra_written").cast("long").alias("total_spectra"),
    )


def mismatch_examples(valid: DataFrame, k: int = EXAMPLES_PER_SPLIT) -> DataFrame:
    """First ``k`` formula mismatches by line per split.

    The rank filter becomes a WindowGroupLimit: each task keeps its own
    first ``k`` per split before the shuffle, so at most
    ``k * tasks * splits`` rows move.
    """
    w = Window.partitionBy("split").orderBy("line_number")
    return (
        valid.where(F.col("formula_mismatch"))
        .select("split", "line_number", F.col("formula").alias("payload"),
                F.col("ref_formula").alias("reference"), "smiles")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def expected_counts(spark: SparkSession, expected: dict[str, int], spectra: dict[str, int] | None = None) -> DataFrame:
    """A 3-row expected-count table ``(split, expected_molecules, expected_spectra)``."""
    rows = [(s, int(expected.get(s, 0)), int((spectra or {}).get(s, 0))) for s in SPLITS]
    return spark.createDataFrame(rows, "split string, expected_molecules long, expected_spectra long")


def verify_counts(actual: DataFrame, expected: DataFrame, actual_col: str = "molecules_written",
                  expected_col: str = "expected_molecules") -> DataFrame:
    """D3: ``(split, expected, actual, ok)``; expected 0 disables a split's check.

    ``expected`` is a 3-row table, so the join is a broadcast of a fixed-size side.
    """
    j = F.broadcast(expected).join(actual, "split", "left")
    act = F.coalesce(F.col(actual_col), F.lit(0)).cast("long")
    exp = F.col(expected_col).cast("long")
    return j.select(
        "split", exp.alias("expected"), act.alias("actual"),
        ((exp == 0) | (exp == act)).alias("ok"),
    )


def verify_summary(split_summary: DataFrame, expected: DataFrame) -> DataFrame:
    """Molecules and spectra equal the expected values and no formula
    mismatch (a missing counter counts as 0)."""
    j = F.broadcast(expected).join(split_summary, "split", "left")
    mol = F.coalesce(F.col("molecules_written"), F.lit(0))
    spec = F.coalesce(F.col("spectra_written"), F.lit(0))
    mis = F.coalesce(F.col("formula_mismatches"), F.lit(0))
    return j.select(
        "split",
        (mol == F.col("expected_molecules")).alias("molecules_ok"),
        (spec == F.col("expected_spectra")).alias("spectra_ok"),
        (mis == 0).alias("mismatches_ok"),
    )
