"""Line-order subsets and the energy fan-out.

"First N" is defined by line order, so it is a predicate on
``line_number`` (and energy order) -- never ``limit()``, never a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectra import peaks_as_arrays
from ..functions.tokens import ENERGY_MARKERS


def take_first(df: DataFrame, n: int) -> DataFrame:
    """first ``n`` molecules per split (0 = all)."""
    if n < 0:
        raise ValueError("batch rows must be positive and max molecules non-negative")
    return df if n == 0 else df.where(F.col("line_number") <= n)


def explode_energies(df: DataFrame) -> DataFrame:
    """G1: one row per (molecule, energy), energies in fixed order.

    ``energy_ord`` 0, 1, 2 keeps the on-disk order; formula, smiles and
    fingerprint repeat.  Runs after enrichment (one join row per molecule).
    """
    entries = F.array(*[
        F.struct(F.lit(m).alias("energy"), peaks_as_arrays(F.col(f"peaks_{m}")).alias("spectrum"))
        for m in ENERGY_MARKERS
    ])
    cols = [c for c in df.columns if not c.startswith("peaks_")]
    # built in a projection, which is compiled; a generator with a lambda function is not
    return df.select(*cols, entries.alias("_entries")).select(*cols, F.posexplode("_entries").alias("energy_ord", "_e")).select(
        *cols, "energy_ord", F.col("_e.energy").alias("energy"), F.col("_e.spectrum").alias("spectrum")
    )


def eval_subset_hcir(df: DataFrame, n: int = 2048) -> DataFrame:
    """F2 (NMR/IR): the first ``n`` rows = lines 1..n of the split."""
    return df.where(F.col("line_number") <= n)


def eval_subset_msms(spectra: DataFrame, n: int = 2048) -> DataFrame:
    """F2 (MS/MS): first ``n`` fanned-out rows, i.e. ``(line-1)*3 + energy_ord < n``.

    Needs densely numbered written molecules (``line_number`` 1..m).
    """
    k = len(ENERGY_MARKERS)
    return spectra.where((F.col("line_number") - 1) * k + F.col("energy_ord") < n)


def check_subset_size(df: DataFrame, n: int) -> int:
    """The reference asserts the subset is exactly ``n`` rows."""
    got = df.count()
    if got != n:
        raise AssertionError(f"expected {n} evaluation rows, got {got}")
    return got
