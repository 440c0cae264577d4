"""Parsed fixture views and memoised file-backed runs shared by the queries.

Conversions that write files (J1, J2, staging) run at most once per
``(sf_dir, name)`` per process; their output directories live in the
shared checkpoint folder.  Everything else is a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators.enrich import enrich_molecules
from ..operators.numbering import number_rows
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources.text import write_text_view

_RUNS: dict[tuple, object] = {}


def memo(key: tuple, make):
    if key not in _RUNS:
        _RUNS[key] = make()
    return _RUNS[key]


def hcir(spark: SparkSession, sf: str, bad: bool = False, expected: int = FX.HCIR_EXPECTED_IR_LENGTH) -> DataFrame:
    """Parsed NMR/IR fixture lines (error column kept)."""
    return R.parse_hcir(FX.hcir_lines(spark, sf, bad=bad), expected)


def msms(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed + enriched MS/MS fixture lines; gap lines carry C17."""
    lines = FX.msms_lines(spark, sf)
    parsed = enrich_molecules(R.parse_msms(lines), FX.molecule_ref(spark, sf))
    return R.with_alignment_error(parsed, "msms")


def msms_valid(spark: SparkSession, sf: str, columns: list[str] | None = None) -> DataFrame:
    """Valid MS/MS molecules renumbered densely by line (``line_number``); of
    ``columns`` only the named ones are written for the numbering."""
    v = msms(spark, sf).where(F.col("error").isNull()).withColumnRenamed("line_number", "source_line")
    if columns is not None:
        v = v.select("split", "source_line", *columns)
    return number_rows(v, ["split"], "source_line", materialize=True)


def msms_valid_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The valid MS/MS lines as a dense ``(split, line_number, source, target)`` view."""
    lines = FX.msms_lines(spark, sf).withColumnRenamed("line_number", "source_line")
    keep = msms_valid(spark, sf, []).select("split", "source_line", "line_number")
    return lines.join(keep, ["split", "source_line"]).select("split", "line_number", "source", "target")


def text_view(spark: SparkSession, sf: str, name: str) -> str:
    """A text view (``<view>/data/src-*.txt``) written once from a fixture."""
    def make():
        view = scratch_path(spark, f"view-{name}")
        if name == "hcir":
            df = FX.hcir_lines(spark, sf)
        elif name == "hcir_bad":
            df = FX.hcir_lines(spark, sf, bad=True)
        elif name == "msms_valid":
            df = msms_valid_lines(spark, sf)
        else:
            raise KeyError(name)
        write_text_view(df, view)
        return view
    return memo((sf, "view", name), make)
