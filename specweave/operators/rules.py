"""Record parsing and ordered validation rules.

Each rule yields an error struct or NULL; the row error is the first
non-NULL in precedence order (``coalesce``).  Every section expression is
guarded by the marker-order test, so ANSI mode never raises on a bad line.

Error struct: ``(rule string, message string, mz double, intensity double)``
-- the two doubles are only set for C12, so the driver can print the exact
Python ``repr`` of the values in the single fatal message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectra as S
from ..functions import tokens as T
from ..functions.staging import stage

# --- fixed values: rule messages (must equal the reference text) ------------
MSG_MISSING_MARKER = "missing marker {m}"
MSG_MARKER_ORDER = "source modality markers are out of order"
MSG_FORMULA_EMPTY = "molecular formula is empty"
MSG_HNMR_EMPTY = "1HNMR is empty"
MSG_IR_NON_NUMERIC = "IR contains a non-numeric value"
MSG_IR_EMPTY = "IR is empty"
MSG_IR_LENGTH = "IR length mismatch: expected {e}, got {n}"
MSG_TARGET_EMPTY = "target SMILES is empty"
MSG_NOT_PAIRS = "{m} does not contain m/z-intensity pairs"
MSG_NOT_FLOAT = "could not convert string to float: {tok}"
MSG_NON_FINITE = "{m} contains a non-finite peak"
MSG_INVALID_PEAK = "{m} contains an invalid peak: {mz}, {intensity}"
MSG_UNSORTED = "{m} m/z values are not sorted"
MSG_NO_POSITIVE = "{m} has no positive-intensity peaks"
MSG_UNKNOWN_MOLECULE = "invalid target SMILES: {s}"
MSG_ROW = "{split} line {n}: {error}"
MSG_DECODE = "not valid UTF-8"
MSG_GAP_HCIR = "{split} source/target mismatch at line {n}"
MSG_GAP_MSMS = "{split} source/target line count mismatch at line {n}"
# ---------------------------------------------------------------------------

ERROR_TYPE = "struct<rule:string,message:string,token:string,mz:double,intensity:double>"


def _err(rule: str, message: Column | str, mz: Column | None = None,
         intensity: Column | None = None, token: Column | None = None) -> Column:
    msg = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(rule).alias("rule"),
        msg.alias("message"),
        (token if token is not None else F.lit(None)).cast("string").alias("token"),
        (mz if mz is not None else F.lit(None)).cast("double").alias("mz"),
        (intensity if intensity is not None else F.lit(None)).cast("double").alias("intensity"),
    )


def _finish(raw: Column) -> Column:
    """Render parametrised messages once per row, after the first error is known.

    C10 carries the token, C12 the marker (in ``message``) and both values.
    """
    rule = raw["rule"]
    message = (
        F.when(rule == "C10", F.concat(F.lit(MSG_NOT_FLOAT.format(tok="")), S.py_repr_str(raw["token"])))
        .when(rule == "C12", F.concat(F.lit(MSG_INVALID_PEAK.partition("{m}")[0]), raw["message"], F.lit(MSG_INVALID_PEAK.partition("{m}")[2].partition("{mz}")[0]),
                                      S.py_repr_double(raw["mz"]), F.lit(", "), S.py_repr_double(raw["intensity"])))
        .otherwise(raw["message"])
    )
    return F.when(raw["rule"].isin("C10", "C12"), raw.withField("message", message)).otherwise(raw)


def _first(*errors: Column) -> Column:
    return F.coalesce(*errors)


def _missing_markers(pos: Column, markers) -> list[Column]:
    return [F.when(pos[m].isNull(), _err("C1", MSG_MISSING_MARKER.format(m=m))) for m in markers]


def _in_order(pos: Column, markers) -> Column:
    cond = None
    for a, b in zip(markers, markers[1:]):
        c = pos[a] < pos[b]
        cond = c if cond is None else cond & c
    return cond


# --------------------------------------------------------------------------- HC-IR

_STAGE_CACHE: dict[tuple, list] = {}


def _cached_stages(key: tuple, build) -> list:
    """Column trees of a parser, built once per Spark context.

    They refer to columns by name only, so one set serves every DataFrame;
    building them costs thousands of driver round trips.
    """
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    full = (sc.applicationId if sc else None, *key)
    if full not in _STAGE_CACHE:
        _STAGE_CACHE[full] = build()
    return _STAGE_CACHE[full]


def _apply(df: DataFrame, stages: list) -> DataFrame:
    for kind, cols in stages:
        if kind == "stage":
            df = stage(df, **cols)
        else:
            for name, c in cols.items():
                df = df.withColumn(name, c)
    return df


def _hcir_stages(expected_ir_length: int, source: str, target: str) -> list:
    m1, mc, mir = T.HCIR_MARKERS
    pos = F.col("_pos")
    order_ok = _in_order(pos, T.HCIR_MARKERS)
    ok = F.coalesce(order_ok, F.lit(False))
    ir_len = F.col("ir_len")
    error = _first(
        *_missing_markers(pos, T.HCIR_MARKERS),
        F.when(~order_ok, _err("C2", MSG_MARKER_ORDER)),
        F.when(F.col("molecular_formula") == "", _err("C3", MSG_FORMULA_EMPTY)),
        F.when(F.size(F.col("_h")) == 0, _err("C4", MSG_HNMR_EMPTY)),
        F.when(~F.col("_ir.ok"), _err("C5", MSG_IR_NON_NUMERIC)),
        F.when(ir_len == 0, _err("C6", MSG_IR_EMPTY)),
        F.when(
            F.lit(expected_ir_length != 0) & (ir_len != F.lit(expected_ir_length)),
            _err("C7", F.concat(F.lit(MSG_IR_LENGTH.format(e=expected_ir_length, n="")), ir_len.cast("string"))),
        ),
        F.when(F.col("smiles") == "", _err("C8", MSG_TARGET_EMPTY)),
    )
    return [
        ("stage", {"_tok": T.tokens(F.col(source))}),
        ("stage", {"_pos": T.marker_positions(F.col("_tok"), T.HCIR_MARKERS)}),
        ("stage", {
            "_ok": ok,
            "_h": F.when(ok, T.section(F.col("_tok"), pos[m1], pos[mc])),
            "_ir": F.when(ok, T.parse_numbers(T.section(F.col("_tok"), pos[mir]))),
            "molecular_formula": F.when(ok, T.formula(F.col("_tok"), pos[m1])),
            "smiles": T.smiles(F.col(target)),
        }),
        ("columns", {"h_nmr_text": T.h_nmr_text(F.col("_h")), "ir_len": F.size(F.col("_ir.values"))}),
        ("stage", {
            "error": error,
            "ir_spectra": F.transform(F.col("_ir.values"), lambda x: x.cast("float")),
            "multiplets": T.multiplet_count(F.col("h_nmr_text")),
        }),
    ]


def parse_hcir(df: DataFrame, expected_ir_length: int = 0,
               source: str = "source", target: str = "target") -> DataFrame:
    """Parse NMR/IR lines into typed columns plus an ``error`` struct.

    Adds ``molecular_formula, h_nmr_text, ir_spectra (array<float>), smiles,
    ir_len, multiplets, error``.  Each stage is evaluated once per row
    (see :mod:`specweave.functions.staging`).
    """
    if expected_ir_length < 0:
        raise ValueError("expected IR length must be non-negative")
    stages = _cached_stages(("hcir", expected_ir_length, source, target),
                            lambda: _hcir_stages(expected_ir_length, source, target))
    return _apply(df, stages).drop("_tok", "_pos", "_ok", "_h", "_ir")


# --------------------------------------------------------------------------- MS/MS

def spectrum_error(toks: Column, peaks: Column, marker: str) -> Column:
    """C9 -> (per peak, lowest index first: C10 C11 C12 C13) -> C14."""
    n = F.size(toks)

    def peak_error(p: Column, i: Column) -> Column:
        mz, it = p["mz"], p["intensity"]
        non_finite = F.isnan(mz) | F.isnan(it) | (F.abs(mz) == F.lit(float("inf"))) | (
            F.abs(it) == F.lit(float("inf"))
        )
        return (
            F.when(mz.isNull(), _err("C10", F.lit(None), token=F.get(toks, i * 2)))
            .when(it.isNull(), _err("C10", F.lit(None), token=F.get(toks, i * 2 + 1)))
            .when(non_finite, _err("C11", MSG_NON_FINITE.format(m=marker)))
            .when((mz <= 0) | (it < 0), _err("C12", marker, mz, it))
            .when((i > 0) & (mz < F.get(peaks, i - 1)["mz"]), _err("C13", MSG_UNSORTED.format(m=marker)))
        )

    first_peak_error = F.get(F.filter(F.transform(peaks, peak_error), lambda e: e.isNotNull()), 0)
    # Lambda-free proof that no peak breaks C10-C13 (the common case): all
    # values parsed, finite, m/z > 0, intensity >= 0, m/z non-decreasing.
    mz, it = peaks["mz"], peaks["intensity"]
    inf = F.lit(float("inf"))
    clean = (
        S.all_present(mz) & S.all_present(it)
        & (F.array_min(mz) > 0) & (F.array_min(it) >= 0)
        & (F.array_max(mz) < inf) & (F.array_max(it) < inf)
        & (F.sort_array(mz) == mz)
    )
    no_positive = _err("C14", MSG_NO_POSITIVE.format(m=marker))
    return (
        F.when((n == 0) | (n % 2 == 1), _err("C9", MSG_NOT_PAIRS.format(m=marker)))
        .when(F.coalesce(clean, F.lit(False)), F.when(F.array_max(it) == 0, no_positive))
        .otherwise(F.coalesce(first_peak_error, F.when(F.size(S.positive_peaks(peaks)) == 0, no_positive)))
    )


def _msms_stages(source: str, target: str) -> list:
    markers = T.MSMS_MARKERS
    pos = F.col("_pos")
    order_ok = _in_order(pos, markers)
    ok = F.coalesce(order_ok, F.lit(False))
    nxt = {"E10Pos": "E20Pos", "E20Pos": "E40Pos", "E40Pos": "IR"}
    spectrum_errors = [
        spectrum_error(F.col(f"_s_{m}"), F.col(f"_p_{m}"), m) for m in T.ENERGY_MARKERS
    ]
    error = _first(
        *_missing_markers(pos, markers),
        F.when(~order_ok, _err("C2", MSG_MARKER_ORDER)),
        F.when(F.col("formula") == "", _err("C3", MSG_FORMULA_EMPTY)),
        *spectrum_errors,
        F.when(F.col("smiles_raw") == "", _err("C8", MSG_TARGET_EMPTY)),
    )
    zero = None
    for m in T.ENERGY_MARKERS:
        z = F.coalesce(S.zero_peak_count(F.col(f"_p_{m}")), F.lit(0))
        zero = z if zero is None else zero + z
    return [
        ("stage", {"_tok": T.tokens(F.col(source))}),
        ("stage", {"_pos": T.marker_positions(F.col("_tok"), markers)}),
        ("stage", {
            "formula": F.when(ok, T.formula(F.col("_tok"), pos[markers[0]])),
            "smiles_raw": T.smiles(F.col(target)),
            **{f"_s_{m}": F.when(ok, T.section(F.col("_tok"), pos[m], pos[nxt[m]])) for m in T.ENERGY_MARKERS},
        }),
        # Values are cast once per section (a staged column) and then paired;
        # only sections with non-plain tokens take the per-token float() path.
        ("stage", {f"_v_{m}": S.plain_values(F.col(f"_s_{m}")) for m in T.ENERGY_MARKERS}),
        ("stage", {
            f"_p_{m}": F.coalesce(S.pair_values(F.col(f"_v_{m}"), F.col(f"_s_{m}")), S.pair_peaks(F.col(f"_s_{m}")))
            for m in T.ENERGY_MARKERS
        }),
        # The raw error is a column of its own, so that its rules are compiled; its
        # message is rendered from it.
        ("stage", {"_raw": error}),
        ("stage", {"error": _finish(F.col("_raw"))}),
        # not staged: a query that needs no peaks does not compute them
        ("columns", {
            "zero_peaks": zero,
            **{f"peaks_{m}": S.positive_peaks(F.col(f"_p_{m}")) for m in T.ENERGY_MARKERS},
        }),
    ]


def parse_msms(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Parse MS/MS lines: ``formula, smiles_raw, peaks_<E>, zero_peaks, error``.

    ``error`` covers C1-C3, C9-C14 and C8.  C15 and the formula check need
    the molecule reference table (:mod:`specweave.operators.enrich`).
    """
    stages = _cached_stages(("msms", source, target), lambda: _msms_stages(source, target))
    out = _apply(df, stages)
    return out.drop("_tok", "_pos", "_raw", *[f"_s_{m}" for m in T.ENERGY_MARKERS],
                    *[f"_v_{m}" for m in T.ENERGY_MARKERS], *[f"_p_{m}" for m in T.ENERGY_MARKERS])


# --------------------------------------------------------------------------- line-level

def with_alignment_error(df: DataFrame, kind: str = "hcir") -> DataFrame:
    """C17 for rows of a full outer alignment where one side is missing, and C0
    for lines that are not valid UTF-8.

    Both replace any parse error: such a line is never parsed.
    """
    template = MSG_GAP_HCIR if kind == "hcir" else MSG_GAP_MSMS
    middle = template.replace("{split}", "").replace("{n}", "")
    gap = F.col("source").isNull() | F.col("target").isNull()
    garbled = ~(F.is_valid_utf8("source") & F.is_valid_utf8("target"))
    msg = F.concat(F.col("split"), F.lit(middle), F.col("line_number").cast("string"))
    error = F.when(gap, _err("C17", msg)).when(garbled, _err("C0", MSG_DECODE)).otherwise(F.col("error"))
    return df.withColumn("error", error).withColumn("is_gap", gap)


def first_error_per_split(df: DataFrame) -> DataFrame:
    """Lowest failing line per split: ``(split, line_number, rule, message, token, mz,
    intensity)``.

    A hash aggregate finds the line numbers (at most one row per split, collected);
    the errors are then read by a predicate on split and line number, which
    reaches the scan, so no other line is parsed again.
    """
    failing = df.where(F.col("error").isNotNull()).select("split", "line_number", "error")
    here = F.lit(False)
    for r in failing.groupBy("split").agg(F.min("line_number").alias("n")).collect():
        here = here | (F.col("split").eqNullSafe(F.lit(r["split"])) & (F.col("line_number") == r["n"]))
    return failing.where(here).select(
        "split", "line_number", *[F.col(f"error.{c}").alias(c) for c in ("rule", "message", "token", "mz", "intensity")])


def format_fatal(split: str, line_number: int, error: dict) -> str:
    """Exact driver-side message of the single fatal error (Python reprs)."""
    if error["rule"] == "C17":
        return error["message"]
    msg = error["message"]
    if error["rule"] == "C10":
        msg = MSG_NOT_FLOAT.format(tok=repr(error["token"]))
    if error["rule"] == "C12":
        marker = msg.split(" ", 1)[0]
        msg = MSG_INVALID_PEAK.format(m=marker, mz=repr(float(error["mz"])),
                                      intensity=repr(float(error["intensity"])))
    return MSG_ROW.format(split=split, n=line_number, error=msg)


class RecordError(ValueError):
    """The fail-fast error of a conversion job (same text as the reference)."""
