"""Query registry: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables (or files Spark wrote from them), so
its work grows with the data.  Outputs are flat: integers are ``bigint``,
arrays are exploded or rendered from integer values, so results compare
exactly with the DuckDB oracle in :mod:`specweave.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import metrics as M
from ..operators import rules as R
from ..operators.enrich import enrich_molecules
from ..operators.numbering import number_rows
from ..operators.runs import consecutive_runs, idle_predicate
from ..operators.subsets import eval_subset_hcir, eval_subset_msms, explode_energies, take_first
from ..session import scratch_path
from ..sources import files as FL
from ..sources import fixtures as FX
from ..sources import fs
from ..sources import parquet as PQ
from ..sources import summary as SM
from ..sources.text import align, read_aligned, read_line_groups, split_paths, write_text_view
from . import jobs as J
from . import views as V

HCIR_EVAL_ROWS = 32          # the test split has 50 lines at sf0.001/sf0.01
MSMS_EVAL_ROWS = 2048        # the reference's evaluation size
FIRST_N = 100
STAGED_EVAL_ROWS = 100      # of the test split of the clean lines
RUN_LENGTH = 3
IDLE_VALUE = 20.0


def _long(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long")


def _ir_text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), " ")


def _spectrum_text(c: Column) -> Column:
    texts = c.cast("array<array<bigint>>").cast("array<array<string>>")
    return F.array_join(F.transform(texts, lambda p: F.concat(F.get(p, 0), F.lit(":"), F.get(p, 1))), " ")


def _bits(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), "")


# --------------------------------------------------------------------------- file-backed runs

def _hcir_converted(spark: SparkSession, sf: str) -> str:
    def make():
        out = scratch_path(spark, "hcir-full")
        J.convert_hcir(spark, V.text_view(spark, sf, "hcir"), out, expected_ir_length=FX.HCIR_EXPECTED_IR_LENGTH)
        return out
    return V.memo((sf, "hcir_full"), make)


def _hcir_staged(spark: SparkSession, sf: str) -> str:
    def make():
        full = _hcir_converted(spark, sf)
        eval_dir = scratch_path(spark, "hcir-eval")
        counts = {r["split"]: int(r["rows"]) for r in PQ.row_counts(spark, full).collect()}
        J.stage_hcir(spark, V.text_view(spark, sf, "hcir"), full, eval_dir, counts,
                     eval_rows=HCIR_EVAL_ROWS, expected_ir_length=FX.HCIR_EXPECTED_IR_LENGTH)
        return eval_dir
    return V.memo((sf, "hcir_eval"), make)


def _msms_converted(spark: SparkSession, sf: str) -> str:
    def make():
        root = scratch_path(spark, "msms-payload")
        view = f"{root}/opennmt/VIEW"
        src = V.msms_valid_lines(spark, sf)
        write_text_view(src, view)
        fs.write_text(spark, f"{root}/manifest.json", '{"tables": ["lineitem", "orders"]}\n')
        out = scratch_path(spark, "msms-full")
        J.convert_msms(spark, view, out, FX.molecule_ref(spark, sf))
        return out
    return V.memo((sf, "msms_full"), make)


def _msms_staged(spark: SparkSession, sf: str) -> str:
    """J4 over the valid lines whose formula matches the reference's."""
    def make():
        root = scratch_path(spark, "msms-clean")
        view = f"{root}/opennmt/VIEW"
        valid = V.msms_valid(spark, sf, ["source", "target", "formula_mismatch"]).where(~F.col("formula_mismatch")).drop("line_number")
        clean = number_rows(valid, ["split"], "source_line", materialize=True).select("split", "line_number", "source", "target")
        write_text_view(clean, view)
        fs.write_text(spark, f"{root}/manifest.json", '{"tables": ["lineitem", "orders"]}\n')
        counts = {r["split"]: int(r["n"]) for r in clean.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
        eval_dir = scratch_path(spark, "msms-eval")
        J.stage_msms(spark, view, scratch_path(spark, "msms-clean-full"), eval_dir, FX.molecule_ref(spark, sf),
                     {s: (n, 3 * n) for s, n in counts.items()}, eval_rows=STAGED_EVAL_ROWS)
        return eval_dir
    return V.memo((sf, "msms_eval"), make)


def q_stage_msms(spark, sf):
    d = FL.read_staged(spark, _msms_staged(spark, sf), PQ.MSMS_SCHEMA)
    return d.select("split", "formula", "smiles", _spectrum_text(F.col("spectrum")).alias("spectrum_text"))


# --------------------------------------------------------------------------- A: sources and sinks

def q_hcir_convert(spark, sf):
    out = _hcir_converted(spark, sf)
    d = PQ.read_dataset(spark, out, PQ.HCIR_SCHEMA)
    return d.select("split", "molecular_formula", "h_nmr_text", _ir_text(F.col("ir_spectra")).alias("ir_text"), "smiles")


def q_hcir_parquet_roundtrip(spark, sf):
    out = scratch_path(spark, "hcir-roundtrip")
    PQ.write_dataset(V.hcir(spark, sf).where(F.col("error").isNull()), out, PQ.HCIR_SCHEMA)
    d = PQ.read_dataset(spark, out, PQ.HCIR_SCHEMA)
    return d.select("split", "molecular_formula", "h_nmr_text", _ir_text(F.col("ir_spectra")).alias("ir_text"), "smiles")


def q_msms_convert(spark, sf):
    d = PQ.read_dataset(spark, _msms_converted(spark, sf), PQ.MSMS_SCHEMA)
    return d.select("split", "formula", "smiles", _spectrum_text(F.col("spectrum")).alias("spectrum_text"),
                    _bits(F.col("fingerprint")).alias("fp_bits"))


def q_msms_parquet_roundtrip(spark, sf):
    out = scratch_path(spark, "msms-roundtrip")
    PQ.write_dataset(explode_energies(V.msms(spark, sf).where(F.col("error").isNull())), out, PQ.MSMS_SCHEMA)
    d = PQ.read_dataset(spark, out, PQ.MSMS_SCHEMA)
    return d.select("split", "formula", "smiles", _spectrum_text(F.col("spectrum")).alias("spectrum_text"),
                    _bits(F.col("fingerprint")).alias("fp_bits"))


def q_scan_aligned_pair(spark, sf):
    return read_aligned(spark, V.text_view(spark, sf, "hcir")).select("split", "line_number", "source", "target")


def q_line_number(spark, sf):
    """All six files of the view, numbered in one scan."""
    view = V.text_view(spark, sf, "hcir")
    groups = {f"{split}/{side}": path for split in T.SPLITS for side, path in zip(("source", "target"), split_paths(view, split))}
    lines = read_line_groups(spark, groups)
    return lines.select(F.substring_index("group", "/", 1).alias("split"), F.substring_index("group", "/", -1).alias("side"),
                        "line_number", "value")


def q_split_map(spark, sf):
    lines = FX.hcir_lines(spark, sf)
    return lines.groupBy("split").agg(_long(F.count(F.lit(1))).alias("lines")).select(
        "split", T.split_label("split").alias("stem"), _long(T.split_order("split")).alias("split_ord"), "lines")


def q_summary_json(spark, sf):
    valid = V.hcir(spark, sf).where(F.col("error").isNull())
    return SM.summary_json(M.hcir_split_summary(valid))


def q_summary_parse(spark, sf):
    s = SM.split_summaries(spark, _hcir_converted(spark, sf))
    return s.select(
        "split",
        _long(F.col("counts")["molecules_written"]).alias("molecules_written"),
        _long(F.col("counts")["multiplets_written"]).alias("multiplets_written"),
        F.explode("ir_lengths").alias("ir_length", "molecules"),
    ).withColumn("molecules", _long("molecules"))


def q_split_row_counts(spark, sf):
    return PQ.row_counts(spark, _hcir_converted(spark, sf)).withColumn("rows", _long("rows"))


def q_manifest_sha256(spark, sf):
    docs = FX.table(spark, sf, "documents").select("doc_id", "text")
    return FL.sha256_text(docs, "text").select("doc_id", "sha256")


def q_ready_gate(spark, sf):
    from ..streaming.gate import ready_gate

    return ready_gate(spark, _hcir_staged(spark, sf), PQ.HCIR_SCHEMA)


def q_staged_union(spark, sf):
    d = FL.read_staged(spark, _hcir_staged(spark, sf), PQ.HCIR_SCHEMA)
    return d.select("split", "molecular_formula", "h_nmr_text", "smiles")


def q_ordered_output(spark, sf):
    out = _hcir_converted(spark, sf)
    parts = []
    for split in T.SPLITS:
        p = PQ.rows_in_file_order(spark, f"{out}/split={split}").select(
            F.lit(split).alias("split"), _long("position").alias("position"), "molecular_formula")
        parts.append(p)
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# --------------------------------------------------------------------------- B: tokens and arrays

def q_tokenize_counts(spark, sf):
    docs = FX.table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", _long(F.size(T.tokens(F.col("text")))).alias("n_tokens"))


def q_marker_positions(spark, sf):
    lines = FX.hcir_lines(spark, sf, bad=True)
    toks = T.tokens(F.col("source"))
    return lines.select("split", "line_number", *[
        _long(T.marker_position(toks, m)).alias(f"pos_{m.lower()}") for m in T.HCIR_MARKERS])


def q_section_lengths(spark, sf):
    lines = FX.hcir_lines(spark, sf, bad=True).withColumn("_t", T.tokens(F.col("source")))
    p = {m: T.marker_position(F.col("_t"), m) for m in T.HCIR_MARKERS}
    ok = (p["1HNMR"] < p["13CNMR"]) & (p["13CNMR"] < p["IR"])
    return lines.where(ok).select(
        "split", "line_number",
        _long(F.size(T.prefix(F.col("_t"), p["1HNMR"]))).alias("n_formula"),
        _long(F.size(T.section(F.col("_t"), p["1HNMR"], p["13CNMR"]))).alias("n_hnmr"),
        _long(F.size(T.section(F.col("_t"), p["IR"]))).alias("n_ir"),
    )


def q_formula_join(spark, sf):
    return V.hcir(spark, sf).select("split", "line_number", "molecular_formula")


def q_hnmr_text(spark, sf):
    return V.hcir(spark, sf).select("split", "line_number", "h_nmr_text")


def q_multiplet_count(spark, sf):
    return V.hcir(spark, sf).select("split", "line_number", _long("multiplets").alias("multiplets"))


def q_ir_vector_parse(spark, sf):
    d = V.hcir(spark, sf).where(F.col("error").isNull())
    return d.select("split", "line_number", F.posexplode("ir_spectra").alias("pos", "v")).select(
        "split", "line_number", _long("pos").alias("pos"), _long("v").alias("value"))


def q_smiles_join(spark, sf):
    return V.hcir(spark, sf).select("split", "line_number", "smiles")


def _msms_ordered_lines(spark, sf):
    from ..functions.spectra import pair_peaks, pair_values, plain_values
    from ..functions.staging import stage

    lines = FX.msms_lines(spark, sf).where(F.col("source").isNotNull())
    t = stage(lines, _t=T.tokens(F.col("source")))
    t = stage(t, _pos=T.marker_positions(F.col("_t"), T.MSMS_MARKERS))
    pos = F.col("_pos")
    ok = None
    for a, b in zip(T.MSMS_MARKERS, T.MSMS_MARKERS[1:]):
        c = pos[a] < pos[b]
        ok = c if ok is None else ok & c
    nxt = {"E10Pos": "E20Pos", "E20Pos": "E40Pos", "E40Pos": "IR"}
    t = stage(t.where(ok), **{f"_s_{m}": T.section(F.col("_t"), pos[m], pos[nxt[m]]) for m in T.ENERGY_MARKERS})
    t = stage(t, **{f"_v_{m}": plain_values(F.col(f"_s_{m}")) for m in T.ENERGY_MARKERS})
    return stage(t, **{f"_pk_{m}": F.coalesce(pair_values(F.col(f"_v_{m}"), F.col(f"_s_{m}")), pair_peaks(F.col(f"_s_{m}"))) for m in T.ENERGY_MARKERS})


def _peak_rows(t: DataFrame, peaks: Callable[[Column], Column]) -> DataFrame:
    """One row per energy and peak of ordered lines, in one pass over them."""
    spectra = F.array(*[F.struct(F.lit(m).alias("energy"), peaks(F.col(f"_pk_{m}")).alias("peaks")) for m in T.ENERGY_MARKERS])
    u = t.select("split", "line_number", F.inline(spectra)).select(
        "split", "line_number", "energy", F.posexplode("peaks").alias("peak_idx", "p"))
    return u.select("split", "line_number", "energy", _long("peak_idx").alias("peak_idx"),
                    _long(F.col("p.mz")).alias("mz"), _long(F.col("p.intensity")).alias("intensity"))


def q_peak_pairs(spark, sf):
    return _peak_rows(_msms_ordered_lines(spark, sf), lambda peaks: peaks)


def q_positive_peaks(spark, sf):
    from ..functions.spectra import positive_peaks

    return _peak_rows(_msms_ordered_lines(spark, sf), positive_peaks)


def q_zero_peaks_removed(spark, sf):
    return V.msms(spark, sf).where(F.col("error").isNull()).select("split", "line_number", _long("zero_peaks").alias("zero_peaks"))


# --------------------------------------------------------------------------- C: rules

def _hcir_errors(spark, sf, rules, with_rule=False):
    d = V.hcir(spark, sf, bad=True).where(F.col("error.rule").isin(*rules))
    cols = ["split", "line_number"] + ([F.col("error.rule").alias("rule")] if with_rule else [])
    return d.select(*cols, F.col("error.message").alias("message"))


def q_err_missing_marker(spark, sf):
    return _hcir_errors(spark, sf, ["C1"])


def q_err_marker_order(spark, sf):
    return _hcir_errors(spark, sf, ["C2"])


def q_err_empty_sections(spark, sf):
    return _hcir_errors(spark, sf, ["C3", "C4", "C8"], with_rule=True)


def q_err_ir_vector(spark, sf):
    return _hcir_errors(spark, sf, ["C5", "C6", "C7"], with_rule=True)


def q_err_spectrum(spark, sf):
    d = V.msms(spark, sf).where(F.col("error.rule").isin("C9", "C10", "C11", "C12", "C13", "C14"))
    return d.select("split", "line_number", F.col("error.rule").alias("rule"), F.col("error.message").alias("message"))


def q_err_spectrum_values(spark, sf):
    """C9-C13 in each of the three energies."""
    d = R.parse_msms(FX.msms_bad_lines(spark, sf)).where(F.col("error").isNotNull())
    return d.select("split", "line_number", F.col("error.rule").alias("rule"), F.col("error.message").alias("message"))


def q_rejects(spark, sf):
    """J1 with quarantine: the failing lines of the faulty view."""
    def make():
        out, rejects = scratch_path(spark, "hcir-quarantine"), scratch_path(spark, "hcir-rejects")
        J.convert_hcir(spark, V.text_view(spark, sf, "hcir_bad"), out, expected_ir_length=FX.HCIR_EXPECTED_IR_LENGTH,
                       on_error="quarantine", rejects=rejects)
        return rejects
    return spark.read.parquet(V.memo((sf, "rejects"), make))


def q_err_unknown_molecule(spark, sf):
    d = V.msms(spark, sf).where(F.col("error.rule") == "C15")
    return d.select("split", "line_number", F.col("error.message").alias("message"))


def q_first_error_per_split(spark, sf):
    f = R.first_error_per_split(V.hcir(spark, sf, bad=True))
    msg = F.concat(F.col("split"), F.lit(" line "), F.col("line_number").cast("string"), F.lit(": "), F.col("message"))
    return f.select("split", _long("line_number").alias("line_number"), msg.alias("message"))


def q_alignment_gap(spark, sf):
    src, tgt = FX.align_pair(spark, sf)
    a = R.with_alignment_error(align(src, tgt).withColumn("error", F.lit(None).cast(R.ERROR_TYPE)), "hcir")
    f = R.first_error_per_split(a)
    return f.select("split", _long("line_number").alias("line_number"), "message")


def q_formula_mismatches(spark, sf):
    d = V.msms(spark, sf).where(F.col("formula_mismatch"))
    return d.select("split", "line_number", F.col("formula").alias("payload"), F.col("ref_formula").alias("reference"), "smiles")


# --------------------------------------------------------------------------- D: joins

def q_align_full_outer(spark, sf):
    src, tgt = FX.align_pair(spark, sf)
    a = align(src, tgt)
    return a.select("line_number", F.col("source").isNotNull().alias("has_source"),
                    F.col("target").isNotNull().alias("has_target"))


def q_enrich_join(spark, sf):
    d = V.msms(spark, sf).where(F.col("error").isNull())
    return d.select("split", "line_number", "smiles", "ref_formula", _bits(F.col("fingerprint")).alias("fp_bits"))


def q_enrich_join_sorted(spark, sf):
    """D2 as a sort-merge join, whatever the size of the reference."""
    parsed = R.parse_msms(FX.msms_lines(spark, sf))
    joined = enrich_molecules(parsed, FX.molecule_ref(spark, sf).hint("merge"))
    d = R.with_alignment_error(joined, "msms").where(F.col("error").isNull())
    return d.select("split", "line_number", "smiles", "ref_formula", _bits(F.col("fingerprint")).alias("fp_bits"))


def _msms_expected(spark, sf):
    """Every aligned line of train and validation, the valid ones of test."""
    d = V.msms(spark, sf).where(F.col("source").isNotNull())
    counted = F.when((F.col("split") != "test") | F.col("error").isNull(), 1)
    return d.groupBy("split").agg(F.count(counted).alias("expected_molecules")).withColumn(
        "expected_spectra", F.col("expected_molecules") * 3)


def q_verify_counts(spark, sf):
    summ = M.msms_split_summary(V.msms(spark, sf).where(F.col("error").isNull()))
    return M.verify_counts(summ, _msms_expected(spark, sf))


# --------------------------------------------------------------------------- E: aggregates

def q_hcir_split_summary(spark, sf):
    s = M.hcir_split_summary(V.hcir(spark, sf).where(F.col("error").isNull()))
    return s.select("split", _long("molecules_written").alias("molecules_written"),
                    _long("multiplets_written").alias("multiplets_written"))


def q_ir_length_histogram(spark, sf):
    valid = V.hcir(spark, sf, bad=True, expected=0).where(F.col("error").isNull())
    return M.ir_length_histogram(valid).withColumn("molecules", _long("molecules"))


def q_verify_lengths(spark, sf):
    valid = V.hcir(spark, sf, bad=True, expected=0).where(F.col("error").isNull())
    v = M.verify_lengths(valid, FX.HCIR_EXPECTED_IR_LENGTH)
    return v.select("split", _long("molecules").alias("molecules"), _long("at_expected").alias("at_expected"),
                    _long("other_lengths").alias("other_lengths"), "ok")


def _msms_summary(spark, sf):
    return M.msms_split_summary(V.msms(spark, sf).where(F.col("error").isNull()))


def q_msms_split_summary(spark, sf):
    s = _msms_summary(spark, sf)
    return s.select("split", *[_long(c).alias(c) for c in s.columns if c != "split"])


def q_energy_counts(spark, sf):
    e = M.energy_counts(explode_energies(V.msms(spark, sf).where(F.col("error").isNull())))
    return e.select("split", *[_long(c).alias(c) for c in e.columns if c != "split"])


def q_dataset_totals(spark, sf):
    return M.dataset_totals(_msms_summary(spark, sf))


def q_mismatch_examples(spark, sf):
    m = M.mismatch_examples(V.msms(spark, sf).where(F.col("error").isNull()))
    return m.select("split", _long("rank").alias("rank"), "line_number", "payload", "reference", "smiles")


def q_verify_summary(spark, sf):
    return M.verify_summary(_msms_summary(spark, sf), _msms_expected(spark, sf).select(
        "split", F.col("expected_molecules").alias("expected_molecules"), "expected_spectra"))


# --------------------------------------------------------------------------- F, G: subsets and fan-out

def q_first_n_per_split(spark, sf):
    d = take_first(V.hcir(spark, sf), FIRST_N)
    return d.select("split", "line_number", "molecular_formula")


def q_eval_subset_hcir(spark, sf):
    d = eval_subset_hcir(V.hcir(spark, sf).where(F.col("split") == "test"), HCIR_EVAL_ROWS)
    return d.select("line_number", "molecular_formula", "smiles")


def q_explode_energies(spark, sf):
    e = explode_energies(V.msms_valid(spark, sf))
    return e.select("split", "line_number", _long("energy_ord").alias("energy_ord"), "energy",
                    _long(F.size("spectrum")).alias("n_peaks"), "formula", "smiles",
                    _spectrum_text(F.col("spectrum")).alias("spectrum_text"))


def q_eval_subset_msms(spark, sf):
    e = eval_subset_msms(explode_energies(V.msms_valid(spark, sf).where(F.col("split") == "test")), MSMS_EVAL_ROWS)
    return e.select("line_number", "energy", _long(F.size("spectrum")).alias("n_peaks"))


# --------------------------------------------------------------------------- W, K: runs

def _idle() -> Column:
    """W2 on the events: the sample's value as both memory and utilisation."""
    return idle_predicate(F.col("value"), F.col("value"), IDLE_VALUE, IDLE_VALUE)


def q_consecutive_runs(spark, sf):
    ev = FX.metric_samples(spark, sf).select("user_id", "event_id", "value")
    return consecutive_runs(ev, "user_id", "event_id", _idle(), RUN_LENGTH).select("user_id", "event_id")


def q_consecutive_runs_hosts(spark, sf):
    """W1 keyed by host name and ordered by time, as launcher samples are."""
    ev = FX.metric_samples(spark, sf).select(F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"), "ts", "event_id", "value")
    # one sample per host and instant: the first event
    once = ev.groupBy("host", "ts").agg(F.min_by("value", "event_id").alias("value"))
    return consecutive_runs(once, "host", "ts", _idle(), RUN_LENGTH).groupBy("host").agg(_long(F.count(F.lit(1))).alias("firings"))


def q_consecutive_runs_stream(spark, sf):
    from ..streaming.runs import consecutive_runs_stream

    out = consecutive_runs_stream(spark, f"{sf.rstrip('/')}/events.parquet", "user_id", "event_id",
                                  "value <= 20.0", RUN_LENGTH)
    return out.select("user_id", "event_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # flagship first
    "hcir_convert": q_hcir_convert,
    "msms_convert": q_msms_convert,
    "scan_aligned_pair": q_scan_aligned_pair,
    "line_number": q_line_number,
    "split_map": q_split_map,
    "hcir_parquet_roundtrip": q_hcir_parquet_roundtrip,
    "msms_parquet_roundtrip": q_msms_parquet_roundtrip,
    "summary_json": q_summary_json,
    "summary_parse": q_summary_parse,
    "split_row_counts": q_split_row_counts,
    "manifest_sha256": q_manifest_sha256,
    "ready_gate": q_ready_gate,
    "staged_union": q_staged_union,
    "ordered_output": q_ordered_output,
    "stage_msms": q_stage_msms,
    "tokenize_counts": q_tokenize_counts,
    "marker_positions": q_marker_positions,
    "section_lengths": q_section_lengths,
    "formula_join": q_formula_join,
    "hnmr_text": q_hnmr_text,
    "multiplet_count": q_multiplet_count,
    "ir_vector_parse": q_ir_vector_parse,
    "smiles_join": q_smiles_join,
    "peak_pairs": q_peak_pairs,
    "positive_peaks": q_positive_peaks,
    "zero_peaks_removed": q_zero_peaks_removed,
    "err_missing_marker": q_err_missing_marker,
    "err_marker_order": q_err_marker_order,
    "err_empty_sections": q_err_empty_sections,
    "err_ir_vector": q_err_ir_vector,
    "err_spectrum": q_err_spectrum,
    "err_spectrum_values": q_err_spectrum_values,
    "rejects": q_rejects,
    "err_unknown_molecule": q_err_unknown_molecule,
    "first_error_per_split": q_first_error_per_split,
    "alignment_gap": q_alignment_gap,
    "formula_mismatches": q_formula_mismatches,
    "align_full_outer": q_align_full_outer,
    "enrich_join": q_enrich_join,
    "enrich_join_sorted": q_enrich_join_sorted,
    "verify_counts": q_verify_counts,
    "hcir_split_summary": q_hcir_split_summary,
    "ir_length_histogram": q_ir_length_histogram,
    "verify_lengths": q_verify_lengths,
    "msms_split_summary": q_msms_split_summary,
    "energy_counts": q_energy_counts,
    "dataset_totals": q_dataset_totals,
    "mismatch_examples": q_mismatch_examples,
    "verify_summary": q_verify_summary,
    "first_n_per_split": q_first_n_per_split,
    "eval_subset_hcir": q_eval_subset_hcir,
    "explode_energies": q_explode_energies,
    "eval_subset_msms": q_eval_subset_msms,
    "consecutive_runs": q_consecutive_runs,
    "consecutive_runs_hosts": q_consecutive_runs_hosts,
    "consecutive_runs_stream": q_consecutive_runs_stream,
}
