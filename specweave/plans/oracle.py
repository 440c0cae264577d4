"""DuckDB oracle SQL, one statement per registered query.

The fixture views are rebuilt here in SQL from the same base tables.
Where possible the expected result is derived from the fixture's
definition rather than by re-parsing text (e.g. the failing rule of a bad
NMR/IR line follows from ``vec_id % 49``; the MS/MS rule from which return
flags exist and whether their discounts are all zero), so the oracle is an
independent check of the Spark parser.
"""

from __future__ import annotations

# DuckDB's \s lacks U+000B; this class equals Python's str.isspace().
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"


def _tokens(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{_WS}'), lambda x: x <> '')"


HCIR = """
hcir_e AS (
  SELECT vec_id, label,
    CASE WHEN vec_id % 10 < 8 THEN 'train' WHEN vec_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
    'C ' || CAST(label + 1 AS VARCHAR) || ' H ' || CAST(vec_id % 9 + 1 AS VARCHAR) AS f,
    'C' || CAST(label + 1 AS VARCHAR) || 'H' || CAST(vec_id % 9 + 1 AS VARCHAR) AS formula,
    CASE vec_id % 4 WHEN 0 THEN '1.2 t 3' WHEN 1 THEN '1.2 t 3 | 2.1 s 1'
         WHEN 2 THEN '1.2 t 3 | 2.1 s 1 | 7.3 m 5' ELSE '0.9 d 6 |' END AS h,
    CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 2 END AS mult,
    array_to_string(list_transform(embedding,
        lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR)), ' ') AS ir,
    len(embedding) AS ir_len,
    repeat('C ', label + 1) || 'O' AS t,
    repeat('C', label + 1) || 'O' AS smiles,
    vec_id % 49 AS k,
    embedding
  FROM embeddings),
hcir_lines AS (
  SELECT split, row_number() OVER (PARTITION BY split ORDER BY vec_id) AS line_number, *,
    f || ' 1HNMR ' || h || ' 13CNMR 12 34 IR ' || ir AS source, t AS target
  FROM hcir_e),
hcir_bad AS (
  SELECT * EXCLUDE (source, target),
    CASE k WHEN 40 THEN f || ' 1HNMR ' || h || ' 12 34 IR ' || ir
           WHEN 41 THEN f || ' 1HNMR ' || h || ' IR ' || ir || ' 13CNMR 12 34'
           WHEN 42 THEN '1HNMR ' || h || ' 13CNMR 12 34 IR ' || ir
           WHEN 43 THEN f || ' 1HNMR 13CNMR 12 34 IR ' || ir
           WHEN 44 THEN source || ' x'
           WHEN 45 THEN f || ' 1HNMR ' || h || ' 13CNMR 12 34 IR'
           WHEN 46 THEN f || ' 1HNMR ' || h || ' 13CNMR 12 34 IR 1 2 3'
           ELSE source END AS source,
    CASE WHEN k = 47 THEN '  ' ELSE target END AS target,
    CASE k WHEN 40 THEN 'C1' WHEN 41 THEN 'C2' WHEN 42 THEN 'C3' WHEN 43 THEN 'C4'
           WHEN 44 THEN 'C5' WHEN 45 THEN 'C6' WHEN 46 THEN 'C7' WHEN 47 THEN 'C8' END AS rule,
    CASE k WHEN 40 THEN 'missing marker 13CNMR'
           WHEN 41 THEN 'source modality markers are out of order'
           WHEN 42 THEN 'molecular formula is empty'
           WHEN 43 THEN '1HNMR is empty'
           WHEN 44 THEN 'IR contains a non-numeric value'
           WHEN 45 THEN 'IR is empty'
           WHEN 46 THEN 'IR length mismatch: expected 64, got 3'
           WHEN 47 THEN 'target SMILES is empty' END AS message
  FROM hcir_lines)
"""

MSMS = """
ms_peaks AS (
  SELECT l_orderkey, l_returnflag AS flag, l_partkey + 1 AS mz,
         CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS it
  FROM lineitem),
ms_sec AS (
  SELECT l_orderkey, flag,
         string_agg(CAST(mz AS VARCHAR) || ' ' || CAST(it AS VARCHAR), ' ' ORDER BY mz, it) AS txt,
         string_agg(CASE WHEN it <> 0 THEN CAST(mz AS VARCHAR) || ':' || CAST(it AS VARCHAR) END, ' '
                    ORDER BY mz, it) AS pos_txt,
         count(*) AS n_peaks, count(*) FILTER (WHERE it = 0) AS n_zero
  FROM ms_peaks GROUP BY l_orderkey, flag),
ms_ord AS (
  SELECT l_orderkey,
    max(CASE WHEN flag = 'A' THEN 'E10Pos ' || txt END) AS e10,
    max(CASE WHEN flag = 'N' THEN 'E20Pos ' || txt END) AS e20,
    max(CASE WHEN flag = 'R' THEN 'E40Pos ' || txt END) AS e40,
    max(CASE WHEN flag = 'A' THEN pos_txt END) AS s10,
    max(CASE WHEN flag = 'N' THEN pos_txt END) AS s20,
    max(CASE WHEN flag = 'R' THEN pos_txt END) AS s40,
    max(CASE WHEN flag = 'A' THEN n_peaks - n_zero END) AS p10,
    max(CASE WHEN flag = 'N' THEN n_peaks - n_zero END) AS p20,
    max(CASE WHEN flag = 'R' THEN n_peaks - n_zero END) AS p40,
    bool_or(flag = 'A') AS has_a, bool_or(flag = 'N') AS has_n, bool_or(flag = 'R') AS has_r,
    bool_or(flag = 'A' AND n_zero = n_peaks) AS zero_a,
    bool_or(flag = 'N' AND n_zero = n_peaks) AS zero_n,
    bool_or(flag = 'R' AND n_zero = n_peaks) AS zero_r,
    sum(n_zero) AS n_zero
  FROM ms_sec GROUP BY l_orderkey),
msms_lines AS (
  SELECT CASE WHEN o.o_orderkey % 10 < 8 THEN 'train' WHEN o.o_orderkey % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
    CASE WHEN o.o_orderkey % 10 < 8 THEN o.o_orderkey // 10 * 8 + o.o_orderkey % 10 + 1 ELSE o.o_orderkey // 10 + 1 END AS line_number,
    o.o_orderkey,
    o.o_custkey % 50 + 1 AS kk, o.o_orderstatus AS st,
    CASE WHEN m.l_orderkey IS NOT NULL THEN concat_ws(' ', 'C',
        CAST(o.o_custkey % 50 + 1 + CASE WHEN o.o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS VARCHAR),
        '1HNMR 1.2 t 3 13CNMR 12', m.e10, m.e20, m.e40, 'IR 1 2') END AS source,
    repeat('C ', o.o_custkey % 50 + 1) || o.o_orderstatus AS target,
    'C' || CAST(o.o_custkey % 50 + 1 + CASE WHEN o.o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS payload,
    'C' || CAST(o.o_custkey % 50 + 1 AS VARCHAR) AS ref_formula,
    repeat('C', o.o_custkey % 50 + 1) || o.o_orderstatus AS smiles,
    array_to_string(list_transform(range(0, 128), lambda i:
        CASE WHEN ((o.o_custkey % 50 + 1) * (i + 7) + ascii(o.o_orderstatus)) % 3 = 0 THEN '1' ELSE '0' END), '')
      AS fp_bits,
    m.*
  FROM orders o LEFT JOIN ms_ord m ON o.o_orderkey = m.l_orderkey),
msms_rules AS (
  SELECT *,
    CASE WHEN source IS NULL THEN 'C17'
         WHEN NOT has_a OR NOT has_n OR NOT has_r THEN 'C1'
         WHEN zero_a OR zero_n OR zero_r THEN 'C14'
         WHEN kk = 50 THEN 'C15' END AS rule,
    CASE WHEN source IS NULL THEN split || ' source/target line count mismatch at line ' || CAST(line_number AS VARCHAR)
         WHEN NOT has_a THEN 'missing marker E10Pos'
         WHEN NOT has_n THEN 'missing marker E20Pos'
         WHEN NOT has_r THEN 'missing marker E40Pos'
         WHEN zero_a THEN 'E10Pos has no positive-intensity peaks'
         WHEN zero_n THEN 'E20Pos has no positive-intensity peaks'
         WHEN zero_r THEN 'E40Pos has no positive-intensity peaks'
         WHEN kk = 50 THEN 'invalid target SMILES: ' || smiles END AS message
  FROM msms_lines),
msms_valid AS (
  SELECT row_number() OVER (PARTITION BY split ORDER BY line_number) AS vline, *
  FROM msms_rules WHERE rule IS NULL),
msms_spectra AS (
  SELECT split, vline, 0 AS energy_ord, 'E10Pos' AS energy, p10 AS n_peaks, s10 AS spectrum_text, payload, smiles, fp_bits FROM msms_valid
  UNION ALL
  SELECT split, vline, 1, 'E20Pos', p20, s20, payload, smiles, fp_bits FROM msms_valid
  UNION ALL
  SELECT split, vline, 2, 'E40Pos', p40, s40, payload, smiles, fp_bits FROM msms_valid)
"""


def _with(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip() for b in blocks) + "\n"


H = _with(HCIR)
MS = _with(MSMS)

_SPLIT_ORD = "CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END"

ORACLE: dict[str, str] = {
    # ---------------------------------------------------------------- A
    "hcir_convert": H + "SELECT split, formula AS molecular_formula, '1HNMR ' || h AS h_nmr_text, ir AS ir_text, smiles FROM hcir_lines",
    "hcir_parquet_roundtrip": H + "SELECT split, formula AS molecular_formula, '1HNMR ' || h AS h_nmr_text, ir AS ir_text, smiles FROM hcir_lines",
    "msms_convert": MS + "SELECT split, payload AS formula, smiles, spectrum_text, fp_bits FROM msms_spectra",
    "msms_parquet_roundtrip": MS + "SELECT split, payload AS formula, smiles, spectrum_text, fp_bits FROM msms_spectra",
    "scan_aligned_pair": H + "SELECT split, line_number, source, target FROM hcir_lines",
    "line_number": H + """SELECT split, 'source' AS side, line_number, source AS value FROM hcir_lines
        UNION ALL SELECT split, 'target', line_number, target FROM hcir_lines""",
    "split_map": H + f"""SELECT split, CASE split WHEN 'validation' THEN 'val' ELSE split END AS stem,
        CAST({_SPLIT_ORD} AS BIGINT) AS split_ord, count(*) AS lines FROM hcir_lines GROUP BY split""",
    "summary_json": H + """SELECT split, CAST(to_json(struct_pack(molecules_written := count(*),
        multiplets_written := CAST(sum(mult) AS BIGINT))) AS VARCHAR) AS summary_json FROM hcir_lines GROUP BY split""",
    "summary_parse": H + """SELECT split, count(*) AS molecules_written, CAST(sum(mult) AS BIGINT) AS multiplets_written,
        CAST(max(ir_len) AS VARCHAR) AS ir_length, count(*) AS molecules FROM hcir_lines GROUP BY split""",
    "split_row_counts": H + "SELECT split, count(*) AS rows FROM hcir_lines GROUP BY split",
    "manifest_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "ready_gate": H + """SELECT split, count(*) AS marker_rows, count(*) AS actual_rows, true AS ok FROM hcir_lines
        WHERE split <> 'test' OR line_number <= 32 GROUP BY split""",
    "staged_union": H + """SELECT split, formula AS molecular_formula, '1HNMR ' || h AS h_nmr_text, smiles FROM hcir_lines
        WHERE split <> 'test' OR line_number <= 32""",
    "ordered_output": H + "SELECT split, line_number AS position, formula AS molecular_formula FROM hcir_lines",
    # ---------------------------------------------------------------- B
    "tokenize_counts": f"SELECT doc_id, CAST(len({_tokens('text')}) AS BIGINT) AS n_tokens FROM documents",
    "marker_positions": H + f"""SELECT split, line_number,
        CAST(list_position(tk, '1HNMR') AS BIGINT) AS pos_1hnmr,
        CAST(list_position(tk, '13CNMR') AS BIGINT) AS pos_13cnmr,
        CAST(list_position(tk, 'IR') AS BIGINT) AS pos_ir
        FROM (SELECT *, {_tokens('source')} AS tk FROM hcir_bad)""",
    "section_lengths": H + f"""SELECT split, line_number, CAST(p1 - 1 AS BIGINT) AS n_formula,
        CAST(pc - p1 - 1 AS BIGINT) AS n_hnmr, CAST(len(tk) - pi AS BIGINT) AS n_ir
        FROM (SELECT *, list_position(tk, '1HNMR') AS p1, list_position(tk, '13CNMR') AS pc,
                        list_position(tk, 'IR') AS pi
              FROM (SELECT *, {_tokens('source')} AS tk FROM hcir_bad))
        WHERE p1 < pc AND pc < pi""",
    "formula_join": H + "SELECT split, line_number, formula AS molecular_formula FROM hcir_lines",
    "hnmr_text": H + "SELECT split, line_number, '1HNMR ' || h AS h_nmr_text FROM hcir_lines",
    "multiplet_count": H + "SELECT split, line_number, CAST(mult AS BIGINT) AS multiplets FROM hcir_lines",
    "ir_vector_parse": H + """SELECT split, line_number, CAST(pos - 1 AS BIGINT) AS pos,
        CAST(floor(CAST(v AS DOUBLE) * 10000) AS BIGINT) AS value
        FROM (SELECT split, line_number, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM hcir_lines)""",
    "smiles_join": H + "SELECT split, line_number, smiles FROM hcir_lines",
    "peak_pairs": MS + """SELECT o.split, o.line_number, p.energy,
        CAST(row_number() OVER (PARTITION BY p.l_orderkey, p.flag ORDER BY p.mz, p.it) - 1 AS BIGINT) AS peak_idx,
        CAST(p.mz AS BIGINT) AS mz, p.it AS intensity
        FROM (SELECT *, CASE flag WHEN 'A' THEN 'E10Pos' WHEN 'N' THEN 'E20Pos' ELSE 'E40Pos' END AS energy FROM ms_peaks) p
        JOIN msms_lines o ON o.o_orderkey = p.l_orderkey WHERE o.has_a AND o.has_n AND o.has_r""",
    "positive_peaks": MS + """SELECT o.split, o.line_number, p.energy,
        CAST(row_number() OVER (PARTITION BY p.l_orderkey, p.flag ORDER BY p.mz, p.it) - 1 AS BIGINT) AS peak_idx,
        CAST(p.mz AS BIGINT) AS mz, p.it AS intensity
        FROM (SELECT *, CASE flag WHEN 'A' THEN 'E10Pos' WHEN 'N' THEN 'E20Pos' ELSE 'E40Pos' END AS energy
              FROM ms_peaks WHERE it <> 0) p
        JOIN msms_lines o ON o.o_orderkey = p.l_orderkey WHERE o.has_a AND o.has_n AND o.has_r""",
    "zero_peaks_removed": MS + "SELECT split, line_number, CAST(n_zero AS BIGINT) AS zero_peaks FROM msms_rules WHERE rule IS NULL",
    # ---------------------------------------------------------------- C
    "err_missing_marker": H + "SELECT split, line_number, message FROM hcir_bad WHERE rule = 'C1'",
    "err_marker_order": H + "SELECT split, line_number, message FROM hcir_bad WHERE rule = 'C2'",
    "err_empty_sections": H + "SELECT split, line_number, rule, message FROM hcir_bad WHERE rule IN ('C3', 'C4', 'C8')",
    "err_ir_vector": H + "SELECT split, line_number, rule, message FROM hcir_bad WHERE rule IN ('C5', 'C6', 'C7')",
    "err_spectrum": MS + "SELECT split, line_number, rule, message FROM msms_rules WHERE rule = 'C14'",
    "err_spectrum_values": """WITH o AS (SELECT *, o_orderkey % 20 AS fault, o_custkey % 50 + 10 AS low FROM orders WHERE o_orderkey % 20 < 15),
        n AS (SELECT *, fault // 3 + 9 AS rule_no, CASE fault % 3 WHEN 0 THEN 'E10Pos' WHEN 1 THEN 'E20Pos' ELSE 'E40Pos' END AS marker FROM o)
        SELECT CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
          CASE WHEN o_orderkey % 10 < 8 THEN o_orderkey // 10 * 8 + o_orderkey % 10 + 1 ELSE o_orderkey // 10 + 1 END AS line_number,
          'C' || CAST(rule_no AS VARCHAR) AS rule,
          CASE rule_no WHEN 9 THEN marker || ' does not contain m/z-intensity pairs'
            WHEN 10 THEN 'could not convert string to float: ''x'''
            WHEN 11 THEN marker || ' contains a non-finite peak'
            WHEN 12 THEN marker || ' contains an invalid peak: ' || CAST(low AS VARCHAR) || '.0, -5.0'
            ELSE marker || ' m/z values are not sorted' END AS message FROM n""",
    "rejects": H + "SELECT split, line_number, message AS error FROM hcir_bad WHERE rule IS NOT NULL",
    "err_unknown_molecule": MS + "SELECT split, line_number, message FROM msms_rules WHERE rule = 'C15'",
    "first_error_per_split": H + """SELECT split, line_number, split || ' line ' || CAST(line_number AS VARCHAR) || ': ' || message AS message
        FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY line_number) AS rn FROM hcir_bad WHERE rule IS NOT NULL)
        WHERE rn = 1""",
    "alignment_gap": """SELECT 'train' AS split, min(line_number) AS line_number,
        'train source/target mismatch at line ' || CAST(min(line_number) AS VARCHAR) AS message
        FROM (SELECT coalesce(d.doc_id, l.doc_id) + 1 AS line_number FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id
              WHERE d.doc_id IS NULL OR l.doc_id IS NULL)
        HAVING count(*) > 0""",
    "formula_mismatches": MS + "SELECT split, line_number, payload, ref_formula AS reference, smiles FROM msms_rules WHERE rule IS NULL AND payload <> ref_formula",
    # ---------------------------------------------------------------- D
    "align_full_outer": """SELECT coalesce(d.doc_id, l.doc_id) + 1 AS line_number, d.doc_id IS NOT NULL AS has_source,
        l.doc_id IS NOT NULL AS has_target FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""",
    "enrich_join": MS + "SELECT split, line_number, smiles, ref_formula, fp_bits FROM msms_rules WHERE rule IS NULL",
    "verify_counts": MS + """SELECT split, expected, actual, expected = actual AS ok FROM (
        SELECT split, CASE WHEN split = 'test' THEN count(*) FILTER (WHERE rule IS NULL) ELSE count(*) END AS expected,
          count(*) FILTER (WHERE rule IS NULL) AS actual FROM msms_rules WHERE rule IS DISTINCT FROM 'C17' GROUP BY split)""",
    # ---------------------------------------------------------------- E
    "hcir_split_summary": H + "SELECT split, count(*) AS molecules_written, CAST(sum(mult) AS BIGINT) AS multiplets_written FROM hcir_lines GROUP BY split",
    "ir_length_histogram": H + """SELECT split, CASE WHEN k = 46 THEN '3' ELSE CAST(ir_len AS VARCHAR) END AS ir_length, count(*) AS molecules
        FROM hcir_bad WHERE rule IS NULL OR rule = 'C7' GROUP BY ALL""",
    "verify_lengths": H + """SELECT split, count(*) AS molecules, count(*) FILTER (WHERE rule IS NULL) AS at_expected,
        CAST(count(DISTINCT CASE WHEN rule = 'C7' THEN 3 END) AS BIGINT) AS other_lengths,
        count(DISTINCT CASE WHEN rule = 'C7' THEN 3 END) = 0 AS ok
        FROM hcir_bad WHERE rule IS NULL OR rule = 'C7' GROUP BY split""",
    "msms_split_summary": MS + """SELECT split, count(*) AS molecules_scanned, count(*) AS molecules_written,
        CAST(sum(n_zero) AS BIGINT) AS zero_intensity_peaks_removed,
        count(*) FILTER (WHERE payload <> ref_formula) AS formula_mismatches,
        count(*) AS "E10Pos", count(*) AS "E20Pos", count(*) AS "E40Pos", 3 * count(*) AS spectra_written
        FROM msms_rules WHERE rule IS NULL GROUP BY split""",
    "energy_counts": MS + """SELECT split, count(*) FILTER (WHERE energy = 'E10Pos') AS "E10Pos",
        count(*) FILTER (WHERE energy = 'E20Pos') AS "E20Pos", count(*) FILTER (WHERE energy = 'E40Pos') AS "E40Pos",
        count(*) AS spectra_written FROM msms_spectra GROUP BY split""",
    "dataset_totals": MS + "SELECT count(*) AS total_molecules, 3 * count(*) AS total_spectra FROM msms_rules WHERE rule IS NULL",
    "mismatch_examples": MS + """SELECT split, rank, line_number, payload, reference, smiles FROM (
        SELECT split, row_number() OVER (PARTITION BY split ORDER BY line_number) AS rank, line_number, payload,
               ref_formula AS reference, smiles
        FROM msms_rules WHERE rule IS NULL AND payload <> ref_formula) WHERE rank <= 10""",
    "verify_summary": MS + """SELECT split, split = 'test' OR count(*) FILTER (WHERE rule IS NULL) = count(*) AS molecules_ok,
        split = 'test' OR count(*) FILTER (WHERE rule IS NULL) = count(*) AS spectra_ok,
        count(*) FILTER (WHERE rule IS NULL AND payload <> ref_formula) = 0 AS mismatches_ok
        FROM msms_rules WHERE rule IS DISTINCT FROM 'C17' GROUP BY split""",
    # ---------------------------------------------------------------- F, G
    "first_n_per_split": H + "SELECT split, line_number, formula AS molecular_formula FROM hcir_lines WHERE line_number <= 100",
    "eval_subset_hcir": H + "SELECT line_number, formula AS molecular_formula, smiles FROM hcir_lines WHERE split = 'test' AND line_number <= 32",
    "explode_energies": MS + """SELECT split, vline AS line_number, CAST(energy_ord AS BIGINT) AS energy_ord, energy,
        CAST(n_peaks AS BIGINT) AS n_peaks, payload AS formula, smiles, spectrum_text FROM msms_spectra""",
    "eval_subset_msms": MS + """SELECT vline AS line_number, energy, CAST(n_peaks AS BIGINT) AS n_peaks FROM msms_spectra
        WHERE split = 'test' AND (vline - 1) * 3 + energy_ord < 2048""",
    "stage_msms": MS + """, clean AS (
        SELECT *, row_number() OVER (PARTITION BY split ORDER BY vline) AS cline FROM msms_valid WHERE payload = ref_formula),
      spectra AS (SELECT split, cline, 0 AS e, payload, smiles, s10 AS t FROM clean
        UNION ALL SELECT split, cline, 1, payload, smiles, s20 FROM clean
        UNION ALL SELECT split, cline, 2, payload, smiles, s40 FROM clean)
      SELECT split, payload AS formula, smiles, t AS spectrum_text FROM spectra WHERE split <> 'test' OR (cline - 1) * 3 + e < 100""",
    # ---------------------------------------------------------------- W, K
    "consecutive_runs": """WITH e AS (SELECT user_id, event_id, coalesce(value <= 20.0, false) AS p FROM events),
        i AS (SELECT *, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM e),
        r AS (SELECT *, sum(CASE WHEN p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM i)
        SELECT user_id, event_id FROM r WHERE p AND run = 3""",
}
ORACLE["consecutive_runs_hosts"] = """WITH o AS (SELECT 'host-' || CAST(user_id AS VARCHAR) AS host, ts, arg_min(value, event_id) AS value
        FROM events GROUP BY ALL),
    e AS (SELECT host, ts, coalesce(value <= 20.0, false) AS p FROM o),
    i AS (SELECT *, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY ts
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM e),
    r AS (SELECT *, sum(CASE WHEN p THEN 1 ELSE 0 END) OVER (PARTITION BY host, isl ORDER BY ts
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM i)
    SELECT host, count(*) AS firings FROM r WHERE p AND run = 3 GROUP BY host"""
ORACLE["consecutive_runs_stream"] = ORACLE["consecutive_runs"]
ORACLE["enrich_join_sorted"] = ORACLE["enrich_join"]
