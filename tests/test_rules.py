"""Table-driven rule cases with the exact messages (FIXTURES.md §4)."""

from pyspark.sql import functions as F

from specweave.operators import rules as R

GOOD_H = "1.2 t 3"


def msms_line(e10, e20="29.0 40", e40="29.0 100", formula="C 2", h="1.2 t 3", c="18.0", ir="0.1"):
    return f"{formula} 1HNMR {h} 13CNMR {c} E10Pos {e10} E20Pos {e20} E40Pos {e40} IR {ir}".replace("  ", " ")


SPECTRUM_CASES = [
    ("", "E10Pos does not contain m/z-intensity pairs"),
    ("10 1 20", "E10Pos does not contain m/z-intensity pairs"),
    ("10 x", "could not convert string to float: 'x'"),
    ("10 1d", "could not convert string to float: '1d'"),
    ("1_0 1", None),
    ("nan 1", "E10Pos contains a non-finite peak"),
    ("10 inf", "E10Pos contains a non-finite peak"),
    ("1e400 1", "E10Pos contains a non-finite peak"),
    ("0 1", "E10Pos contains an invalid peak: 0.0, 1.0"),
    ("10 -1", "E10Pos contains an invalid peak: 10.0, -1.0"),
    ("20 1 10 1", "E10Pos m/z values are not sorted"),
    ("20 0 10 1", "E10Pos m/z values are not sorted"),
    ("10 1 10 2", None),
    ("10 0 20 -0.0", "E10Pos has no positive-intensity peaks"),
    ("10 0 20 3", None),
    ("1e-05 -2.5e-07", "E10Pos contains an invalid peak: 1e-05, -2.5e-07"),
    ("a'b 1", "could not convert string to float: \"a'b\""),
]


def _parse_msms(spark, rows):
    df = spark.createDataFrame(rows, "split string, line_number long, source string, target string")
    return R.parse_msms(df)


def test_spectrum_rules(spark):
    rows = [("train", i + 1, msms_line(tok), "C C O") for i, (tok, _) in enumerate(SPECTRUM_CASES)]
    got = {r.line_number: (r.error.message if r.error else None) for r in _parse_msms(spark, rows).collect()}
    for i, (tok, expected) in enumerate(SPECTRUM_CASES):
        assert got[i + 1] == expected, tok


def test_spectrum_values(spark):
    r = _parse_msms(spark, [("train", 1, msms_line("10 0 20 3"), "C C O")]).first()
    assert [(p.mz, p.intensity) for p in r.peaks_E10Pos] == [(20.0, 3.0)]
    assert r.zero_peaks == 1
    r = _parse_msms(spark, [("train", 1, msms_line("1_0 1"), "C C O")]).first()
    assert r.peaks_E10Pos[0].mz == 10.0


def test_msms_precedence(spark):
    rows = [
        ("train", 1, msms_line("0 1", e20="10 1 20"), "C C O"),           # E10 wins over E20
        ("train", 2, msms_line("10 1 20"), " "),                           # spectrum wins over target
        ("train", 3, msms_line("10 1", formula=""), "C"),                  # formula before spectra
        ("train", 4, "C 1HNMR 13CNMR E10Pos 1 1 E20Pos 1 1 IR E40Pos 1 1", "C"),  # order
        ("train", 5, "C 1HNMR 13CNMR E10Pos 1 1 E20Pos 1 1 IR", "C"),      # missing E40Pos
        ("train", 6, "C 2 1HNMR 13CNMR E10Pos 10 1 E20Pos 10 1 E40Pos 10 1 IR", "C C O"),  # empty 1H/IR legal
        ("train", 7, msms_line("10 1"), "  "),
    ]
    got = {r.line_number: (r.error.message if r.error else None) for r in _parse_msms(spark, rows).collect()}
    assert got == {
        1: "E10Pos contains an invalid peak: 0.0, 1.0",
        2: "E10Pos does not contain m/z-intensity pairs",
        3: "molecular formula is empty",
        4: "source modality markers are out of order",
        5: "missing marker E40Pos",
        6: None,
        7: "target SMILES is empty",
    }


HCIR_CASES = [
    ("C 2 H 6 O 1HNMR 1.2 t 3 | 3.7 q 2 13CNMR 18.0 57.8 IR 0.10 0.25 0.00", "C C O", None),
    ("C 1HNMR 1.2 IR 1 13CNMR 1", "C", "source modality markers are out of order"),
    ("C 1HNMR 1.2 13CNMR IR 1 IR", "C", "IR contains a non-numeric value"),
    ("C 1HNMR 1.2 13CNMR IR nan inf -1e3", "C", None),
    ("C 1HNMR 1.2 13CNMR IR", "C", "IR is empty"),
    ("C 1HNMR 13CNMR IR 1", "C", "1HNMR is empty"),
    ("1HNMR 1 13CNMR IR 1", "C", "molecular formula is empty"),
    ("C 1HNMR 1 IR 1", "C", "missing marker 13CNMR"),
    ("", "C", "missing marker 1HNMR"),
    ("C 1HNMR 1 13CNMR IR 1", " \t", "target SMILES is empty"),
    ("C 1HNMR 1 13CNMR IR x", " ", "IR contains a non-numeric value"),
]


def test_hcir_rules(spark):
    rows = [("train", i + 1, s, t) for i, (s, t, _) in enumerate(HCIR_CASES)]
    df = spark.createDataFrame(rows, "split string, line_number long, source string, target string")
    got = {r.line_number: (r.error.message if r.error else None) for r in R.parse_hcir(df).collect()}
    for i, (src, _, expected) in enumerate(HCIR_CASES):
        assert got[i + 1] == expected, src


def test_hcir_values_and_length_rule(spark):
    src = "C 2 H 6 O 1HNMR 1.2 t 3 | 3.7 q 2 13CNMR 18.0 57.8 IR 0.10 0.25 0.00"
    df = spark.createDataFrame([("train", 1, src, "C C O")], "split string, line_number long, source string, target string")
    r = R.parse_hcir(df).first()
    assert r.molecular_formula == "C2H6O"
    assert r.h_nmr_text == "1HNMR 1.2 t 3 | 3.7 q 2"
    assert r.multiplets == 2
    assert [round(x, 6) for x in r.ir_spectra] == [0.1, 0.25, 0.0]
    assert r.smiles == "CCO"
    r = R.parse_hcir(df, expected_ir_length=4).first()
    assert r.error.message == "IR length mismatch: expected 4, got 3"


def test_fatal_message_uses_python_repr():
    err = {"rule": "C12", "message": "E20Pos", "mz": 1e-05, "intensity": -2.5e-07, "token": None}
    assert R.format_fatal("validation", 7, err) == "validation line 7: E20Pos contains an invalid peak: 1e-05, -2.5e-07"
    gap = {"rule": "C17", "message": "test source/target mismatch at line 3", "mz": None, "intensity": None}
    assert R.format_fatal("test", 3, gap) == "test source/target mismatch at line 3"


def test_first_error_per_split(spark):
    rows = [("train", 3, "C 1HNMR 1 13CNMR IR", "C"), ("train", 2, "C 1HNMR 1 IR 1", "C"),
            ("test", 5, "C 1HNMR 1 13CNMR IR 1", "C")]
    df = spark.createDataFrame(rows, "split string, line_number long, source string, target string")
    got = {r.split: (r.line_number, r.message) for r in R.first_error_per_split(R.parse_hcir(df)).collect()}
    assert got == {"train": (2, "missing marker 13CNMR")}
