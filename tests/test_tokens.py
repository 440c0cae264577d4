"""Tokeniser and float parsing agree with Python's str.split() / float()."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specweave.functions import tokens as T

TOKENS = ["1_000", "1d", "1.0D", "0x1p3", "nan", "-NaN", "+nan", "inf", "-Infinity", "1e400", "-0.0",
          "1.", "1.e5", ".5", "1__0", "_1", "1_", "e5", "1e", "+-1", "1e1_0", "1.0_1", "x", "1_.0",
          "12", "-3.25e-7", "INF", "+1", ".", "-"]


def _py(t):
    try:
        return float(t)
    except ValueError:
        return None


def _same(a, b):
    if a is None or b is None:
        return a is None and b is None
    return (math.isnan(a) and math.isnan(b)) or a == b


def test_py_float_matches_python(spark):
    df = spark.createDataFrame([(t,) for t in TOKENS], "t string")
    for r in df.select("t", T.py_float(F.col("t")).alias("v")).collect():
        assert _same(_py(r.t), r.v), r.t


def test_parse_numbers_fast_and_slow_paths(spark):
    cases = [["1", "2_0", "nan"], ["1", "x"], [], ["1", "2", "3"], ["1d"], ["inf", "-1e3"], ["."]]
    df = spark.createDataFrame([(c,) for c in cases], "a array<string>")
    rows = df.select(T.parse_numbers(F.col("a")).alias("p")).collect()
    for case, r in zip(cases, rows):
        exp = [_py(t) for t in case]
        ok = all(v is not None for v in exp)
        assert r.p.ok == ok, case
        if ok:
            assert all(_same(a, b) for a, b in zip(exp, r.p["values"])), case


WS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0        　"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1.|") + list(WS) + ["​", "﻿"]), max_size=12),
                min_size=1, max_size=8))
def test_tokens_match_str_split(spark, parts):
    lines = ["".join(parts)]
    df = spark.createDataFrame([(s,) for s in lines], "s string")
    got = df.select(T.tokens(F.col("s")).alias("t")).first().t
    assert got == lines[0].split()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=False, width=64).map(repr), st.integers().map(str),
                          st.sampled_from(TOKENS)), min_size=1, max_size=6))
def test_py_float_property(spark, toks):
    df = spark.createDataFrame([(t,) for t in toks], "t string")
    for r in df.select("t", T.py_float(F.col("t")).alias("v")).collect():
        assert _same(_py(r.t), r.v), r.t


def test_py_repr_double_normal_range(spark):
    """Spark-side repr text equals Python's for doubles in [1e-300, 1e15].

    (Outside that range JDK 17 may print non-shortest digits; the raised
    fatal message is formatted by Python, see README deviations.)
    """
    import random

    from specweave.functions.spectra import py_repr_double

    rnd = random.Random(11)
    vals = [0.0, -0.0, 1.0, 100.0, 1e-05, 0.0001, 0.001, 12345678.0, 1e15, -2.5e-07, 0.1, 2 / 3]
    vals += [rnd.choice([1, -1]) * 10 ** rnd.uniform(-300, 15) for _ in range(1500)]
    vals += [round(rnd.uniform(-1e6, 1e6), rnd.randint(0, 6)) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = df.select("x", py_repr_double(F.col("x")).alias("r")).collect()
    assert [r.r for r in rows] == [repr(r.x) for r in rows]


def test_repr_of_random_doubles_is_exact(spark):
    """Fewest digits that cast back, also beyond 1e16 and for subnormals."""
    import random
    import struct

    from specweave.functions.spectra import py_repr_double

    rng = random.Random(11)
    values = [struct.unpack("<d", rng.getrandbits(64).to_bytes(8, "little"))[0] for _ in range(80_000)]
    values += [rng.getrandbits(52) * 5e-324 * (-1) ** i for i in range(20_000)]  # subnormals
    values += [float(i) * 5e-324 for i in range(2000)] + [rng.random() * 10 ** rng.randint(14, 25) for _ in range(10_000)]
    values += [float(2**i) for i in range(1024)] + [10.0**i for i in range(-323, 309)] + [2e23, 1e23, 9.5e-310, 1.7976931348623157e308, 0.0, -0.0, 9999999999999998.0]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", py_repr_double(F.col("x")).alias("t"))
    wrong = [(r.x, r.t) for r in df.collect() if r.t != repr(r.x)]
    assert not wrong, (len(wrong), wrong[:5])


def test_decimal_digits_of_all_scripts(spark):
    import sys
    import unicodedata

    texts = [chr(c) + "." + chr(c) for c in range(sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) is not None]
    texts += ["١٢٣", "-١_٠e٢", "１２．５", "٣.x", "²", "Ⅷ", "٫٥", "١_", "𝟙𝟚", "+𝟎.𝟓E-𝟏", "中"]

    def parsed(t):
        try:
            return float(t)
        except ValueError:
            return None

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.py_float(F.col("t")).alias("x"), T.parse_numbers(F.array(F.lit("1"), F.col("t"))).alias("s")).collect()
    for r in got:
        want = parsed(r.t)
        assert r.x == want and r.s.ok == (want is not None) and r.s["values"] == (None if want is None else [1.0, want]), r
