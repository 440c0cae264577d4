"""Peak-list expressions: pairing, filtering, counting, sink layout.

A spectrum section is an array of tokens ``mz intensity mz intensity ...``.
Internally peaks are ``array<struct<mz double, intensity double>>``; the
sink wants ``array<array<double>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import all_present, plain_decimals, py_float

PEAK_TYPE = "array<struct<mz:double,intensity:double>>"


def _peak_count(toks: Column) -> Column:
    return F.floor(F.size(toks) / F.lit(2)).cast("int")


def _pair_indexes(toks: Column) -> Column:
    # 0 .. n/2-1, only for an even, non-empty token list; ``sequence``
    # would count down (or raise) otherwise.
    return F.when(
        (F.size(toks) > 0) & (F.size(toks) % 2 == 0),
        F.sequence(F.lit(0), _peak_count(toks) - F.lit(1)),
    )


def pair_peaks(toks: Column) -> Column:
    """Pair tokens into ``(mz, intensity)`` structs using ``float()`` rules.

    NULL when the token count is zero or odd.  A token Python cannot parse
    gives a NULL field (the rule layer reports it).
    """
    return F.transform(
        _pair_indexes(toks),
        lambda k: F.struct(
            py_float(F.get(toks, k * 2)).alias("mz"),
            py_float(F.get(toks, k * 2 + 1)).alias("intensity"),
        ),
    )


def plain_values(toks: Column) -> Column:
    """Cast every token; NULL array unless all tokens are plain decimals.

    Over the characters ``0-9 . e E + -`` Spark's cast and Python's
    ``float()`` accept exactly the same tokens with the same value, so a
    plain cast decides.
    """
    return F.when(plain_decimals(toks), toks.try_cast("array<double>"))


def pair_values(vals: Column, toks: Column) -> Column:
    """Pair an already parsed value array (a column, evaluated once) into
    ``(mz, intensity)`` structs; NULL when any value is NULL or the token
    count is zero or odd."""
    return F.when(
        all_present(vals),
        F.transform(
            _pair_indexes(toks),
            lambda k: F.struct(F.get(vals, k * 2).alias("mz"), F.get(vals, k * 2 + 1).alias("intensity")),
        ),
    )


def positive_peaks(peaks: Column) -> Column:
    """Drop zero-intensity peaks, keep order (negatives are rejected earlier).

    When no intensity is zero the array is returned as is, without
    evaluating the filter lambda."""
    return F.when(F.array_min(peaks["intensity"]) > 0, peaks).otherwise(
        F.filter(peaks, lambda p: p["intensity"] != F.lit(0.0)))


def zero_peak_count(peaks: Column) -> Column:
    """How many zero-intensity peaks a spectrum loses (``-0.0`` counts)."""
    return F.when(F.array_min(peaks["intensity"]) > 0, F.lit(0)).otherwise(
        F.size(F.filter(peaks, lambda p: p["intensity"] == F.lit(0.0))))


def peaks_as_arrays(peaks: Column) -> Column:
    """``[{mz, intensity}]`` -> ``[[mz, intensity]]`` for the Parquet sink."""
    return F.transform(peaks, lambda p: F.array(p["mz"], p["intensity"]))


def py_repr_double(x: Column) -> Column:
    """Python ``repr(float)`` text (see :func:`_py_repr_double`).

    The layout logic is bound inside a one-element ``transform`` lambda:
    it is evaluated (interpreted) only where a message is rendered and does
    not bloat the generated code of the surrounding stage.
    """
    return F.get(F.transform(F.array(x.cast("double")), _py_repr_double), 0)


def _py_repr_double(x: Column) -> Column:
    """Python ``repr(float)`` text for a double, built from Java's text.

    Java's digits give the double back, but before JDK 19 they are not always the
    fewest (:func:`_fewest_digits` finds those); the layouts differ as well (Java:
    plain for 1e-3 <= |x| < 1e7, Python: plain for 1e-4 <= |x| < 1e16; exponent
    style ``E-5`` vs ``e-05``).  We rebuild the digit string and decimal exponent
    and lay them out Python's way.
    """
    s = x.cast("string")
    neg = s.startswith("-")
    a = F.regexp_replace(s, "^-", "")
    sci = a.contains("E")
    mant = F.when(sci, F.substring_index(a, "E", 1)).otherwise(a)
    ip = F.substring_index(mant, ".", 1)
    fp = F.substring_index(mant, ".", -1)
    fp_lead = F.length(fp) - F.length(F.regexp_replace(fp, "^0+", ""))
    zero_ip = ip == F.lit("0")
    digits_raw = F.when(zero_ip, F.regexp_replace(fp, "^0+", "")).otherwise(F.concat(ip, fp))
    digits = F.regexp_replace(digits_raw, "0+$", "")
    exp = F.when(sci, F.substring_index(a, "E", -1).cast("int") + F.length(ip) - F.lit(1)).when(
        zero_ip, -(fp_lead + F.lit(1))
    ).otherwise(F.length(ip) - F.lit(1))
    size = F.abs(x)
    whole = (size >= F.lit(float(2**53))) & (size < F.lit(1e38))
    exact = F.when(whole, _exact_digits(size))
    parts = _let(exact, lambda e: F.struct(F.coalesce(F.regexp_replace(e, "0+$", ""), digits).alias("digits"),
                                           F.coalesce(F.length(e) - F.lit(1), exp).alias("exp"), size.alias("size")))
    return _let(parts, lambda p: _let(_fewest_digits(p["digits"], p["exp"], p["size"]), lambda d: _laid_out(x, neg, d["digits"], d["exp"])))


def _exact_digits(size: Column) -> Column:
    """All digits of a double from 2^53 to 1e38, which is a whole number: 53 bits
    times a power of two, multiplied out in decimals.  (Java's digits may be off by
    one in the last place there.)"""
    def of(k: Column) -> Column:
        bits = (size / F.pow(F.lit(2.0), k)).cast("long").cast("decimal(17,0)")
        twos = [F.pow(F.lit(2.0), n).cast("long").cast("decimal(10,0)") for n in _thirds(k)]
        return ((bits * twos[0]).cast("decimal(38,0)") * twos[1]).cast("decimal(38,0)") * twos[2]

    power = F.greatest(F.lit(0), F.floor(F.log2(size)).cast("int") - F.lit(53))  # a bit to spare
    return _let(power, lambda k: F.regexp_replace(of(k).cast("decimal(38,0)").cast("string"), "^0+", ""))


def _thirds(k: Column) -> list[Column]:
    """Three numbers of at most 31 that add up to ``k`` (at most 93)."""
    first = F.least(k, F.lit(31))
    second = F.least(k - first, F.lit(31))
    return [first, second, k - first - second]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _fewest_digits(digits: Column, exp: Column, size: Column) -> Column:
    """``(digits, exp)`` of the shortest decimal d.ddd * 10^exp that casts back to
    ``size``; of two of one length the one nearer to the given digits."""
    def text(n: Column, d: Column) -> Column:
        return F.concat(n.cast("string"), F.lit("e"), (exp - d + F.lit(1)).cast("string"))

    def attempt(d: Column) -> Column:
        low = F.substring(digits, F.lit(1), d).try_cast("long")
        up = F.substring(digits, d + F.lit(1), F.lit(1)) >= F.lit("5")
        pair = F.struct(F.when(up, low + 1).otherwise(low).alias("near"), F.when(up, low).otherwise(low + 1).alias("far"))
        hit = _let(pair, lambda p: F.when(text(p["near"], d).try_cast("double") == size, p["near"]).when(
            text(p["far"], d).try_cast("double") == size, p["far"]))
        return _let(hit, lambda h: F.when(h.isNotNull(), F.struct(h.cast("string").alias("n"), d.alias("d"))))

    tries = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(digits), F.lit(17)))), attempt)
    def chosen(best: Column) -> Column:
        found = F.struct(F.regexp_replace(best["n"], "0+$", "").alias("digits"), (exp + F.length(best["n"]) - best["d"]).alias("exp"))
        return F.when((digits == F.lit("")) | best.isNull(), F.struct(digits.alias("digits"), exp.alias("exp"))).otherwise(found)

    return _let(F.get(F.filter(tries, lambda t: t.isNotNull()), 0), chosen)


def _laid_out(x: Column, neg: Column, digits: Column, exp: Column) -> Column:
    d_len = F.length(digits)
    fixed_pos = F.when(
        d_len <= exp + F.lit(1), F.concat(F.rpad(digits, exp + F.lit(1), "0"), F.lit(".0"))
    ).otherwise(
        F.concat(F.substring(digits, F.lit(1), exp + F.lit(1)), F.lit("."),
                 F.substring(digits, exp + F.lit(2), F.lit(1 << 20)))
    )
    fixed_neg = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - F.lit(1)), digits)
    sci_txt = F.concat(
        F.substring(digits, 1, 1),
        F.when(d_len > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.lit(1 << 20)))).otherwise(F.lit("")),
        F.lit("e"),
        F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
        F.when(F.abs(exp) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(exp).cast("string"),
    )
    body = F.when(digits == F.lit(""), F.lit("0.0")).when(
        (exp >= -4) & (exp < 16), F.when(exp >= 0, fixed_pos).otherwise(fixed_neg)
    ).otherwise(sci_txt)
    signed = F.concat(F.when(neg, F.lit("-")).otherwise(F.lit("")), body)
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == F.lit(float("inf")), F.lit("inf"))
        .when(x == F.lit(float("-inf")), F.lit("-inf"))
        .otherwise(signed)
    )


def py_repr_str(t: Column) -> Column:
    """Python ``repr(str)`` for a printable token (quote choice + escapes)."""
    return F.get(F.transform(F.array(t), _py_repr_str), 0)


def _py_repr_str(t: Column) -> Column:
    esc = F.replace(t, F.lit("\\"), F.lit("\\\\"))
    use_double = t.contains("'") & ~t.contains('"')
    return F.when(use_double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
