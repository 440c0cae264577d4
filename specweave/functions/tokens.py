"""Tokenising and numeric parsing as JVM-side column expressions.

Everything here returns a ``Column``; nothing runs Python per row.  The
expressions mirror Python's ``str.split()`` and ``float()`` (see the
semantic notes in SURVEY §1.5) so that a line is judged the same way a
plain-Python reader would judge it.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the record grammar) ---------------------------
# Marker tokens of the NMR/IR view, in the order they must appear.
HCIR_MARKERS = ("1HNMR", "13CNMR", "IR")
# Collision-energy markers of the MS/MS view, in the order they are emitted.
ENERGY_MARKERS = ("E10Pos", "E20Pos", "E40Pos")
# Marker tokens of the MS/MS view, in the order they must appear.
MSMS_MARKERS = ("1HNMR", "13CNMR", "E10Pos", "E20Pos", "E40Pos", "IR")
# Output split name -> file stem of the source view, in processing order.
SPLITS = {"train": "train", "validation": "val", "test": "test"}
# ---------------------------------------------------------------------------

# Every character Python's str.isspace() accepts, and nothing more:
# Java's \s (ASCII space, \t \n \x0b \f \r), the information separators
# U+001C..U+001F, NEL U+0085 and the Unicode separator categories Z*.
WHITESPACE_RX = r"[\s\x1c-\x1f\x85\p{Z}]+"

# A character that is neither the space nor visible ASCII: a line without one is
# split at its spaces (one range, so the test costs little).
NOT_VISIBLE_RX = "[^ -~]"

# One token Python's float() accepts (decimal digits folded to ASCII and
# underscores removed beforehand).  Possessive quantifiers keep the match linear.
_NUM = r"[+-]?+(?:(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?+\d++)?+|(?i:inf(?:inity)?|nan))"
NUMBER_RX = rf"^{_NUM}$"
# A space-joined run of such tokens (an empty string is not matched).
NUMBER_RUN_RX = rf"^{_NUM}(?: {_NUM})*+$"
# Characters of a plain decimal token.  Over this alphabet Spark's cast and
# Python's float() accept the same strings (no d/f suffixes, hex, words).
NOT_PLAIN_RX = "[^0123456789.eE+-]"
# Python allows one underscore between two digits.
UNDERSCORE_RX = r"(?<=\d)_(?=\d)"


def tokens(c: Column | str) -> Column:
    """``str.split()``: split on any Unicode whitespace and drop empties."""
    c = F.col(c) if isinstance(c, str) else c
    # Lines of visible ASCII and spaces are split without a regex.
    parts = F.when(c.rlike(NOT_VISIBLE_RX), F.split(c, WHITESPACE_RX)).otherwise(F.split(c, " "))
    # array_remove (not a lambda filter) keeps the stage in whole-stage codegen.
    return F.array_remove(parts, "")


@cache
def _decimal_digits() -> tuple[str, str]:
    """Every non-ASCII character that is a decimal digit, and its ASCII digits."""
    found = [(chr(c), str(d)) for c in range(0x80, sys.maxunicode + 1) if (d := unicodedata.decimal(chr(c), None)) is not None]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def fold_digits(t: Column) -> Column:
    """Decimal digits of any script as ASCII ones, as ``float()`` reads them; a
    text of ASCII is not looked up."""
    return F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, *_decimal_digits())).otherwise(t)


def _cast_number(t: Column) -> Column:
    # Spark's cast rejects a signed NaN, Python accepts it.
    return F.when(F.lower(t).isin("nan", "+nan", "-nan"), F.lit(float("nan"))).otherwise(
        t.try_cast("double")
    )


def py_float(token: Column) -> Column:
    """``float(token)`` or NULL where Python would raise ``ValueError``."""
    cleaned = F.regexp_replace(fold_digits(token), UNDERSCORE_RX, "")
    return F.when(cleaned.rlike(NUMBER_RX), _cast_number(cleaned))


def parse_numbers(section: Column) -> Column:
    """Parse an array of tokens to ``array<double>`` with ``float()`` rules.

    Returns a struct ``(ok boolean, values array<double>)``; ``ok`` is false
    when any token is not a Python float (``values`` is then NULL).
    Common case: if every character is a plain decimal character, a cast
    decides.  Otherwise (inf, nan, underscores, junk)
    the whole section is checked by one regex after underscore removal.
    """
    plain_vals = section.try_cast("array<double>")
    plain = plain_decimals(section)
    joined = F.regexp_replace(fold_digits(F.array_join(section, " ")), UNDERSCORE_RX, "")
    empty = F.size(section) == 0
    slow_ok = joined.rlike(NUMBER_RUN_RX)
    values = (
        F.when(empty, F.array().cast("array<double>"))
        .when(plain, plain_vals)
        .when(slow_ok, F.transform(F.split(joined, " "), _cast_number))
    )
    # ``values`` is bound once in a lambda, so the casts run once per token;
    # the regex branch is evaluated only for non-plain sections.
    return F.get(F.transform(F.array(values), lambda v: F.struct(
        F.when(empty, F.lit(True)).when(plain, all_present(v)).otherwise(slow_ok).alias("ok"),
        F.when(all_present(v), v).alias("values"),
    )), 0)


def plain_decimals(section: Column) -> Column:
    """Whether the tokens hold characters of plain decimals only."""
    return ~F.array_join(section, "").rlike(NOT_PLAIN_RX)


def all_present(arr: Column) -> Column:
    """No NULL element (without a lambda, so it stays code-generated)."""
    return F.size(F.array_compact(arr)) == F.size(arr)


def marker_position(toks: Column, marker: str) -> Column:
    """1-based index of the first occurrence of ``marker``; NULL if absent."""
    return F.nullif(F.array_position(toks, F.lit(marker)), F.lit(0))


def marker_positions(toks: Column, markers=HCIR_MARKERS) -> Column:
    """Struct of first positions, one field per marker."""
    return F.struct(*[marker_position(toks, m).alias(m) for m in markers])


def section(toks: Column, lo: Column, hi: Column | None = None) -> Column:
    """Tokens strictly between 1-based positions ``lo`` and ``hi``.

    ``hi`` NULL means "to the end".  Callers only evaluate this when the
    markers are known to be in order, so the slice length is never
    negative (ANSI mode would raise).
    """
    if hi is None:
        length = F.size(toks) - lo
    else:
        length = hi - lo - F.lit(1)
    return F.slice(toks, lo + F.lit(1), F.greatest(length, F.lit(0)))


def prefix(toks: Column, hi: Column) -> Column:
    """Tokens before 1-based position ``hi``."""
    return F.slice(toks, F.lit(1), F.greatest(hi - F.lit(1), F.lit(0)))


def formula(toks: Column, first_marker: Column) -> Column:
    """Formula = tokens before the first marker joined with no separator."""
    return F.array_join(prefix(toks, first_marker), "")


def h_nmr_text(h_tokens: Column) -> Column:
    """``"1HNMR "`` followed by the 1H tokens joined by single spaces."""
    return F.concat(F.lit("1HNMR "), F.array_join(h_tokens, " "))


def multiplet_count(text: Column) -> Column:
    """Number of ``|`` characters plus one (characters, not tokens)."""
    return F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) + F.lit(1)


def smiles(target: Column | str) -> Column:
    """Target SMILES = target tokens joined with no separator."""
    return F.array_join(tokens(target), "")


def split_label(c: Column | str) -> Column:
    """Output split name -> file stem (``validation`` -> ``val``)."""
    c = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    return m[c]


def split_order(c: Column | str) -> Column:
    """Processing order of a split (train 0, validation 1, test 2)."""
    c = F.col(c) if isinstance(c, str) else c
    expr = None
    for i, name in enumerate(SPLITS):
        expr = F.when(c == name, F.lit(i)) if expr is None else expr.when(c == name, F.lit(i))
    return expr.otherwise(F.lit(len(SPLITS)))
