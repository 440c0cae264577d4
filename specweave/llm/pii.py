"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each whole text once and reports anchors:
at-signs, plus signs, digits, URL schemes and identifier cue words. A local
deterministic parser then expands every anchor to the left and right and
validates what it finds. Nothing is shuffled; a row needs only its own text,
so hot sources and groups of copies cost no more than other rows.

Base kinds, leftmost and non-overlapping within a kind (a candidate that fails
its check is dropped, and the search goes on behind it):

  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     four dotted decimal parts of at most 255
  card   digits with single spaces or hyphens, 13 to 19 digits, Luhn
  phone  plus, digits, spaces, dots, brackets, hyphens, 9 to 15 digits

Added kinds:

  account  number after an account cue (6 to 18 digits)
  iban     after an IBAN cue, ISO 7064 check 97
  key      access key id: AKIA and 16 upper-case letters or digits
  login    user:password before the at-sign of a URL
  secret   value after password/token/secret and ``=`` or ``:``, at least 8
           characters, one of them a digit

Spans count code points, end exclusive. Null text counts as empty. Rows are
kept one for one: repeated rows, null ids and ties need no special case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import like, need

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("account", "iban", "key", "login", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

# Cue words of identifiers, each in lower, upper and title case.
ACCOUNT_CUES = ("account", "acct", "konto", "ssn", "passport")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey")

SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?: ?(?:no|nr|number|id)\.?)?[ #:.=]{0,3}([0-9](?:[ -]?[0-9]){5,17})(?![0-9])", re.IGNORECASE)
_IBAN = re.compile(r"[ :#.=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_KEY = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")
_LOGIN = re.compile(r"([^\s/@:]+:[^\s/@]+)@")
_SECRET = re.compile(r"""["']?\s{0,2}[:=]\s{0,2}(["']?)([A-Za-z0-9_./+-]{8,})""")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _iban_ok(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for ch in "0123456789":
        a.add_word(ch, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    a.add_word("AKIA", ("key", 4))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("iban", ("iban",))):
        for cue in cues:
            for form in {cue, cue.upper(), cue.title()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


_AUTOMATON = None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text, ordered by kind as listed in KINDS, then start."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    found: dict[str, list[tuple[int, int]]] = {}
    after_email = after_quad = after_card = 0
    taken = dict.fromkeys(ADDED_KINDS, 0)

    def add(kind: str, start: int, end: int) -> None:
        if start >= taken[kind]:
            found.setdefault(kind, []).append((start, end))
            taken[kind] = end

    for last, (anchor, width) in _AUTOMATON.iter(text):
        if anchor == "digit":
            if last >= after_quad:
                m = _QUAD.match(text, last)
                if m is None:
                    after_quad = _DIGITS.match(text, last).end()
                else:
                    after_quad = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                        found.setdefault("ip", []).append(m.span())
            if last >= after_card:
                m = _CARD.match(text, last)
                if m is None:
                    after_card = last + 1
                else:
                    after_card = m.end()
                    if m.end() - last >= 13:
                        digits = m.group().replace(" ", "").replace("-", "")
                        if 13 <= len(digits) <= 19 and luhn(digits):
                            found.setdefault("card", []).append(m.span())
        elif anchor == "at":
            start = last
            while start > after_email and text[start - 1] in _LOCAL:
                start -= 1
            if start < last:
                m = _DOMAIN.match(text, last + 1)
                if m is not None:
                    after_email = m.end()
                    found.setdefault("email", []).append((start, m.end()))
        elif anchor == "plus":
            m = _PHONE.match(text, last)
            if m is not None and 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.setdefault("phone", []).append(m.span())
        else:
            first, behind = last + 1 - width, last + 1
            if anchor != "scheme" and first > 0 and (text[first - 1].isalnum()):
                continue  # the cue is the tail of a longer word
            if anchor == "scheme":
                m = _LOGIN.match(text, behind)
                if m is not None:
                    add("login", *m.span(1))
            elif anchor == "key":
                m = _KEY.match(text, behind)
                if m is not None:
                    add("key", first, m.end())
            elif anchor == "account":
                m = _ACCOUNT.match(text, behind)
                if m is not None:
                    add("account", *m.span(1))
            elif anchor == "iban":
                m = _IBAN.match(text, behind)
                if m is not None:
                    # the longest valid code that ends at a word boundary
                    for end in range(m.end(1), m.start(1) + 14, -1):
                        code = text[m.start(1):end].replace(" ", "")
                        if not text[end - 1].isspace() and not text[end:end + 1].isalnum() and _iban_ok(code):
                            add("iban", m.start(1), end)
                            break
            else:
                m = _SECRET.match(text, behind)
                if m is not None and any(c.isdigit() for c in m.group(2)):
                    add("secret", *m.span(2))
    return [(k, s, e) for k in KINDS for s, e in found.get(k, ())]


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by <KIND> of the
    run's first and longest span."""
    out, at = [], 0
    runs: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if runs and start < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], end)
        else:
            runs.append([kind, start, end])
    for kind, start, end in runs:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])



def _find_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t or "")] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text)."""
    return need(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long"), "text").mapInArrow(_find_batches, SCHEMA)


DIGEST_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's spans, in column expressions."""
    span = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, span), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _mask_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        at = b.schema.get_field_index("text")
        texts = b.column(at).to_pylist()
        masked = []
        for t in texts:
            spans = find_spans(t) if t else []
            masked.append(mask(t, spans) if spans else t)
        columns = [pa.array(masked, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind's placeholder; the other
    columns pass through, except that ``n_chars``, where there is one, becomes
    the new length of each changed text."""
    if len(set(docs.columns)) != len(docs.columns):
        raise ValueError("docs has two columns of one name")
    if "n_chars" not in docs.columns:
        return docs.mapInArrow(_mask_batches, docs.schema)
    kept = "__length_before"
    while kept in docs.columns:
        kept += "_"
    wide = docs.withColumn(kept, F.length("text"))
    out = wide.mapInArrow(_mask_batches, wide.schema)
    length = F.length("text")
    changed = F.col("text").isNotNull() & (length != F.col(kept))
    return like(out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars"))).drop(kept), docs)
