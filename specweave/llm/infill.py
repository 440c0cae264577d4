"""Fill-in-the-middle samples with a sparse index of multibyte characters.

Each text is cut at two unit borders (units are lines or code points) into
prefix, middle and suffix, and written in one of three forms: plain (the text),
psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each part behind
its marker. :func:`restore` rebuilds the text from output and form.

Texts stay UTF-8 bytes in Arrow buffers; nothing is decoded. Of a batch only the
multibyte characters are recorded: their byte positions and the excess of bytes
over characters up to them (:class:`ExceptionIndex`). A cut in code points
becomes one in bytes, or the other way round, by a binary search in that index
and an addition; a batch of ASCII has an empty index, so its cuts are plain
arithmetic.

Draws are the first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``, so
a document is cut alike whatever the partitioning. Null id: an id without
digits (``seed:``). Null text: empty. Empty texts, texts that contain a marker,
and ``100 - rate`` per cent of the others are plain; their part lengths are null.
Repeated rows and ids are cut alike. Other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import need

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE = 100  # per cent of the texts that are cut
SPM_RATE = 50  # per cent of those in the form spm
UNITS = ("lines", "chars")

SAMPLES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class ExceptionIndex:
    """Code points and bytes of a UTF-8 buffer: the multibyte characters only."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)  # a multibyte character's first byte
        lead = data[self.at]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(more)])  # before each of them, and in all
        self.char = self.at - self.excess[:-1]  # their places in code points

    def chars(self, byte):
        """Code points before a byte border."""
        return byte - self.excess[np.searchsorted(self.at, byte)]

    def bytes(self, char):
        """Bytes before a code-point border."""
        return char + self.excess[np.searchsorted(self.char, char)]


def draws(doc_ids: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers of each id."""
    found = b"".join([hashlib.sha256(b"%d:%s" % (seed, b"" if i is None else b"%d" % i)).digest()[:16] for i in doc_ids])
    return np.frombuffer(found, ">u4").astype(np.int64).reshape(-1, 4)


def _borders(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, index: ExceptionIndex, units: str):
    """Units of each text, and the byte border behind the first k units of each."""
    if units == "chars":
        first = index.chars(starts)
        return index.chars(ends) - first, lambda k: index.bytes(first + k)
    newline = np.flatnonzero(data == 10)
    before = np.searchsorted(newline, starts)
    whole = np.searchsorted(newline, ends) - before
    closed = np.zeros(len(starts), bool)  # the text ends with a newline
    some = ends > starts
    closed[some] = data[ends[some] - 1] == 10
    n = whole + (some & ~closed)
    behind = np.concatenate([newline + 1, [0]])  # one more, for the index of texts behind the last newline

    def border(k: np.ndarray) -> np.ndarray:
        inner = behind[np.minimum(before + np.maximum(k, 1) - 1, len(newline))]
        return np.where(k == 0, starts, np.where(k <= whole, inner, ends))

    return n, border


def _sample_batches(units: str, rate: int, spm_rate: int, seed: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for b in batches:
            docs, texts = b.column("doc_id"), b.column("text").cast(pa.large_binary()).fill_null(b"")
            if not len(texts):
                continue
            _, offsets, buffer = texts.buffers()
            data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
            places = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
            starts, ends = places[:-1], places[1:]
            index = ExceptionIndex(data)
            n, border = _borders(data, starts, ends, index, units)
            h = draws(docs.to_pylist(), seed)
            a, z = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            one, two = border(np.minimum(a, z)), border(np.maximum(a, z))
            prefix, middle = index.chars(one) - index.chars(starts), index.chars(two) - index.chars(one)
            whole = data.tobytes()
            bare = np.array([any(m in whole[s:e] for m in marks) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], bool)
            plain = bare | (starts == ends) | (h[:, 2] % 100 >= rate)
            form = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm_rate, "spm", "psm"))
            out = []
            for kind, s, p, q, e in zip(form.tolist(), starts.tolist(), one.tolist(), two.tolist(), ends.tolist(), strict=True):
                if kind == "plain":
                    out.append(whole[s:e])
                elif kind == "psm":
                    out.append(b"".join([marks[0], whole[s:p], marks[1], whole[q:e], marks[2], whole[p:q]]))
                else:
                    out.append(b"".join([marks[1], whole[q:e], marks[0], whole[s:p], marks[2], whole[p:q]]))
            yield pa.RecordBatch.from_arrays([
                docs, pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(prefix, pa.int64(), mask=plain),
                pa.array(middle, pa.int64(), mask=plain), _strings(out),
            ], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def _strings(values: list[bytes]):
    """UTF-8 bytes as a string column, taken as they are (Spark may hold bytes
    that are no valid UTF-8)."""
    import pyarrow as pa

    raw = pa.array(values, pa.binary())
    return pa.StringArray.from_buffers(len(raw), raw.buffers()[1], raw.buffers()[2])


def samples(docs: DataFrame, units: str = "lines", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, n units, form, prefix_chars, middle_chars, output) of every row."""
    if units not in UNITS:
        raise ValueError(f"units must be one of {', '.join(UNITS)}")
    rows = need(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_sample_batches(units, rate, spm_rate, seed), SAMPLES)


def restore(output: Column, form: Column) -> Column:
    """The text of a sample: its parts lie between markers, which no part holds."""
    psm = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # "", then the parts in order
    return F.when(form == "plain", output).when(form == "psm", F.concat(psm[1], psm[3], psm[2])).otherwise(F.concat(psm[2], psm[3], psm[1]))
