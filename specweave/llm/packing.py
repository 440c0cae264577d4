"""Packing of tokenised documents into sequences.

Tokenising reads each text once. White space separates tokens for the given
tokenizer, so a text is cut at spaces and line ends (Arrow splits and numbers the
pieces of many texts at once), every distinct piece (in lower case, as this
tokenizer does not tell case) is tokenised once and its ids are kept (a bounded
cache per worker); a text's ids are the ids of its pieces in order, gathered by
number. Runs of letters go to the tokenizer's BPE model without its pattern steps,
which leave them as they are. Each document's ids, with an end id, are cut
into pieces of at most SEQUENCE ids: whole pieces fill a sequence alone, the
rest is packed.

Only piece descriptions (a few numbers) are packed. They are written to the
shared folder and dealt into random groups of about GROUP_PIECES by a hash of
a unique piece number, so neither long documents, copies nor a hot id make a
large group. Each group runs first-fit decreasing by itself; a tournament tree
over the capacities of its bins (each inner node holds the larger capacity of
its two) finds the first bin that fits in log steps.

A document without text still has its end id: one piece of length 1. Repeated
rows and null ids are packed like any other rows. Every id lies in one piece.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import need
from specweave.session import materialize

SEQUENCE = 4096
END_ID = 2
GROUP_PIECES = 20_000
CACHE_PIECES = 500_000  # of each of two generations
RUN_CHARS = 16_000_000  # texts tokenised at once, one at least

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CachedTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, by white-space piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("needs little-endian 32-bit integers")
        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # letter runs in lower case and normal form: only the model is left to do
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.letters.model._resize_cache(0)  # each word comes once
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> None:
        """Runs of letters, which are one word each to the tokenizer: many go
        through its model as one text, whose ids are cut behind each word's end."""
        lines = [words[i:i + 256] for i in range(0, len(words), 256)]
        for line, found in zip(lines, self.letters.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) == len(line):
                flat = ids.tobytes()
                self.known.update(zip(line, [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
            else:
                self._pieces(line)

    def _pieces(self, pieces: list[str]) -> None:
        for piece, found in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.known[piece] = array("I", found.ids).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Bring the ids of distinct pieces into the cache."""
        if len(self.known) > CACHE_PIECES:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        new = [p for p in pieces if p not in known]
        known.update([(p, older[p]) for p in new if p in older])
        if older:
            new = [p for p in new if p not in older]
        # a letter run and one mark behind it are tokens by themselves
        marked = [p for p in new if p[-1] in ".," and p[-2:-1].isalpha() and p[-2:-1].lower()[-1:].isalpha()]
        words, rest, kept = [], [], set(marked)
        for p in [*(p for p in new if p not in kept), *{p[:-1] for p in marked}.difference(known, new), *{".", ","}.difference(known, new)]:
            (words if _plain_word(p) else rest).append(p)
        self._words(words)
        self._pieces(rest)
        for p in marked:
            known[p] = known[p[:-1]] + known[p[-1]]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by END_ID; border of each text's ids)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = pc.split_pattern(pa.array([_lower(t).replace("\n", " ") for t in texts], pa.string()), " ")
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(pieces)
        found = [self.known[p] for p in pieces]
        found.append(np.array([END_ID], "<u4").tobytes())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        firsts = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(found), "<u4")
        ends = cut.offsets.to_numpy()[1:]
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends, len(pieces))
        n = sizes[codes]
        upto = np.cumsum(n)
        ids = pool[np.arange(upto[-1] if len(upto) else 0) + np.repeat(firsts[codes] - (upto - n), n)]
        return ids, np.concatenate([[0], upto[ends + np.arange(len(texts))]]).astype(np.int64)


def _plain_word(piece: str) -> bool:
    """Letters only, already in lower case and normal form: one word, as it is."""
    return piece.isalpha() and (piece.isascii() and piece.islower() or piece == piece.lower() and unicodedata.is_normalized("NFC", piece))


def _lower(text: str) -> str:
    """``text`` in lower case, as the tokenizer's own first step makes it; left to
    the tokenizer where the two could differ: letters whose lower case depends
    on their neighbours or has two parts, and names of special tokens."""
    return text if "\u03a3" in text or "\u0130" in text or "<|" in text else text.lower()


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def _piece_batches(path: str, sequence: int):
    def run(batches: Iterator) -> Iterator:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa

        from specweave.llm.langid import chunks

        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = CachedTokenizer(path)
        for b in batches:
            docs, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for cut in chunks(texts, RUN_CHARS):
                ids, borders = _TOKENIZERS[path].flat([t or "" for t in texts[cut]])
                raw, out = memoryview(ids.tobytes()), []
                for doc, low, high in zip(docs[cut], borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                    for at in range(low, high, sequence):
                        to = min(at + sequence, high)
                        out.append((doc, at - low, to - at, zlib.crc32(raw[4 * at:4 * to]), high - low))
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def tokenised_pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Each document's ids cut into pieces; ``path`` names the tokenizer file,
    which every worker must be able to read."""
    return need(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long"), "text").mapInArrow(_piece_batches(path, sequence), PIECES)


def first_fit_decreasing(lengths, capacity: int):
    """Bin of each item (int array), first-fit by decreasing length, ties in
    the given order."""

    n = len(lengths)
    bins = np.zeros(n, np.int64)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    tree = [capacity] * (2 * leaves)  # tree[1] is the root; bins are leaves
    for i in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        size = int(lengths[i])
        if size > capacity:
            raise ValueError("an item is larger than a bin")
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i] = at - leaves
        tree[at] -= size
        while at > 1:
            at //= 2
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left >= right else right
    return bins


def _pack_group(sequence: int):
    def run(key, rows):

        rows = rows.sort_values("piece").reset_index(drop=True)
        bins = first_fit_decreasing(rows["length"].to_numpy(), sequence)
        order = np.argsort(bins, kind="stable")
        lengths = rows["length"].to_numpy()[order]
        ends = np.cumsum(lengths)
        firsts = np.concatenate([[True], np.diff(bins[order]) > 0])
        base = np.maximum.accumulate(np.where(firsts, ends - lengths, 0))
        rows = rows.iloc[order]
        rows = rows.assign(sequence_id=(np.int64(key[0]) << 32) + bins[order], offset=ends - lengths - base)
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return run


PACKED = PIECES + ", sequence_id long, offset long"


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``pieces`` (PIECES columns) with sequence_id and offset.

    Whole pieces get negative sequence ids, packed ones group * 2^32 + bin.
    """
    stored = materialize(pieces.withColumn("piece", F.monotonically_increasing_id()), "packing")
    whole = stored.where(F.col("length") == sequence)
    rest = stored.where(F.col("length") < sequence)
    groups = max(1, -(-rest.count() // GROUP_PIECES))
    alone = whole.select(*[F.col(c) for c in pieces.columns], (-1 - F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = rest.withColumn("bin_group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    packed = dealt.groupBy("bin_group").applyInPandas(_pack_group(sequence), PACKED)
    return alone.unionByName(packed)


def pack_documents(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    return pack_pieces(tokenised_pieces(docs, path, sequence), sequence)
