"""Phrase collocations by Rabin-Karp fingerprints.

ASCII letters in lower case; texts fall at ``[.,;:!?]`` and line ends into pieces,
pieces at spaces and tabs into words. All counts are by language. Candidates are
phrases of 2 to LONGEST words that occur LEAST times or more inside pieces.

1. Tokenised text: each task writes chunks of about CHUNK_WORDS words, every word
   once and then the numbers of the words in order (separators have numbers too).
   All later steps read this table, not the documents.
2. Fingerprints: the words of a chunk get 64-bit hashes; prefix sums of hash *
   BASE^place, modulo 2^64, give the fingerprint of every n-gram by a difference
   and a multiplication with a power of BASE's inverse (numpy, no loop over words).
3. Levels 1 to LONGEST: an n-gram whose two (n-1)-grams may both be frequent goes,
   once per chunk with its count and the chunk as a pointer to its occurrences,
   through a shuffle that adds the counts. Frequent fingerprints of a level enter
   a bit filter of at most FILTER_BITS bits for the next: one that holds more than
   it was made for lets more n-grams through, and never loses one. Languages have
   hashes of their own, so a row is three numbers.
4. Verification against the text: each chunk looks up the n-grams that pass their
   level's filter at their places in the text; those that share a fingerprint but not the words are told apart,
   each phrase is spelled out once per chunk, and a second shuffle adds the counts
   by language and *words*. So collisions of fingerprints and of filters cost work
   and change no result; no other phrases are spelled out.
5. Cuts join the parts' counts; scores are exact (38-digit integers). A candidate
   that is as frequent as a longer one around it goes: such a longer one also
   implies an equally frequent one of a single word more, so two parts of each
   candidate are enough to look at. Then the first TOP of each language.

A document or piece of any length is cut into chunks that overlap by LONGEST - 1
words, which only the later chunk counts as starts. Null text is empty, null
language ``und``. Repeated rows count each time; ids play no part. Ties: as in the
order of score, count, phrase (bytes); for the lowest cut, the smallest first part.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specweave.llm.common import need, tidy_shuffles
from specweave.session import materialize

LONGEST = 5
LEAST = 100
TOP = 2000
UND = "und"
CHUNK_WORDS = 1 << 20
PART_BYTES = 1 << 20  # of a long text, tokenised at a time
FILTER_BITS = 1 << 27
BITS_PER_KEY = 16

SEPARATORS = [bytes([c]) for c in b".,;:!?\x0a\x0b\x0c\x0d"]
_TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+")
_EDGE = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)

CHUNKS = "lang string, chunk long, own long, n_words long, words binary, codes binary"


# --- tokenised text -----------------------------------------------------------

class _Chunker:
    """Words of one language in order, by number."""

    def __init__(self):
        self.start([])

    def start(self, words: list[bytes]) -> None:
        self.numbers = {s: i for i, s in enumerate(SEPARATORS)}
        self.codes = array("i")
        self.add(words)

    def add(self, words: list[bytes]) -> None:
        known = self.numbers
        self.codes.extend([known.setdefault(w, len(known)) for w in words])

    def take(self, closed: bool) -> tuple:
        """The chunk so far; of an open text its last words start the next chunk."""
        codes, words = np.frombuffer(self.codes, np.int32).copy(), list(self.numbers)
        own = len(codes) if closed else max(0, len(codes) - LONGEST + 1)
        self.start([] if closed else [words[c] for c in codes[own:].tolist()])
        return own, int((codes[:own] >= len(SEPARATORS)).sum()), b" ".join(words[len(SEPARATORS):]), codes.tobytes()


def _parts(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        edge = _EDGE.search(text, at + PART_BYTES) if at + PART_BYTES < len(text) else None
        to = edge.start() if edge else len(text)
        yield _TOKEN.findall(text, at, to)
        at = to


def _chunk_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    open_: dict[str, _Chunker] = {}
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32

    def row(lang: str, taken: tuple):
        nonlocal number
        number += 1
        own, n, words, codes = taken
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([number]), pa.array([own]), pa.array([n]),
                                           pa.array([words], pa.binary()), pa.array([codes], pa.binary())],
                                          names=["lang", "chunk", "own", "n_words", "words", "codes"])

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            chunker = open_.setdefault(lang, _Chunker())
            if sum(len(c.codes) for c in open_.values()) >= 2 * CHUNK_WORDS:  # many languages: none waits for long
                for other in [k for k in open_ if k != lang]:
                    yield row(other, open_.pop(other).take(True))
            for words in _parts(text.as_py().encode("utf-8", "surrogatepass").lower()):  # lower() of bytes: A-Z only
                chunker.add(words)
                if len(chunker.codes) >= CHUNK_WORDS:
                    yield row(lang, chunker.take(False))
            chunker.add(SEPARATORS[-1:])
    for lang, chunker in open_.items():
        if len(chunker.codes):
            yield row(lang, chunker.take(True))


def tokenised(docs: DataFrame) -> DataFrame:
    """The chunk table (CHUNKS) of ``docs`` (text, lang)."""
    rows = need(docs, ("text", "lang")).select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UND)).alias("lang"))
    return rows.mapInArrow(_chunk_batches, CHUNKS)


# --- fingerprints -------------------------------------------------------------

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64, kept for the largest n so far."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, CHUNK_WORDS + LONGEST), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


class Fingerprints:
    """Fingerprints of all n-grams of a sequence of word hashes (0: separator)."""

    def __init__(self, hashes: np.ndarray, bits: int = 64):
        self.n, self.bits = len(hashes), bits
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(BASE, self.n), dtype=np.uint64)])
        self.gaps = np.concatenate([[0], np.cumsum(hashes == 0)])

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, holds no separator) by start."""
        starts = max(0, self.n - size + 1)
        found = (self.sums[size:size + starts] - self.sums[:starts]) * _powers(INVERSE, starts)
        return found >> np.uint64(64 - self.bits), self.gaps[size:size + starts] == self.gaps[:starts]


@dataclass
class BitFilter:
    """Keys that may have been added: never misses one that was."""

    bits: np.ndarray  # bytes
    shift: int

    @staticmethod
    def places(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
        again = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return mixed >> np.uint64(shift), again >> np.uint64(shift)

    def __contains__(self, key: int) -> bool:
        return bool(self.test(np.array([key], np.uint64))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for p in self.places(keys, self.shift):
            hit &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return hit


def bit_filter(keys: DataFrame, n_keys: int) -> BitFilter:
    """Filter of the longs in column ``fp``: bits are set in the tasks and merged
    by a shuffle; the driver gets at most FILTER_BITS / 64 rows of 64 bits."""
    size = min(FILTER_BITS, max(1 << 16, 1 << (BITS_PER_KEY * max(1, n_keys) - 1).bit_length()))
    shift = 65 - size.bit_length()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at = np.concatenate(BitFilter.places(b.column("fp").to_numpy().view(np.uint64), shift))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["place", "mask"])

    merged = keys.select("fp").mapInArrow(run, "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[merged.column("place").to_numpy()] = merged.column("mask").to_numpy().view(np.uint64)
    return BitFilter(words.view(np.uint8), shift)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed, digest = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")), xxhash.xxh64_intdigest
    found = np.array([digest(w, seed) for w in words], np.uint64)
    return np.concatenate([np.zeros(len(SEPARATORS), np.uint64), np.maximum(found, np.uint64(1))])


class _Chunk:
    """A row of the chunk table in numpy."""

    def __init__(self, lang: str, own: int, words: bytes, codes: bytes, bits: int):
        self.own = own
        self.words = words.split(b" ") if words else []
        self.codes = np.frombuffer(codes, np.int32)
        self.hashes = _word_hashes(lang, self.words)
        self.grams = Fingerprints(self.hashes[self.codes], bits)

    def may_be_frequent(self, size: int, filters: dict[int, BitFilter]) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, passes the level's filter) by start."""
        fp, inside = self.grams.of(size)
        inside = inside.copy()
        at = np.flatnonzero(inside)
        inside[at] = filters[size].test(fp[at])
        return fp, inside

    def candidates(self, size: int, filters: dict[int, BitFilter]) -> np.ndarray:
        """Fingerprints of the ``size``-grams whose parts pass."""
        fp, inside = self.grams.of(size)
        if size > 1:
            _, parts = self.may_be_frequent(size - 1, filters)
            inside = parts[:-1] & parts[1:]
        return fp[:self.own][inside[:self.own]]

    def spelled(self, size: int, filters: dict[int, BitFilter]) -> Iterator[tuple[bytes, int]]:
        """(phrase, count) of the ``size``-grams that pass, told apart by their words."""
        fp, hit = self.may_be_frequent(size, filters)
        starts = np.flatnonzero(hit[:self.own])
        if not len(starts):
            return
        _, first, group, counts = np.unique(fp[starts], return_index=True, return_inverse=True, return_counts=True)
        same = np.ones(len(starts), bool)
        for k in range(size):
            same &= self.codes[starts + k] == self.codes[starts[first][group] + k]
        if same.all():
            found, counts = starts[first], counts
        else:  # a collision inside the chunk
            grams = np.stack([self.codes[starts + k] for k in range(size)], axis=1)
            _, first, counts = np.unique(grams, axis=0, return_index=True, return_counts=True)
            found = starts[first]
        names, low = self.words, len(SEPARATORS)
        for at, n in zip(found.tolist(), counts.tolist(), strict=True):
            yield b" ".join([names[c - low] for c in self.codes[at:at + size].tolist()]), n


def _each_chunk(batches: Iterator, bits: int) -> Iterator:
    for b in batches:
        for lang, chunk, own, words, codes in zip(*[b.column(n) for n in ("lang", "chunk", "own", "words", "codes")], strict=True):
            lang = lang.as_py()
            yield lang, chunk.as_py(), _Chunk(lang, own.as_py(), words.as_py(), codes.as_py(), bits)


def _level_batches(size: int, filters, bits: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, chunk, c in _each_chunk(batches, bits):
            keys, counts = np.unique(c.candidates(size, filters.value), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64()), pa.array(np.full(len(keys), chunk, np.int64))],
                                             names=["fp", "f", "chunk"])

    return run


def _spell_batches(sizes: list[int], filters, bits: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for lang, _, c in _each_chunk(batches, bits):
            for size in sizes:
                found = list(c.spelled(size, filters.value))
                if found:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(found), pa.string()), pa.array([p for p, _ in found], pa.binary()).cast(pa.string()),
                        pa.array([size] * len(found), pa.int32()), pa.array([n for _, n in found], pa.int64()),
                    ], names=["lang", "phrase", "size", "f"])

    return run


# --- phrases ------------------------------------------------------------------

def frequent_phrases(chunks: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = 64) -> DataFrame:
    """(lang, phrase, size, f) of all phrases of 1 to ``longest`` words that occur
    ``least`` times or more. ``bits`` of a fingerprint (fewer: more collisions)."""
    spark: SparkSession = chunks.sparkSession
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"longest must be 2 to {LONGEST}")
    filters: dict[int, BitFilter] = {}
    for size in range(1, longest + 1):
        rows = chunks.mapInArrow(_level_batches(size, spark.sparkContext.broadcast(dict(filters)), bits), "fp long, f long, chunk long")
        level = rows.groupBy("fp").agg(F.sum("f").alias("f"), F.min("chunk").alias("chunk")).where(F.col("f") >= least)
        level = materialize(level, f"phrases-{size}")
        n = level.count()
        if not n:
            break
        filters[size] = bit_filter(level, n)
    spelled = chunks.mapInArrow(_spell_batches(list(filters), spark.sparkContext.broadcast(filters), bits), "lang string, phrase string, size int, f long")
    exact = spelled.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return materialize(exact, "phrases-exact")


def _part(first, length):
    return F.array_join(F.slice(F.split("phrase", " ", -1), first, length), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among ``phrases`` (all
    that are frequent), by their lowest cut; ``totals`` is (lang, n)."""
    several = phrases.where("size > 1").withColumnRenamed("f", "a")
    longer = several.where("size > 2").select("lang", "a", "size", "phrase")
    around = [longer.select("lang", _part(F.lit(i), F.col("size") - 1).alias("phrase"), "a") for i in (1, 2)]
    kept = several.join(around[0].unionByName(around[1]), ["lang", "phrase", "a"], "left_anti")
    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("head", _part(F.lit(1), F.col("k"))).withColumn("tail", _part(F.col("k") + 1, F.col("size") - F.col("k")))
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cut = cut.join(part.withColumnsRenamed({"part": "head", "part_f": "l"}), ["lang", "head"])
    cut = cut.join(part.withColumnsRenamed({"part": "tail", "part_f": "r"}), ["lang", "tail"])
    cut = cut.join(totals, "lang")
    exact = F.expr("CAST((1000 * CAST(a AS DECIMAL(15)) * CAST(n AS DECIMAL(18))) div (CAST(l AS DECIMAL(15)) * CAST(r AS DECIMAL(15))) AS LONG)")
    lowest = F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut")
    best = cut.groupBy("lang", "phrase", "a", "n").agg(lowest)
    return best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases per language of
    ``docs`` (text, lang)."""
    with tidy_shuffles(docs.sparkSession):
        chunks = materialize(tokenised(docs), "phrases-chunks")
        phrases = frequent_phrases(chunks, least, longest, bits)
        totals = chunks.groupBy("lang").agg(F.sum("n_words").alias("n"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = scored(phrases, totals).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
