"""Language identification of mixed-language text.

Training counts hashed character n-grams (1 to 3 characters of each word, with
word edges) per language over all labelled rows, and which scripts a language
is written in. A model has BUCKETS log-probabilities per language whatever the
corpus, so what is broadcast is bounded by languages x BUCKETS x 4 bytes;
training refuses more than MAX_LANGUAGES languages.

Prediction cuts a text into words, each with the log-probability of its n-grams
under every language. The script of a word's letters (Unicode ranges) narrows
its candidates to the languages seen in that script. Viterbi then finds the
labelling of the word sequence with the best total score, where each change of
language costs SWITCH_PENALTY; equal labels in a row are a span. The
prediction is the language with most letters, the score its share of the
letters, each span weighted with how clearly its language leads.

Null text or text without a letter: ``und``, score 0, no spans; so is every
text when nothing was labelled. Ties go to the language first by name. Rows
are kept one for one, repeated or with null ids as they are. A run of letters
longer than WORD_LETTERS (scripts without spaces, very long texts) counts as
several words, nothing is cut off.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import need

BUCKETS = 1 << 15
MAX_LANGUAGES = 256
WORD_LETTERS = 24
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
SCRIPT_SHARE = 0.01
OUTSIDE = -1e4
UND = "und"

# First code points of Unicode script ranges, in order.
SCRIPT_RANGES = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"),
    (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2DE0, "Cyrillic"), (0x2E80, "Han"), (0x3040, "Hiragana"),
    (0x30A0, "Katakana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x31F0, "Katakana"),
    (0x3400, "Han"), (0xA000, "Yi"), (0xA640, "Cyrillic"), (0xA720, "Latin"),
    (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB50, "Arabic"), (0x10000, "Other"),
    (0x20000, "Han"), (0x40000, "Other"),
)
_STARTS = [a for a, _ in SCRIPT_RANGES]
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_RANGES))

_WORD = re.compile(r"[^\W\d_]{1,%d}" % WORD_LETTERS)


_SCRIPT_AT = np.array([0, *(SCRIPTS.index(name) for _, name in SCRIPT_RANGES)])


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, starts, scripts) of many words at once: the hash buckets of
    their 1- to 3-character n-grams with word edges, where each word's buckets
    start, and the script of most of each word's letters (ties: first in
    SCRIPTS)."""
    cps = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    word = np.repeat(np.arange(len(words)), size + 2)
    place = np.arange(len(cps)) - first[word]  # 0 is "<", size + 1 is ">"
    inner = (place > 0) & (place <= size[word])
    after, later = np.roll(cps, -1), np.roll(cps, -2)

    def bucket(*parts: np.ndarray) -> np.ndarray:
        h = np.full(len(parts[0]), 0x9E3779B97F4A7C15 + len(parts), np.uint64)
        for x in parts:
            h = (h ^ x) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        return (h & np.uint64(BUCKETS - 1)).astype(np.int64)

    two, three = place <= size[word], place < size[word]
    found = np.concatenate([bucket(cps[inner]), bucket(cps[two], after[two]), bucket(cps[three], after[three], later[three])])
    owner = np.concatenate([word[inner], word[two], word[three]])
    order = np.argsort(owner, kind="stable")
    starts = np.concatenate([[0], np.cumsum(3 * size + 1)[:-1]])
    kind = _SCRIPT_AT[np.searchsorted(_STARTS, cps[inner], side="right")]
    letters = np.concatenate([[0], np.cumsum(size)[:-1]])
    low, high = np.minimum.reduceat(kind, letters), np.maximum.reduceat(kind, letters)
    for i in np.flatnonzero(low != high):
        low[i] = np.bincount(kind[letters[i]:letters[i] + size[i]]).argmax()
    return found[order], starts, low


def _count_batches(batches: Iterator) -> Iterator:
    """Per task: (lang, bucket, n) with buckets below 0 for scripts; at most
    languages x (BUCKETS + scripts) rows whatever the input."""
    import pyarrow as pa

    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}

    def flush(lang: str) -> None:
        g = grams.setdefault(lang, np.zeros(BUCKETS, np.int64))
        s = scripts.setdefault(lang, np.zeros(len(SCRIPTS), np.int64))
        if len(grams) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        seen = words.pop(lang)
        if not seen:
            return
        distinct, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
        buckets, starts, script = grams_of(distinct)
        per = np.diff(np.append(starts, len(buckets)))
        g += np.bincount(buckets, np.repeat(n, per), BUCKETS).astype(np.int64)
        s += np.bincount(script, n * np.fromiter(map(len, distinct), np.int64, len(distinct)), len(SCRIPTS)).astype(np.int64)

    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            seen = words.setdefault(lang, Counter())
            seen.update(_WORD.findall(text.lower()))
            if len(seen) > 200_000:
                flush(lang)
    for lang in list(words):
        flush(lang)
    for lang, g in grams.items():
        at = np.flatnonzero(g)
        s = np.flatnonzero(scripts[lang])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + len(s)), pa.string()), pa.array(np.concatenate([at, -1 - s]).astype(np.int32)), pa.array(np.concatenate([g[at], scripts[lang][s]]))],
            names=["lang", "bucket", "n"],
        )


class Model:
    """Log-probabilities of n-gram buckets and admitted scripts by language."""

    def __init__(self, langs: list[str], grams: np.ndarray, admitted: np.ndarray):
        self.langs, self.grams, self.admitted = langs, grams, admitted

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): log-probabilities; OUTSIDE for languages not
        written in the word's script, unless no language is."""
        buckets, starts, script = grams_of(words)
        out = np.add.reduceat(self.grams[buckets], starts, axis=0)
        admitted = self.admitted[script]
        return np.where(admitted | ~admitted.any(axis=1, keepdims=True), out, out + OUTSIDE).astype(np.float32)


def train(labelled: DataFrame) -> Model:
    """Counts over all rows of ``labelled`` (text, lang) with both given."""
    rows = need(labelled, ("text", "lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    grams = np.zeros((BUCKETS, len(langs)))
    scripts = np.zeros((len(SCRIPTS), len(langs)))
    at = np.searchsorted(langs, counts["lang"].to_numpy(dtype=str)) if langs else np.zeros(0, int)
    bucket, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    grams[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    scripts[-1 - bucket[bucket < 0], at[bucket < 0]] = n[bucket < 0]
    share = (grams + SMOOTHING) / (grams + SMOOTHING).sum(axis=0)
    admitted = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    return Model(langs, np.log(share), admitted)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best labels of each sequence of (words, languages) scores.

    All sequences advance together, longest first, so the cost of a step is
    shared; back-pointers are one byte per word and language.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    k = scores[0].shape[1]
    steps = int(lengths[0])
    live = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # longer than t
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    flat = np.concatenate([scores[i] for i in order])
    best = flat[starts].astype(np.float64)
    back = np.empty(flat.shape, np.uint8)
    own = np.arange(k, dtype=np.uint8)
    for t in range(1, steps):
        n = live[t]
        now = best[:n]
        top = now.argmax(axis=1)
        switched = now[np.arange(n), top] - penalty
        stay = now >= switched[:, None]
        at = starts[:n] + t
        back[at] = np.where(stay, own, top[:, None].astype(np.uint8))
        best[:n] = np.where(stay, now, switched[:, None]) + flat[at]
    labels = np.empty(len(flat), np.uint8)
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    out: list[np.ndarray] = [np.empty(0, np.uint8)] * len(scores)
    for where, (s, n) in zip(order, zip(starts, lengths, strict=True), strict=True):
        out[where] = labels[s:s + n]
    return out


class Labeller:
    """Labels texts with a model; keeps the scores of words met before."""

    CACHE = 300_000

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.scores = np.zeros((0, len(model.langs)), np.float32)
        self.letters = np.zeros(0, np.int32)

    def _ids(self, words: list[list[str]]) -> list[np.ndarray]:
        new = set().union(*words) - self.index.keys()
        if len(self.index) + len(new) > self.CACHE:
            self.index, new = {}, set().union(*words)
            self.scores, self.letters = self.scores[:0], self.letters[:0]
        if new:
            fresh = sorted(new)
            self.index.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.word_scores(fresh)])
            self.letters = np.concatenate([self.letters, np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in fresh], np.int32)])
        return [np.fromiter(map(self.index.__getitem__, w), np.int64, len(w)) for w in words]

    def label(self, texts: list[str | None], spans: bool = False) -> tuple[list, list, list]:
        pred, score, parts = [UND] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if not self.model.langs:
            return pred, score, parts
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        ids = self._ids(words)
        full = [i for i, x in enumerate(ids) if len(x) and self.letters[x].any()]
        if not full:
            return pred, score, parts
        k = len(self.model.langs)
        labels = viterbi([self.scores[ids[i]] for i in full], SWITCH_PENALTY)
        for i, marks in zip(full, labels, strict=True):
            letters = self.letters[ids[i]]
            total = np.bincount(marks, letters, k)
            lead = int(total.argmax())
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(marks)) + 1])
            sums = np.add.reduceat(self.scores[ids[i]].astype(np.float64), cuts, axis=0)
            sums -= sums.max(axis=1, keepdims=True)
            own = marks[cuts]
            sure = np.exp(sums[np.arange(len(cuts)), own]) / np.exp(sums).sum(axis=1)
            per_span = np.add.reduceat(letters, cuts)
            pred[i] = self.model.langs[lead]
            score[i] = float(min(1.0, (per_span * sure)[own == lead].sum() / letters.sum()))
            if spans:
                low = texts[i].lower()
                if len(low) == len(texts[i]):
                    places = [m.span() for m in _WORD.finditer(low)]
                else:  # lower case changed the length: find the words' places in the text itself
                    places = [m.span() for m in _WORD.finditer(texts[i])]
                if len(places) == len(marks):
                    ends = [*cuts[1:], len(marks)]
                    parts[i] = [{"start": places[a][0], "end": places[e - 1][1], "lang": self.model.langs[m]} for a, e, m in zip(cuts, ends, own, strict=True)]
        return pred, score, parts


CHUNK_CHARS = 2_000_000
_LABELLERS: dict[str, Labeller] = {}  # of this worker: the scores of words outlast a task


def chunks(texts: list[str | None], most: int = 0) -> Iterator[slice]:
    """Slices of about ``most`` (else CHUNK_CHARS) characters, one text at least."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or "") > (most or CHUNK_CHARS):
            yield slice(first, i)
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield slice(first, len(texts))


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and, if asked for, spans (start, end in
    code points, lang). The three names must be free in ``docs``."""
    taken = {"lang_pred", "score", "spans"} & set(docs.columns)
    if taken or len(set(docs.columns)) != len(docs.columns):
        raise ValueError(f"clashing columns: {sorted(taken) or docs.columns}")
    token = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.grams.astype(np.float32), model.admitted))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if token not in _LABELLERS:
            _LABELLERS.clear()
            _LABELLERS[token] = Labeller(Model(*shared.value))
        labeller = _LABELLERS[token]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            pred, score, parts = [], [], []
            for cut in chunks(texts):
                p, s, x = labeller.label(texts[cut], spans)
                pred += p
                score += s
                parts += x
            extra = [pa.array(pred, pa.string()), pa.array(score, pa.float64())] + ([pa.array(parts, kind)] if spans else [])
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "lang_pred", "score", *(["spans"] if spans else [])])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    more = ", lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if spans else "")
    return docs.mapInArrow(run, names + more)


def held_out(doc_id="doc_id"):
    """Column: is this document kept out of training?"""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train_on_documents(docs: DataFrame) -> Model:
    return train(need(docs, ("doc_id", "text", "lang")).where(~held_out()).select("text", "lang"))
