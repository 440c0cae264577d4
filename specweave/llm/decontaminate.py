"""Benchmark decontamination under edit distance.

A document is contaminated if a run of its words is within an edit distance of
MAX_EDITS of the words of a benchmark item (word insertions, deletions and
substitutions; words are runs of letters and digits in lower case, and single
characters of scripts written without spaces).

Windows of item size slide over every word position of the whole text:

* The CGK random walk embeds a window: at step j the output is the word under
  the pointer, and a random bit of (step, word) says whether the pointer moves
  on. Edit distance becomes Hamming distance; the walks of a copy and of an
  edited copy meet again after an edit.
* Bit sampling: each of TABLES hash tables keys WALKS embeddings on SAMPLED
  output positions. A window becomes a candidate of the items it shares a key
  with.
* Walks drift apart as edits add up, so an item of 2 * SEGMENT words or more is
  keyed on several segments of SEGMENT to 2 * SEGMENT words, whatever its length.
  One of m segments has at most 1 / m of the edits, and any of them leads to the
  item. An item with MAX_EDITS of its words edited is met in at least 95 % of
  trials, from 10 to 1,000 words and by kind of edit (tests).
* Candidates are verified exactly: Myers' bit-vector algorithm gives the
  smallest edit distance of the item to any run of words around the window.

Windows are of the largest size of a geometric grid that the segment has (its
first words), start at every word and end with their text at the latest, so what
is found depends neither on the order of documents nor on batches. Before embedding, windows are skipped that cannot match by the
q-gram lemma: a segment of L words with k edits keeps L - 1 - 2k of its word
pairs, so a window with fewer pairs that occur in any item is out. A candidate
is verified only if the words around it hold all but MAX_EDITS of the item's
distinct words, as an edit takes away one of them at most.

The benchmark is handled in blocks of at most BLOCK_WORDS words, so what goes to
the workers is bounded; each further block is another pass over the documents.
Documents are not shuffled.

Items of fewer than MIN_WORDS words allow no edit: their word sequences are met
exactly by a hash at every position of the text, and compared. Items with null
text or without words take no part. Null text of a
document counts as empty. Repeated items and documents are treated one by one,
ties between equal matches go to the first position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import need

MAX_EDITS = 0.2
MIN_WORDS = 5
GRID = 1.2
SEGMENT = 16
WALKS = 12
TABLES_PER_WALK = 4
SAMPLED = 3
TABLES = WALKS * TABLES_PER_WALK
BLOCK_WORDS = 1_000_000
PAIR_BITS = 22
SEED = 20_26

MATCHES = "doc_id long, item_id long, edits int, item_words int, start long, end long"

# Blocks of scripts written without spaces (Thai, Lao, Myanmar,
# Khmer, Tai Le, New Tai Lue, Tai Tham, Balinese, kana, Bopomofo, Han, Yi, Javanese).
_UNSPACED = (
    "\u0e01-\u0e3a\u0e40-\u0e4e\u0e50-\u0e59\u0e81-\u0edf\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u17e0-\u17e9\u1950-\u1974"
    "\u1980-\u19da\u1a20-\u1a99\u1b00-\u1b59\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f\u31a0-\u31bf\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48c\ua980-\ua9c0\ua9d0-\ua9d9\ua9e0-\ua9fe\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
)
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_SPACED_WORD = re.compile(r"[^\W_]+")
_SPACED_WORD_OR_END = re.compile(r"[^\W_]+|\0")
_WORD = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\W_])+")
_WORD_OR_END = re.compile(rf"{_WORD.pattern}|\0")


def words_of(text: str) -> list[str]:
    low = text.lower()
    return (_WORD if _ANY_UNSPACED.search(low) else _SPACED_WORD).findall(low)


def grid_size(n: int) -> int:
    """Largest window size of the grid that is at most n."""
    size = MIN_WORDS
    while (bigger := max(size + 1, int(size * GRID))) <= n:
        size = bigger
    return size


def edits_allowed(n: int) -> int:
    return int(MAX_EDITS * n)


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """(edits, end) of the run of ``text`` nearest to ``item`` (first of equals)."""
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text):
        eq = at.get(w, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | x) & full
        up, down = (minus | ~(d | plus)) & full, plus & d
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(d | up)) & full, up & d
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """Index over the items (id, text) of one block."""

    def __init__(self, items: list[tuple[int, str]]):
        found = [(i, words_of(t)) for i, t in items if t]
        short = [(i, w) for i, w in found if 0 < len(w) < MIN_WORDS]
        found = [(i, w) for i, w in found if len(w) >= MIN_WORDS]
        self.vocabulary = {w: n + 1 for n, w in enumerate(dict.fromkeys(w for _, ws in found + short for w in ws))}  # 0: in no item
        self.short: dict[tuple[int, ...], list[int]] = {}  # ids by word sequence
        for i, ws in short:
            self.short.setdefault(tuple(self.vocabulary[w] for w in ws), []).append(i)
        self.short_keys = {
            n: np.unique(np.concatenate([self._sequences(np.array(ws, np.int64), n) for ws in self.short if len(ws) == n]))
            for n in {len(ws) for ws in self.short}
        }
        self.ids = [i for i, _ in found]
        self.items = [[self.vocabulary[w] for w in ws] for _, ws in found]
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for ws in self.items:
            a = np.array(ws, np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True
        self.distinct = [frozenset(ws) for ws in self.items]
        by_size: dict[int, list[tuple[int, int, int]]] = {}  # (item, first word, edits in the best segment)
        for n, ws in enumerate(self.items):
            m = max(1, len(ws) // SEGMENT)
            for i in range(m):
                first, behind = len(ws) * i // m, len(ws) * (i + 1) // m
                by_size.setdefault(grid_size(behind - first), []).append((n, first, edits_allowed(len(ws)) // m))
        rng = np.random.default_rng(SEED)
        self.sizes = sorted(by_size)
        steps = 2 * max(self.sizes, default=0)
        self.bits = rng.integers(0, 2**63, (steps, WALKS), dtype=np.uint64)
        self.picks = {s: np.stack([np.sort(rng.choice(2 * s, SAMPLED, replace=False)) for _ in range(TABLES)]) for s in self.sizes}
        self.least = {s: s - 1 - 2 * max(k for _, _, k in by_size[s]) for s in self.sizes}
        self.segments = np.array([(n, first) for s in self.sizes for n, first, _ in by_size[s]], np.int64).reshape(-1, 2)
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        done = 0
        for s in self.sizes:
            own = by_size[s]
            for i in range(0, len(own), 2048):
                flat = np.concatenate([np.array(self.items[n][first:first + s], np.int64) for n, first, _ in own[i:i + 2048]])
                starts = np.arange(0, len(flat), s)
                keys.append(self._keys(flat, starts, np.full(len(starts), s)).ravel())
                owners.append(np.repeat(np.arange(done, done + len(starts)), TABLES))
                done += len(starts)
        order = np.argsort(np.concatenate(keys), kind="stable")
        self.keys, self.owners = np.concatenate(keys)[order], np.concatenate(owners)[order]

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return (h >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    @staticmethod
    def _sequences(words: np.ndarray, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each position on."""
        h = np.full(max(0, len(words) - n + 1), n, np.uint64)
        for i in range(n):
            h = (h ^ words[i:len(h) + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(29))
        return h

    def short_matches(self, words: np.ndarray) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(start, words) of every place where a short item stands."""
        for n, keys in self.short_keys.items():
            h = self._sequences(words, n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for start in np.flatnonzero(keys[at] == h).tolist():
                own = tuple(words[start:start + n].tolist())
                if own in self.short:
                    yield start, own

    def _first_short(self, places) -> list[tuple[int, int, int, int, int]]:
        first: dict[tuple[int, ...], int] = {}
        for start, own in places:
            first[own] = min(start, first.get(own, start))
        return [(i, 0, len(own), start, start + len(own)) for own, start in first.items() for i in self.short[own]]

    def _keys(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, behind: np.ndarray | None = None) -> np.ndarray:
        """(windows, TABLES) keys of the windows of ``words`` with these starts
        and sizes, cut off at ``behind``, the word behind their text: all walks of
        all windows advance together."""
        n = len(starts)
        padded = np.append(words + 2, 1).astype(np.uint64)  # 1: behind the window
        limit = np.minimum(starts + sizes, len(words) if behind is None else behind)[None, :]
        pointer = np.repeat(starts[None, :], WALKS, axis=0)
        outputs = np.empty((2 * int(sizes.max(initial=0)), WALKS, n), np.uint64)
        for step in range(len(outputs)):
            symbol = padded[np.where(pointer < limit, pointer, len(words))]
            outputs[step] = symbol
            h = (symbol * np.uint64(0x9E3779B97F4A7C15)) ^ self.bits[step][:, None]
            pointer += ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(np.int64)
        keys = np.empty((n, TABLES), np.uint64)
        walk = np.arange(TABLES) // TABLES_PER_WALK
        for s in np.unique(sizes):
            own = np.flatnonzero(sizes == s)
            h = np.broadcast_to((np.arange(TABLES) + TABLES * s).astype(np.uint64)[:, None], (TABLES, len(own)))
            for i in range(SAMPLED):
                h = (h ^ outputs[self.picks[s][:, i], walk][:, own]) * np.uint64(0xFF51AFD7ED558CCD)
                h = h ^ (h >> np.uint64(29))
            keys[own] = h.T
        return keys

    def candidates(self, words: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window starts, item numbers and first words of segments, each triple
        once, of windows that share a key with a segment of an item. ``ends`` are
        the places behind the texts of ``words`` (one text: its length)."""
        found = [(np.zeros(0, np.int64),) * 3]
        if len(words) < 2 or not self.sizes:
            return found[0]
        ends = np.array([len(words)]) if ends is None else ends
        known = np.concatenate([[0], np.cumsum(self.pairs[self._pair(words[:-1], words[1:])] & (words[:-1] > 0) & (words[1:] > 0))])
        known = np.append(known, np.full(self.sizes[-1], known[-1]))
        starts, sizes, behind = [], [], []
        for s in self.sizes:
            own = np.flatnonzero(known[s - 1:s - 1 + len(words)] - known[:len(words)] >= self.least[s])
            last = ends[np.searchsorted(ends, own, "left")]
            # pairs of the next text do not count
            fit = known[np.minimum(own + s, np.maximum(last, own + 1)) - 1] - known[own] >= self.least[s]
            starts.append(own[fit])
            sizes.append(np.full(len(own[fit]), s))
            behind.append(last[fit])
        starts, sizes, behind = np.concatenate(starts), np.concatenate(sizes), np.concatenate(behind)
        for i in range(0, len(starts), 2048):
            keys = self._keys(words, starts[i:i + 2048], sizes[i:i + 2048], behind[i:i + 2048]).ravel()
            low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            hit = np.flatnonzero(high > low)
            per = (high - low)[hit]
            at = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
            pairs = np.unique(np.stack([np.repeat(starts[i + hit // TABLES], per), self.owners[at]]), axis=1)
            found.append((pairs[0], *self.segments[pairs[1]].T))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item id, edits, item words, first word, word behind) of the nearest
        match of every item found in ``text``."""
        return self.matches_of_words(words_of(text)) if text else []

    def matches_of_words(self, found: list[str]) -> list[tuple[int, int, int, int, int]]:
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
        starts, numbers, firsts = self.candidates(ids)
        near = self._verified(ids, zip((starts - firsts).tolist(), numbers.tolist(), strict=True))
        return near + self._first_short(self.short_matches(ids))

    def _verified(self, ids: np.ndarray, candidates) -> list[tuple[int, int, int, int, int]]:
        """Matches near the ``candidates`` (place of the item's first word if no
        word before the window were inserted or deleted, item number)."""
        best: dict[int, tuple[int, int, int]] = {}
        seen: dict[int, list[tuple[int, int]]] = {}
        for start, number in sorted(set(candidates)):
            item = self.items[number]
            allowed = edits_allowed(len(item))
            # before a later segment, edits move the window once more
            slack = allowed if len(item) < 2 * SEGMENT else 2 * allowed
            low, high = max(0, start - slack), min(len(ids), start + len(item) + allowed + slack)
            if any(a <= low and high <= b for a, b in seen.get(number, ())):
                continue
            # one look covers the neighbouring windows of the same item as well
            high = min(len(ids), high + len(item))
            seen.setdefault(number, []).append((low, high))
            text = ids[low:high].tolist()
            if len(self.distinct[number].intersection(text)) < len(self.distinct[number]) - allowed:
                continue
            edits, end = best_match(item, text)
            if edits > allowed:
                continue
            back, length = best_match(item[::-1], text[:end][::-1])
            del back
            now = (edits, low + end - length, low + end)
            if number not in best or now < best[number]:
                best[number] = now
        return sorted((self.ids[n], e, len(self.items[n]), s, t) for n, (e, s, t) in best.items())


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> list[Items]:
    """Indexes over the benchmark (item_id, text), each of about ``limit`` words at most."""
    items = need(benchmark, ("item_id", "text")).where("text IS NOT NULL")
    size = F.size(F.split("text", r"\s+")) + F.length(F.regexp_replace("text", f"[^{_UNSPACED}]", ""))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-2 * total // limit)) if total > limit else 1
    out = []
    for b in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        out.append(Items([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]))
    return out


def _found(index: Items, texts: list[str | None]) -> list[list[tuple]]:
    """Matches of each text, each found within its own words alone."""
    from specweave.llm.langid import chunks

    out: list[list[tuple]] = [[] for _ in texts]
    if not index.sizes and not index.short:
        return out
    for cut in chunks(texts):
        # one run over all words; a NUL word, known to no item, ends each text
        run = "".join([t.replace("\0", " ").lower() + "\0" if t else "\0" for t in texts[cut]])
        found = (_WORD_OR_END if _ANY_UNSPACED.search(run) else _SPACED_WORD_OR_END).findall(run)
        words = np.fromiter(map(index.vocabulary.get, found, repeat(0)), np.int64, len(found))
        ends = np.flatnonzero(np.fromiter(map("\0".__eq__, found), bool, len(found)))
        by_text: dict[int, set] = {}
        starts, numbers, firsts = index.candidates(words, ends)
        for n, at, number in zip(np.searchsorted(ends, starts, "left").tolist(), (starts - firsts).tolist(), numbers.tolist(), strict=True):
            by_text.setdefault(n, set()).add((at, number))
        for n, windows in by_text.items():
            first = int(ends[n - 1]) + 1 if n else 0
            out[cut.start + n] = index._verified(words[first:ends[n]], {(at - first, number) for at, number in windows})
        short: dict[int, list] = {}
        places = list(index.short_matches(words))
        for n, (at, own) in zip(np.searchsorted(ends, [at for at, _ in places], "left").tolist(), places, strict=True):
            short.setdefault(n, []).append((at - (int(ends[n - 1]) + 1 if n else 0), own))
        for n, own in short.items():
            out[cut.start + n] += index._first_short(own)
    return out


def _word_places(text: str, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Code-point spans of the numbered words of ``text``."""
    low = text.lower()
    source = low if len(low) == len(text) else text
    return {n: m.span() for n, m in enumerate(_WORD.finditer(source)) if n in wanted}


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """MATCHES: for every row of ``docs`` (doc_id, text) the nearest match of
    each item found in it; ``start`` and ``end`` count code points."""
    rows = need(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long"), "text")
    found = None
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for b in batches:
                ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                out = []
                for doc, text, matches in zip(ids, texts, _found(shared.value, texts), strict=True):
                    if matches:
                        places = _word_places(text, {w for m in matches for w in (m[3], m[4] - 1)})
                        out += [(doc, m[0], m[1], m[2], places.get(m[3], (None,))[0], places.get(m[4] - 1, (None, None))[1]) for m in matches]
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "edits", "item_words", "start", "end"])

        part = rows.mapInArrow(run, MATCHES)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (any columns, among them text) without contaminated rows."""
    if len(set(docs.columns)) != len(docs.columns):
        raise ValueError("docs has two columns of one name")
    schema = docs.schema
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for b in batches:
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                yield b.filter(pa.array([not m for m in _found(shared.value, texts)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
