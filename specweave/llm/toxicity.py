"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

1. Examples: at most EXAMPLES labelled texts per label, those with the smallest
   hash of their text among distinct texts, so copies count once and the choice
   does not depend on the partitioning. Everything learned is learned from them.
2. Terms: words (runs of letters, lower case) and their first 3 to 7 letters. Of
   these, terms that mark label 1 stay: in at least LEAST_TEXTS examples, with a
   chi-square of at least CHI_SQUARE for presence against label, and the TERMS
   highest. Weight: count * (ln((1 + examples) / (1 + examples with it)) + 1).
   Every text also holds one common term of weight COMMON, so that a single
   occurrence in a text is not as near to an example full of such terms as an
   equally full text.
3. Index: postings by term, in blocks of BLOCK examples, each with its largest
   weight. A search adds the largest weights per block, scores the blocks with the
   highest bounds and then those whose bound reaches the K-th best similarity so
   far, so the K nearest examples are exact; all that tie with the K-th count as
   well.
4. Votes are weighted by similarity to the power POWER. Leave-one-out votes of the
   examples, weighted by how many texts of their label an example stands for, give
   the map from votes to scores (isotonic, so a higher vote never scores lower).

The index holds at most 2 * EXAMPLES * (TERMS + 1) postings whatever the input, so
it is broadcast. Texts are scored whole. Null text counts as empty; empty texts and
those without a marking term share the vote of the examples without one. Null ids
are scored like others. Labels other than 0 and 1 and null ids teach nothing; a
document with contradictory labels, or equal texts with them, count as 1. Without
examples of label 1 every score is 0, without any of label 0 it is 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.common import need, tidy_shuffles
from specweave.session import materialize

EXAMPLES = 4096
TERMS = 1024
LEAST_TEXTS = 5
CHI_SQUARE = 20.0
PREFIXES = (3, 4, 5, 6, 7)
COMMON = 8.0
BLOCK = 64
K = 9
POWER = 2
THRESHOLD = 0.7
CACHE = 200_000

_WORD = re.compile(r"[^\W\d_]+")

SCORED = "doc_id long, score double, neighbours array<struct<doc_id:bigint,toxic:int,similarity:double>>, terms array<string>"


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def count_terms(text: str | None) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(words(text)).items():
        for t in terms_of(word):
            found[t] += n
    return found


class BlockMaxIndex:
    """Exact nearest examples by cosine over sparse vectors.

    ``vectors``: (term numbers ascending, weights) of each example, without the
    common term, which has the number ``n_terms`` and the weight ``common``. A search
    scores the blocks with the highest bounds, then all whose bound reaches the
    ``k``-th best similarity of these; sums are in order of the terms, so a
    similarity does not depend on the blocks.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, common: float = COMMON, block: int = BLOCK):
        self.n, self.n_terms, self.common, self.block = len(vectors), n_terms, common, block
        full = [(np.append(t, n_terms), np.append(w, common)) for t, w in vectors]
        full = [(t, w / np.sqrt((w * w).sum())) for t, w in full]
        # examples with the same heaviest term stand together: tight bounds
        self.order = np.array(sorted(range(self.n), key=lambda i: (full[i][0][np.argmax(full[i][1])], i)), np.int64)
        blocks = -(-self.n // block)
        term = np.concatenate([full[i][0] for i in self.order]) if self.n else np.zeros(0, np.int64)
        place = np.repeat(np.arange(self.n), [len(full[i][0]) for i in self.order])
        weight = np.concatenate([full[i][1] for i in self.order]) if self.n else np.zeros(0)
        by_term = np.lexsort((place, term))
        term, self.place, self.weight = term[by_term], place[by_term], weight[by_term]
        # postings of term t in block b: ends[t, b] to ends[t, b + 1]
        key = term * blocks + self.place // block
        self.ends = np.searchsorted(key, np.arange((n_terms + 1) * blocks + 1))
        self.blocks = blocks
        self.largest = np.zeros((n_terms + 1, blocks))
        np.maximum.at(self.largest.reshape(-1), key, self.weight)
        self.visited = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, similarities) of the ``k`` nearest and all that tie
        with the last of them, by falling similarity, then number."""
        terms, weights = np.append(terms, self.n_terms), np.append(weights, self.common)
        weights = weights / np.sqrt((weights * weights).sum())
        bound = weights @ self.largest[terms] + 1e-9  # more than any rounding
        found, scores, least = np.zeros(0, np.int64), np.zeros(0), -1.0
        seen = np.zeros(self.blocks, bool)
        best = np.argsort(-bound, kind="stable")[:-(-2 * k // self.block)]  # enough for a first K-th best
        for ahead in (best, None):
            open_ = ~seen & (bound >= least) if ahead is None else np.isin(np.arange(self.blocks), ahead)
            places, sums = self._exact(terms, weights, open_)
            seen |= open_
            self.visited += int(open_.sum())
            found, scores = np.concatenate([found, self.order[places]]), np.concatenate([scores, sums])
            if len(scores) >= k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                found, scores = found[scores >= least], scores[scores >= least]
        ranked = np.lexsort((found, -scores))
        return found[ranked], scores[ranked]

    def _exact(self, terms: np.ndarray, weights: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of all examples of the ``open_`` blocks."""
        sums = np.zeros(self.n)
        few = np.flatnonzero(open_) if 4 * open_.sum() < self.blocks else None
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            if few is None:
                cuts = [(self.ends[t * self.blocks], self.ends[(t + 1) * self.blocks])]
            else:
                cuts = zip(self.ends[t * self.blocks + few].tolist(), self.ends[t * self.blocks + few + 1].tolist(), strict=True)
            for i, j in cuts:
                if i < j:
                    sums[self.place[i:j]] += w * self.weight[i:j]
        places = np.flatnonzero(np.repeat(open_, self.block)[:self.n])
        return places, sums[places]


def vote(similarity: np.ndarray, labels: np.ndarray) -> float:
    weight = np.maximum(similarity, 0.0) ** POWER
    total = weight.sum()
    return float((weight * labels).sum() / total) if total > 0 else 0.0


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: (distinct x, non-falling means)."""
    xs, at = np.unique(x, return_inverse=True)
    w = np.bincount(at, weight)
    means = np.bincount(at, weight * y) / w
    pools: list[list[float]] = []
    for m, v in zip(means.tolist(), w.tolist(), strict=True):
        pools.append([m, v, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, v2, n2 = pools.pop()
            m1, v1, n1 = pools[-1]
            pools[-1] = [(m1 * v1 + m2 * v2) / (v1 + v2), v1 + v2, n1 + n2]
    return xs, np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


@dataclass
class Model:
    """Marking terms with their IDF, labelled examples, index and calibration."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    index: BlockMaxIndex
    votes: np.ndarray
    scores: np.ndarray

    def __post_init__(self):
        self.heads = {t[:PREFIXES[0]] for t in self.terms}

    def terms_of(self, word: str) -> tuple[int, ...]:
        """Numbers of the word's marking terms."""
        if word[:PREFIXES[0]] not in self.heads:
            return ()
        return tuple([self.terms[t] for t in terms_of(word) if t in self.terms])

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(counts), np.int64)
        return at, np.array([counts[t] for t in at.tolist()], float) * self.idf[at]

    def score(self, votes: float) -> float:
        return float(np.interp(votes, self.votes, self.scores))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(example, doc_id, toxic, stands_for, text) of the chosen examples."""
    told = need(labels, ("doc_id", "toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    told = told.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = need(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    distinct = hashed.drop("text").join(told, "doc_id").groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    distinct = materialize(distinct, "toxicity-labelled")
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("hash"))
    chosen = distinct.withColumn("rank", rank).where(F.col("rank") <= EXAMPLES)
    totals = distinct.groupBy("toxic").agg(F.count(F.lit(1)).alias("total"))
    chosen = chosen.join(F.broadcast(totals), "toxic")  # two labels
    chosen = chosen.withColumn("stands_for", F.col("total") / F.least(F.col("total"), F.lit(EXAMPLES)))
    chosen = chosen.withColumn("example", (2 * F.col("rank") + F.col("toxic")).cast("long")).select("example", "doc_id", "hash", "toxic", "stands_for")
    # at most 2 * EXAMPLES rows, each a few numbers
    return hashed.join(F.broadcast(chosen), ["doc_id", "hash"]).dropDuplicates(["example"]).drop("hash")


def _term_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        found = [count_terms(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            *[b.column(n) for n in ("example", "doc_id", "toxic", "stands_for")],
            pa.array([list(c) for c in found], pa.list_(pa.string())),
            pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
        ], names=["example", "doc_id", "toxic", "stands_for", "terms", "counts"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    with tidy_shuffles(docs.sparkSession):
        counted = _sample(docs, labels).mapInArrow(
            _term_batches, "example long, doc_id long, toxic int, stands_for double, terms array<string>, counts array<long>")
        examples = materialize(counted, "toxicity-examples")
        heads = sorted(map(tuple, examples.select("example", "doc_id", "toxic", "stands_for").collect()))
        ones = sum(h[2] for h in heads)
        zeros = len(heads) - ones
        each = examples.select("example", "toxic", F.inline(F.arrays_zip("terms", "counts")))
        seen = each.groupBy("terms").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("texts"))
        marking = seen.where((F.col("texts") >= LEAST_TEXTS) & (F.col("a") * zeros > (F.col("texts") - F.col("a")) * ones))
        marking = marking.withColumn("chi", chi_square(F.col("a"), F.col("texts"), ones, zeros)).where(F.col("chi") >= CHI_SQUARE)
        terms = marking.orderBy(F.desc("chi"), "terms").limit(TERMS).collect() if ones and zeros else []
        number = {r["terms"]: i for i, r in enumerate(terms)}
        idf = np.log((1 + len(heads)) / (1 + np.array([r["texts"] for r in terms], float))) + 1 if terms else np.zeros(0)
        vectors: dict[int, dict[int, int]] = {h[0]: {} for h in heads}
        if terms:
            named = docs.sparkSession.createDataFrame([(t, i) for t, i in number.items()], "terms string, term int")
            found = each.join(F.broadcast(named), "terms").select("example", "term", "counts").toArrow()  # numbers, bounded as the index
            for example, term, n in zip(*[found.column(i).to_numpy().tolist() for i in range(3)], strict=True):
                vectors[example][term] = n
    ids, toxic = np.array([h[1] for h in heads], np.int64), np.array([h[2] for h in heads], np.int64)
    model = Model(number, idf, ids, toxic, BlockMaxIndex([], 0), np.zeros(1), np.full(1, float(ones > 0)))
    if not ones or not zeros:
        return model
    sparse = [model.vector(vectors[h[0]]) for h in heads]
    model.index = BlockMaxIndex(sparse, len(number))
    votes, known = np.zeros(len(heads)), {}
    for i, (t, w) in enumerate(sparse):  # leave one out
        key = (t.tobytes(), w.tobytes(), toxic[i])
        if key not in known:
            near, similar = model.index.search(t, w, K + 1)
            other = near != i
            near, similar = near[other], similar[other]
            if len(near) > K:
                last = similar[K - 1]
                near, similar = near[similar >= last], similar[similar >= last]
            known[key] = vote(similar, toxic[near])
        votes[i] = known[key]
    model.votes, model.scores = isotonic(votes, toxic.astype(float), np.array([h[3] for h in heads]))
    return model


def chi_square(a: Column, texts: Column, ones: int, zeros: int) -> Column:
    """Of a term in ``texts`` examples, ``a`` of them with label 1."""
    n, b = float(ones + zeros), texts - a
    cross = a * F.lit(float(zeros)) - b * F.lit(float(ones))
    return F.lit(n) * cross * cross / (texts * (F.lit(n) - texts) * F.lit(float(max(1, ones)) * max(1, zeros)) + F.lit(1e-9))


class Scorer:
    """Scores texts with a model; keeps the terms of recent words and the results
    of recent vectors."""

    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, tuple[int, ...]] = {}
        self.results: dict[tuple, tuple] = {}

    def __call__(self, text: str | None) -> tuple[float, list, list]:
        if len(self.words) > CACHE:
            self.words.clear()
        known, counts, found = self.words, {}, words(text)
        known.update([(w, self.model.terms_of(w)) for w in set(found) if w not in known])
        for t in [t for w in found if (t := known[w])]:
            for i in t:
                counts[i] = counts.get(i, 0) + 1
        key = tuple(sorted(counts.items()))
        if key not in self.results:
            if len(self.results) > CACHE // 10:
                self.results.clear()
            self.results[key] = self._search(counts)
        return self.results[key]

    def _search(self, counts: dict[int, int]) -> tuple[float, list, list]:
        m = self.model
        terms, weights = m.vector(counts)
        near, similar = m.index.search(terms, weights)
        names = list(m.terms)
        heaviest = np.argsort(-weights, kind="stable")[:K]
        evidence = [{"doc_id": int(m.ids[i]), "toxic": int(m.labels[i]), "similarity": float(s)} for i, s in zip(near[:K], similar[:K], strict=True)]
        return m.score(vote(similar, m.labels[near])), evidence, [names[i] for i in terms[heaviest]]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, neighbours, terms) of every row: the score, the K nearest
    examples, and the text's heaviest marking terms."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see above

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(shared.value)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))
        for b in batches:
            found = [scorer(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([f[0] for f in found], pa.float64()),
                pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.list_(pa.string())),
            ], names=["doc_id", "score", "neighbours", "terms"])

    rows = need(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, SCORED)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels teach nothing (and those without an id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
