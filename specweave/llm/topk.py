"""Exact top-k by integer inner product with M-trees.

Components become floor(256 x). With M the largest norm of all vectors, each
candidate is extended by sqrt(M^2 - |x|^2) and each query by 0: then
|q - x|^2 = |q|^2 + M^2 - 2 <q, x>, so nearest in this metric space is highest
inner product, and triangle-inequality bounds are bounds on scores. Distances
only prune (with a margin for rounding); scores are exact integers.

* Rows are dealt to the nearest of PIVOTS routing vectors (from a bounded
  sample of SAMPLE rows; it decides where a row is stored, never whether it is
  searched). Each routing vector's rows are cut by a hash of the row into parts
  of about TREE_ROWS, so one vector that makes up a third of the table still
  makes many trees of bounded size.
* Each part becomes an M-tree: nodes are pages of at most LEAF vectors or FANOUT
  children, and each entry stores its covering radius and its distance to the
  parent's routing vector.
* Queries meet the trees block by block: groups of trees and blocks of queries
  are cogrouped, both of bounded size.
* A query runs best-first over its trees: a heap ordered by lower bounds. Before
  a distance is computed, |d(q, parent) - d(entry, parent)| bounds it from
  stored values. Search starts from the query's k-th best score in the sample.

Rows whose vector or id is null, or with null, NaN or infinite components, take
no part; vectors of different lengths never meet. A query's own row is every row
with its id. Repeated rows stay candidates; a repeated query is searched once.
With fewer than k candidates all are returned. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.common import need
from specweave.session import materialize

SAMPLE = 1024
PIVOTS = 64
TREE_ROWS = 8192
TREES_PER_GROUP = 8
QUERY_BLOCK = 8192
LEAF = 512
FANOUT = 16
SCALE = 256.0


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; float64 sums where they are exact, else Python integers."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, vectors.shape[1])
    if bound < 2**53:
        return (vectors @ query).astype(np.int64)
    whole = [[int(x) for x in row] for row in vectors]
    q = [int(x) for x in query]
    return np.array([sum(a * b for a, b in zip(row, q, strict=True)) for row in whole], np.int64)


class MTree:
    """M-tree over rows (id, vector) in the extended space.

    A node is [routing row, radius, distance to the parent's routing row,
    children or None, entries, entries' distances to the routing row, children's
    radii or None]; entries are the rows of a leaf or the children's routing rows.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float):
        self.ids, self.vectors = ids, vectors
        squares = (vectors * vectors).sum(axis=1)
        self.extra = np.sqrt(np.maximum(0.0, norm * norm - squares))
        self.norm = norm
        self.root = self._build(np.arange(len(ids)))

    def _distances(self, row: int, rows: np.ndarray) -> np.ndarray:
        d = self.vectors[rows] - self.vectors[row]
        e = self.extra[rows] - self.extra[row]
        return np.sqrt((d * d).sum(axis=1) + e * e)

    def _build(self, rows: np.ndarray):
        """Bulk load: rows go to the nearest of FANOUT routing rows, spread by
        farthest-first choice, until they fit a page."""
        router = int(rows[0])
        away = self._distances(router, rows)
        if len(rows) <= LEAF or not away.any():
            order = np.argsort(away, kind="stable")
            pages = [rows[order[i:i + LEAF]] for i in range(0, len(rows), LEAF)]
            if len(pages) == 1:
                return [router, float(away.max(initial=0)), 0.0, None, pages[0], away[order], None]
            leaves = [[router, 0.0, 0.0, None, p, np.zeros(len(p)), None] for p in pages]
            return self._inner(router, 0.0, leaves)
        chosen, nearest, owner = [router], away.copy(), np.zeros(len(rows), np.int64)
        while len(chosen) < min(FANOUT, -(-len(rows) // LEAF) + 1):
            far = int(nearest.argmax())
            if nearest[far] == 0:
                break
            d = self._distances(int(rows[far]), rows)
            owner[d < nearest] = len(chosen)
            nearest = np.minimum(nearest, d)
            chosen.append(int(rows[far]))
        children = []
        for i, c in enumerate(chosen):
            own = rows[owner == i]
            if not len(own):
                continue
            own = np.concatenate([[c], own[own != c]])
            child = self._build(own)
            child[2] = float(self._distances(router, np.array([c]))[0])
            children.append(child)
        return self._inner(router, float(away.max()), children)

    @staticmethod
    def _inner(router: int, radius: float, children: list):
        of = [np.array([c[i] for c in children]) for i in (0, 2, 1)]
        return [router, radius, 0.0, children, *of]

    def distances(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = self.vectors[rows] - query
        return np.sqrt((d * d).sum(axis=1) + self.extra[rows] ** 2)

    def distance(self, query: np.ndarray, row: int) -> float:
        d = self.vectors[row] - query
        return math.sqrt(float(d @ d) + float(self.extra[row]) ** 2)


class Search:
    """The k best of one query over any number of trees."""

    def __init__(self, query_id: int, query: np.ndarray, k: int, norm: float, floor_score: float):
        self.id, self.q, self.k, self.norm = query_id, query, k, norm
        self.square = float(query @ query)
        self.best: list[tuple[int, int]] = []  # heap of (score, -id): worst first
        self.floor = floor_score  # k-th best score known elsewhere
        self.computed = self.avoided = 0
        self._limit()

    def _limit(self) -> None:
        """Largest distance that can still matter: that of the k-th best score,
        with a margin for rounding."""
        score = max(self.floor, self.best[0][0] if len(self.best) == self.k else -math.inf)
        total = self.square + self.norm * self.norm
        self.limit = math.inf if score == -math.inf else math.sqrt(max(0.0, total - 2 * score)) + 1e-6 * (1 + math.sqrt(total))

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        worst = self.best[0][0] if len(self.best) == self.k else -math.inf
        for i in np.flatnonzero(scores >= worst) if worst > -math.inf else range(len(scores)):
            if ids[i] == self.id:
                continue
            item = (int(scores[i]), -int(ids[i]))
            if len(self.best) < self.k:
                heapq.heappush(self.best, item)
            elif item > self.best[0]:
                heapq.heapreplace(self.best, item)
        self._limit()

    def run(self, trees: list[MTree]) -> None:
        heap, tick = [], 0
        for tree in trees:
            if len(tree.ids):
                d = tree.distance(self.q, tree.root[0])
                self.computed += 1
                heapq.heappush(heap, (max(0.0, d - tree.root[1]), tick, d, tree, tree.root))
                tick += 1
        while heap:
            low, _, d, tree, node = heapq.heappop(heap)
            if low > self.limit:
                break
            _, _, _, children, rows, stored, radii = node
            # distances to the routing row, stored, against this query's
            near = np.flatnonzero(np.abs(d - stored) <= self.limit + (0.0 if radii is None else radii))
            self.avoided += len(rows) - len(near)
            self.computed += len(near)
            if not len(near):
                continue
            if children is None:
                self.offer(exact_scores(tree.vectors[rows[near]], self.q), tree.ids[rows[near]])
                continue
            away = tree.distances(self.q, rows[near])
            bounds = np.maximum(0.0, away - radii[near])
            for i in np.flatnonzero(bounds <= self.limit):
                heapq.heappush(heap, (float(bounds[i]), tick, float(away[i]), tree, children[near[i]]))
                tick += 1


def prepared(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, dim, v): rows that take part, components as integral doubles."""
    rows = need(table, (id_col, vector)).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(sound)
    # beyond 2^52 a double is whole already, and a long may not hold it
    scaled = F.transform("x", lambda c: F.when(F.abs(c * SCALE) < 2.0**52, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    return rows.select("id", F.size("x").alias("dim"), scaled.alias("v"))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of
    ``vectors``; both (id, dim, v) as from ``prepared``."""
    spark = vectors.sparkSession
    stored = materialize(vectors, "topk-rows")
    asked = materialize(queries.dropDuplicates(["id", "v"]).withColumn("query", F.monotonically_increasing_id()), "topk-queries")
    facts = stored.groupBy("dim").agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).alias("norm"))
    facts = {r["dim"]: r["norm"] for r in facts.collect()}  # one row per vector length
    out = [_top_k_dim(stored.where(F.col("dim") == dim), asked.where(F.col("dim") == dim), k, norm) for dim, norm in sorted(facts.items())]
    schema = "query_id long, rank int, vec_id long, score long"
    if not out:
        return spark.createDataFrame([], schema)
    found = out[0]
    for other in out[1:]:
        found = found.unionByName(other)
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _top_k_dim(stored: DataFrame, asked: DataFrame, k: int, norm: float) -> DataFrame:
    # a bounded sample: the SAMPLE smallest hashes of rows
    sample = stored.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toPandas()
    sample_ids, sample_vectors = sample["id"].to_numpy(), _matrix(sample["v"])
    pivots = np.unique(sample_vectors, axis=0)
    pivots = pivots[np.random.default_rng(7).permutation(len(pivots))[:PIVOTS]]

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            v = np.stack([x.values.to_numpy(zero_copy_only=False) for x in b.column("v")]) if b.num_rows else np.zeros((0, pivots.shape[1]))
            # nearest routing vector: |v|^2 is common to all
            near = ((pivots * pivots).sum(axis=1)[None, :] - 2 * v @ pivots.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near.astype(np.int32))], names=["id", "v", "router"])

    routed = materialize(stored.mapInArrow(assign, "id long, v array<double>, router int"), "topk-routed")
    sizes = {r["router"]: r["count"] for r in routed.groupBy("router").count().collect()}  # at most PIVOTS rows
    parts = {r: max(1, -(-c // TREE_ROWS)) for r, c in sizes.items()}
    first, trees = {}, 0
    for r in sorted(parts):
        first[r] = trees
        trees += parts[r]
    lookup = F.create_map(*[F.lit(x) for r in parts for x in (r, parts[r])])
    offset = F.create_map(*[F.lit(x) for r in first for x in (r, first[r])])
    spread = F.pmod(F.xxhash64("id", "v", F.spark_partition_id(), F.monotonically_increasing_id()), lookup[F.col("router")])
    treed = materialize(routed.withColumn("tree", (offset[F.col("router")] + spread).cast("int")), "topk-trees")
    groups = max(1, -(-trees // TREES_PER_GROUP))
    # blocks of queries; every block meets every group of trees
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    left = treed.withColumn("grp", (F.col("tree") % groups).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(rows, asks):
        import pandas as pd

        found = []
        if len(rows) and len(asks):
            forest = [MTree(t["id"].to_numpy(), _matrix(t["v"]), norm) for _, t in rows.groupby("tree")]
            for i, number, q in zip(asks["id"].to_numpy(), asks["query"].to_numpy(), _matrix(asks["v"]), strict=True):
                seed = exact_scores(sample_vectors, q)[sample_ids != i]
                floor_score = float(np.partition(seed, -k)[-k]) if len(seed) >= k else -math.inf
                s = Search(int(i), q, k, norm, floor_score)
                s.run(forest)
                found += [(int(i), int(number), -v, c) for c, v in s.best]
        return pd.DataFrame(found, columns=["query_id", "query", "vec_id", "score"]).astype("int64")

    return left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInPandas(search, "query_id long, query long, vec_id long, score long")
