"""SimHash fingerprints and near-duplicate groups by a Gray-order index.

Fingerprint: ASCII letters in lower case, words between ASCII white space,
shingles of ``shingle`` words, XXH64 (seed 42) of each; a bit is set if it is
set in over half the hashes. Equal fingerprints are one node from there on, so
exact copies, however many, cost one row.

Links (at most ``distance`` differing bits) come from a hierarchical index:

* Upper nodes are masked bit patterns. The 64 bits fall into distance + 2
  blocks; two fingerprints within the distance agree on at least two blocks, so
  they share one of the patterns "two blocks given, the rest free".
* All (pattern, fingerprint) rows are sorted by pattern and by Gray rank of the
  fingerprint, as a range-partitioned sort: a pattern that holds a third of the
  fingerprints is spread over many tasks.
* Inside a pattern, runs of the Gray order become leaves; a node factors out the
  bits that all fingerprints below it share. Two nodes that differ in more than
  ``distance`` shared bits are pruned with all pairs below them, and so are
  two nodes whose fingerprints are all linked already.
* Patterns longer than a page, or cut by a task's edge, leave pages (at most
  PAGE fingerprints with their shared bits); pages of one pattern are then
  compared pair by pair in further tasks, unless their shared bits differ too
  much.

A task emits a spanning star of what it has linked, never all pairs. Connected
components alternate large-star and small-star steps over tables written to the
shared folder.

Null text counts as empty; texts without words have fingerprint 0. Null ids are
kept; a group's id is its smallest non-null id. Repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import need
from specweave.session import materialize

SHINGLE = 4
DISTANCE = 4
SEED = 42
LEAF = 32
FANOUT = 8
PAGE = 4096


def _hash_shingles(text: str, shingle: int) -> list[int]:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [digest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1:], strict=False)]


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes (uint64) that begins at ``starts``."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    counts = np.diff(np.append(starts, len(hashes)))
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprint_texts(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    hashes = [_hash_shingles(t, shingle) if t else [] for t in texts]
    full = [i for i, h in enumerate(hashes) if h]
    if full:
        sizes = [len(hashes[i]) for i in full]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        flat = np.fromiter((x for i in full for x in hashes[i]), np.uint64, sum(sizes))
        out[full] = majority(flat, starts)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from specweave.llm.langid import chunks

        for b in batches:
            texts = b.column("text").to_pylist()
            found = [fingerprint_texts(texts[cut], shingle) for cut in chunks(texts)]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            rest = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(fp.view(np.int64))], names=[*rest, "fp"])

    rows = need(docs, ("doc_id", "text", *keep)).withColumn("doc_id", F.col("doc_id").cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, kinds + ", fp long")


def gray_rank(fp: Column) -> Column:
    """Position of the 64 bits in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def patterns(distance: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Pairs of (lowest bit, width) of the blocks that a pattern fixes."""
    n = distance + 2
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    lows = [0, *accumulate(widths)][:n]
    return list(combinations(zip(lows, widths, strict=True), 2))


def _pattern_keys(fp: Column, distance: int) -> Column:
    keys = []
    for t, ((low_a, width_a), (low_b, width_b)) in enumerate(patterns(distance)):
        a = F.shiftrightunsigned(fp, low_a).bitwiseAND(F.lit((1 << width_a) - 1).cast("long"))
        b = F.shiftrightunsigned(fp, low_b).bitwiseAND(F.lit((1 << width_b) - 1).cast("long"))
        keys.append(F.lit(t).cast("long") * F.lit(1 << 48) + a * F.lit(1 << 24) + b)
    return F.array(*keys)


class Labels:
    """Smallest index of each index's component, under added links."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while len(a):
            x, y = of[a], of[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = of[of]
                if (up == of).all():
                    break
                of[:] = up


def _shared(ones: np.ndarray, any_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, pattern) from AND and OR: the bits that all share, and their values."""
    return ~(ones ^ any_), ones


class GrayIndex:
    """Index over fingerprints (uint64) in Gray order."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.levels = []  # from leaves up: (mask, pattern) of each node
        starts = np.arange(0, len(fps), LEAF)
        ones, any_ = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
        self.levels.append(_shared(ones, any_))
        while len(ones) > 1:
            starts = np.arange(0, len(ones), FANOUT)
            ones, any_ = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(any_, starts)
            self.levels.append(_shared(ones, any_))

    def near(self, other: GrayIndex, level: int, other_level: int, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
        (ma, pa), (mb, pb) = self.levels[level], other.levels[other_level]
        return np.bitwise_count(ma[a] & mb[b] & (pa[a] ^ pb[b])) <= distance

    def _leaf_labels(self, of: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        own = of[shift:shift + len(self.fps)]
        starts = np.arange(0, len(self.fps), LEAF)
        return np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)

    def leaf_pairs(self, other: GrayIndex, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that the levels above do not prune; for the index
        with itself each unordered pair once."""
        same = self is other
        start = (len(self.levels) - 1, len(other.levels) - 1)
        todo = [(*start, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            la, lb, a, b = todo.pop()
            ok = self.near(other, la, lb, a, b, distance)
            a, b = a[ok], b[ok]
            if same and la == lb:
                once = a <= b
                a, b = a[once], b[once]
            if not len(a):
                continue
            if not la and not lb:
                yield a, b
                continue
            step = 1 << 14  # pairs expanded at once, to bound memory
            for i in range(0, len(a), step):
                x, y = a[i:i + step], b[i:i + step]
                ka = FANOUT if la else 1
                kb = FANOUT if lb else 1
                x = np.repeat(x * ka, ka * kb) + np.tile(np.repeat(np.arange(ka), kb), len(x))
                y = np.repeat(y * kb, ka * kb) + np.tile(np.arange(kb), ka * len(y))
                na, nb = max(0, la - 1), max(0, lb - 1)
                inside = (x < len(self.levels[na][0])) & (y < len(other.levels[nb][0]))
                todo.append((na, nb, x[inside], y[inside]))

    def link(self, other: GrayIndex, labels: Labels, shift: int, distance: int) -> None:
        """Links between the two indexes; ``other`` has the labels from ``shift``."""
        for a, b in self.leaf_pairs(other, distance):
            step = 256
            for i in range(0, len(a), step):
                x, y = a[i:i + step], b[i:i + step]
                low_a, high_a = self._leaf_labels(labels.of, 0)
                low_b, high_b = other._leaf_labels(labels.of, shift)
                open_ = (low_a[x] != high_a[x]) | (low_b[y] != high_b[y]) | (low_a[x] != low_b[y])
                x, y = x[open_], y[open_]
                if not len(x):
                    continue
                ia = (x[:, None] * LEAF + np.arange(LEAF))
                ib = (y[:, None] * LEAF + np.arange(LEAF))
                fa = self.fps[np.minimum(ia, len(self.fps) - 1)]
                fb = other.fps[np.minimum(ib, len(other.fps) - 1)]
                p, q, r = np.nonzero(np.bitwise_count(fa[:, :, None] ^ fb[:, None, :]) <= distance)
                left, right = ia[p, q], ib[p, r]
                inside = (left < len(self.fps)) & (right < len(other.fps))
                labels.link(left[inside], right[inside] + shift)


def link_group(fps: np.ndarray, distance: int) -> np.ndarray:
    """Component label (index of its first member) of fingerprints in Gray order."""
    labels = Labels(len(fps))
    index = GrayIndex(fps)
    leaves = len(index.levels[0][0])
    # neighbours in Gray order first, so that whole leaves are linked early
    labels.link(*_adjacent(fps, distance))
    if leaves:
        index.link(index, labels, 0, distance)
    return labels.of


def _adjacent(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.bitwise_count(fps[1:] ^ fps[:-1]) <= distance)
    return at, at + 1


def _star(fps: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(of != np.arange(len(of)))
    return fps[at], fps[of[at]]


_LINKED = "u long, v long, key long, page long, mask long, pattern long, members array<long>"


def _link_rows(distance: int):
    """mapInArrow over (key, fp) sorted by key and Gray rank."""

    def batch(u, v, pages):
        import pyarrow as pa

        u, v = np.asarray(u, np.uint64).view(np.int64), np.asarray(v, np.uint64).view(np.int64)
        n, m = len(u), len(pages)
        none = [None] * n
        return pa.RecordBatch.from_arrays(
            [pa.array(list(u) + [None] * m, pa.int64()), pa.array(list(v) + [None] * m, pa.int64())]
            + [pa.array(none + [p[i] for p in pages], pa.int64()) for i in range(4)]
            + [pa.array(none + [p[4] for p in pages], pa.list_(pa.int64()))],
            names=["u", "v", "key", "page", "mask", "pattern", "members"],
        )

    def page_row(key: int, number: int, fps: np.ndarray):
        mask, pattern = _shared(np.bitwise_and.reduce(fps), np.bitwise_or.reduce(fps))
        signed = np.array([mask, pattern], np.uint64).view(np.int64)
        return (int(key), number, int(signed[0]), int(signed[1]), fps.view(np.int64))

    def small(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Stars of many groups of at most a leaf each, compared by offsets."""
        labels = Labels(len(fps))
        for d in range(1, LEAF):
            same = keys[d:] == keys[:-d]
            if not same.any():
                break
            at = np.flatnonzero(same & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= distance))
            labels.link(at, at + d)
        return _star(fps, labels.of)

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first_key, paged = None, None  # paged: the key whose pages have begun

        def flush(keys, fps, last: bool):
            """Whole groups of a sorted run; the run's last group stays open
            unless ``last``. Yields result batches and keeps the open rows."""
            nonlocal number, rest_k, rest_f, first_key, paged
            if not len(keys):
                return
            if first_key is None:
                first_key = keys[0]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            sizes = np.diff(cuts)
            u, v, pages = [], [], []
            whole = len(sizes) if last else len(sizes) - 1
            edge = np.zeros(len(sizes), bool)
            edge[keys[cuts[:-1]] == first_key] = True  # the task before may hold more of it
            if last:
                edge[-1] = True  # so may the task behind
            if paged is not None:
                edge[keys[cuts[:-1]] == paged] = True
            take = np.flatnonzero((sizes[:whole] > 1) & (sizes[:whole] <= LEAF) & ~edge[:whole])
            if len(take):
                rows = np.zeros(len(keys), bool)
                mark = np.zeros(len(keys) + 1, np.int64)
                np.add.at(mark, cuts[take], 1)
                np.add.at(mark, cuts[take + 1], -1)
                rows = np.cumsum(mark[:-1]) > 0
                a, b = small(keys[rows], fps[rows], distance)
                u.append(a)
                v.append(b)
            for g in np.flatnonzero(((sizes > LEAF) | edge)[:whole]):
                own = fps[cuts[g]:cuts[g + 1]]
                for i in range(0, len(own), PAGE):
                    part = own[i:i + PAGE]
                    if len(part) > 1:
                        a, b = _star(part, link_group(part, distance))
                        u.append(a)
                        v.append(b)
                    if edge[g] or len(own) > PAGE:
                        number += 1
                        pages.append(page_row(keys[cuts[g]], number, part))
            rest_k, rest_f = keys[cuts[whole]:], fps[cuts[whole]:]
            if not last and len(rest_k) >= PAGE:  # an open group longer than a page: page by page
                paged = rest_k[0]
                full = len(rest_f) // PAGE * PAGE
                for i in range(0, full, PAGE):
                    part = rest_f[i:i + PAGE]
                    a, b = _star(part, link_group(part, distance))
                    u.append(a)
                    v.append(b)
                    number += 1
                    pages.append(page_row(paged, number, part))
                rest_k, rest_f = rest_k[full:], rest_f[full:]
            if u or pages:
                yield batch(np.concatenate(u) if u else [], np.concatenate(v) if v else [], pages)

        for b in batches:
            keys = b.column("key").to_numpy(zero_copy_only=False)
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            yield from flush(np.concatenate([rest_k, keys]), np.concatenate([rest_f, fps]), False)
        yield from flush(rest_k, rest_f, True)

    return run


def _cross_pages(distance: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for left, right in zip(b.column("left"), b.column("right"), strict=True):
                x = left.values.to_numpy(zero_copy_only=False).view(np.uint64)
                y = right.values.to_numpy(zero_copy_only=False).view(np.uint64)
                labels = Labels(len(x) + len(y))
                GrayIndex(x).link(GrayIndex(y), labels, len(x), distance)
                u, v = _star(np.concatenate([x, y]), labels.of)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return run


def near_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) links that connect exactly what links of at most ``distance``
    bits connect, from distinct fingerprints (fp)."""
    rows = nodes.select("fp", F.explode(_pattern_keys(F.col("fp"), distance)).alias("key"))
    rows = rows.withColumn("rank", gray_rank(F.col("fp")))
    order = [F.col("key"), F.shiftrightunsigned("rank", 1), F.col("rank").bitwiseAND(F.lit(1).cast("long"))]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "fp")
    linked = materialize(rows.mapInArrow(_link_rows(distance), _LINKED), "simhash-links")
    pages = linked.where("key IS NOT NULL")
    a = pages.select("key", F.col("page").alias("pa"), F.col("mask").alias("ma"), F.col("pattern").alias("ta"), F.col("members").alias("left"))
    b = pages.select("key", F.col("page").alias("pb"), F.col("mask").alias("mb"), F.col("pattern").alias("tb"), F.col("members").alias("right"))
    apart = F.bit_count(F.col("ma").bitwiseAND(F.col("mb")).bitwiseAND(F.col("ta").bitwiseXOR(F.col("tb"))))
    pairs = a.join(b, "key").where((F.col("pa") < F.col("pb")) & (apart <= distance)).select("left", "right")
    more = pairs.mapInArrow(_cross_pages(distance), "u long, v long")
    return linked.where("u IS NOT NULL").select("u", "v").unionByName(more).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node.

    Large-star and small-star steps alternate until the table stays the same;
    each result is written to the shared folder, which cuts the lineage."""

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    def star(edges: DataFrame, large: bool) -> DataFrame:
        # edges (u, v) with u > v
        if large:
            near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            near = edges
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        moved = near.join(low, "u")
        if large:
            out = moved.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        else:
            out = moved.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        return out.where("u <> v").distinct()

    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "simhash-cc")
    before = state(edges)
    while before[0]:
        edges = materialize(star(materialize(star(edges, True), "simhash-cc"), False), "simhash-cc")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _labelled(found: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id) of every fingerprint in ``found`` (doc_id, fp)."""
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    found = materialize(fingerprints(docs, shingle), "simhash")
    out = found.join(_labelled(found, distance), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, among
    rows of that id the one with the smallest hash of all its columns.

    Rows without an id that are linked to none with one stay as a group of
    their own (one row).
    """
    row_col, kept_id, kept_row = _free(docs, "row", "kept_id", "kept_row")
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields])
    keyed = docs.withColumn(row_col, row)
    found = materialize(fingerprints(keyed, shingle, (row_col,)), "simhash")
    grouped = found.join(_labelled(found, distance), "fp")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row_col).alias("row"))).alias("b")
    with_id = grouped.where("component_id IS NOT NULL").groupBy("component_id").agg(best)
    without = grouped.where("component_id IS NULL").groupBy("fp").agg(best)
    kept = with_id.select("b").unionByName(without.select("b")).select(F.col("b.doc_id").alias(kept_id), F.col("b.row").alias(kept_row))
    same = (F.col(row_col) == F.col(kept_row)) & F.col("doc_id").eqNullSafe(F.col(kept_id))
    hit = keyed.join(kept, same, "left_semi")
    # equal rows of one id have equal hashes: only one of them stays. They are
    # merged where they lie before the shuffle, so none moves more than once a task.
    again = found.groupBy("doc_id", row_col).count().where("count > 1").select(F.col("doc_id").alias(kept_id), F.col(row_col).alias(kept_row))
    if not again.isEmpty():
        others = [F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns if c != "doc_id"]
        double = hit.join(again, same, "left_semi").groupBy("doc_id", row_col).agg(*others)
        hit = hit.join(again, same, "left_anti").unionByName(double)
    return hit.select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(df: DataFrame, *names: str) -> list[str]:
    """The names behind underscores that no column of ``df`` begins with."""
    lead = "__"
    while any(c.startswith(lead) for c in df.columns):
        lead += "_"
    return [lead + n for n in names]
