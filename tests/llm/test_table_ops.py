"""Sharding, top-k, SimHash, decontamination, quality and chat against
brute-force versions, and odd rows."""

import json
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from specweave.llm import chat, decontaminate, quality, queries, sharding, simhash, topk
from specweave.llm.common import table

SF = "/root/testdata/sf0.001"


# --- sharding ----------------------------------------------------------


def test_shards_slots_and_growth(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = queries.op6_rendezvous_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    slots = defaultdict(list)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 24 and max(map(len, slots.values())) < 3 * len(got) / 24
    moved = sum(r["grown_shard"] == 24 for r in got)
    assert 0.01 < moved / len(got) < 0.08


def test_shards_agree_with_the_grown_count_and_weights(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    before = {r["doc_id"]: r for r in sharding.shard_rows(df, [1.0] * 5).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(df, [1.0] * 6).collect()}
    assert all(r["grown_shard"] == after[i] for i, r in before.items())
    n = Counter(r["shard"] for r in sharding.shard_rows(df, [1.0, 3.0]).collect())
    assert 2.6 < n[1] / n[0] < 3.4
    with pytest.raises(ValueError):
        sharding.choose(df["doc_id"].cast("string"), [1.0, 0.0])


def test_shards_of_odd_rows(spark):
    rows = [(None, None, 1), (None, "a", 1)] + [(7, "same", 1)] * 5 + [(8, "é" * 100_000, 1)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, shard int"), [1.0] * 3).collect()
    assert sorted(r["size"] for r in got) == [8, 9, 12, 12, 12, 12, 12, 200_008]
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string"), [1.0]).count() == 0


def brute_shard(key, weights):
    """The law by the xxhash library: best shard of a key, lower of equals."""
    best = None
    for i, w in enumerate(weights):
        draw = xxhash.xxh64_intdigest(struct.pack("<i", i), xxhash.xxh64_intdigest(key.encode(), 42)) >> 12
        score = -w / math.log((draw + 0.5) / 2**52)
        if best is None or score > best[0] + 1e-15 * abs(score):
            best = (score, i)
    return best[1]


def test_shards_equal_the_law(spark):
    got = queries.op6_rendezvous_sharding(spark, SF).collect()
    for r in got:
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == brute_shard(key, [1.0] * 24) and r["grown_shard"] == brute_shard(key, [1.0] * 25)
    weighted = sharding.shard_rows(spark.range(300).selectExpr("id AS doc_id", "'x' AS text"), [1.0, 2.5, 0.5]).collect()
    assert all(r["shard"] == brute_shard(str(r["doc_id"]), [1.0, 2.5, 0.5]) for r in weighted)


def test_rows_of_a_hot_key_are_numbered_in_many_buckets(spark, monkeypatch):
    tables = []
    keep = sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, name: tables.append(keep(df, name)) or tables[-1])
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS doc_id", "CAST(id AS string) AS text")
    got = sharding.shard_rows(df, [1.0] * 4)
    assert got.count() == 30_000
    assert tables[0].groupBy("shard", "bucket").agg({"n": "sum"}).agg({"sum(n)": "max"}).first()[0] < 20
    slots = got.groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert all(r["max(slot)"] + 1 == r["count(1)"] for r in slots) and got.select("shard", "slot").distinct().count() == 30_000


# --- top-k -------------------------------------------------------------


def brute_top(rows, queries_, k):
    out = set()
    for qid, q in {(i, tuple(v)) for i, v in queries_}:
        scored = sorted(((-int(np.dot(q, v)), i) for i, v in rows if i != qid and len(v) == len(q)))[:k]
        out |= {(qid, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("leaf", [2, 128])
def test_m_tree_search_equals_brute_force(leaf, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", leaf)
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(-9, 10, (400, 6)), np.repeat(rng.integers(-9, 10, (3, 6)), 60, axis=0)]).astype(float)
    ids = np.arange(len(v))
    norm = float(np.sqrt((v * v).sum(axis=1)).max())
    trees = [topk.MTree(ids[i::3], v[i::3], norm) for i in range(3)]
    avoided = 0
    for i in range(0, len(v), 7):
        s = topk.Search(i, v[i], 5, norm, -math.inf)
        s.run(trees)
        avoided += s.avoided
        want = sorted((-int(v[j] @ v[i]), j) for j in ids if j != i)[:5]
        assert sorted((-c, -m) for c, m in s.best) == want
    assert avoided > 0


def test_top_k_query(spark):
    rows = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], float))) for r in table(spark, SF, "embeddings").collect()]
    got = {tuple(r) for r in queries.op7_mtree_topk(spark, SF).collect()}
    assert got == brute_top(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_top_k_odd_rows(spark):
    x = [0.5, -0.25]
    rows = [(50, x, 0), (50, x, 0), (1, x, 0), (1, x, 0), (2, [1.0, float("nan")], 0), (3, None, 0), (4, [None, 1.0], 0), (None, x, 0), (5, [1.0], 0), (6, [float("inf"), 0.0], 0), (100, [-1.0, 0.0], 0), (150, [], 0)]
    df = topk.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int"))
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("id % 50 = 0"), 5).collect())
    s = 128 * 128 + 64 * 64
    assert got == [(50, 1, 1, s), (50, 2, 1, s), (50, 3, 100, -256 * 128), (100, 1, 1, -256 * 128), (100, 2, 1, -256 * 128), (100, 3, 50, -256 * 128), (100, 4, 50, -256 * 128)]
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


# --- SimHash -----------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, distance=4):
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for doc, f in pairs:
        r = find(f)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return {(doc, f"{f:016x}", least.get(find(f))) for doc, f in pairs}


def test_simhash_query_equals_brute_force(spark):
    pairs = [(r["doc_id"], brute_fingerprint(r["text"])) for r in table(spark, SF, "documents").collect()]
    got = queries.op3_simhash_gray_index(spark, SF).collect()
    assert {tuple(r) for r in got} == brute_components(pairs) and len(got) == len(pairs)


def clusters(rng, groups, size, flips):
    out = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(size):
            f = base
            for b in rng.sample(range(64), rng.randrange(flips)):
                f ^= 1 << b
            out.add(f)
    return out


def links_components(links):
    root = {}

    def find(f):
        root.setdefault(f, f)
        while root[f] != f:
            f = root[f]
        return f

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(set)
    for f in list(root):
        groups[find(f)].add(f)
    return {frozenset(g) for g in groups.values()}


def test_links_with_pages_and_task_edges(spark, monkeypatch):
    rng = random.Random(8)
    fps = sorted(clusters(rng, 30, 40, 6) | {rng.getrandbits(64) for _ in range(300)})
    signed = [f - (1 << 64 if f >> 63 else 0) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    brute = {frozenset(b for b in g) for g in links_components([(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 4])}
    got = links_components([(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.near_links(nodes).collect()])
    assert got == brute
    # tiny pages: every longer pattern is cut, and pages meet in the second step
    run, rank = simhash._link_rows, lambda f: f
    monkeypatch.setattr(simhash, "PAGE", 8)
    monkeypatch.setattr(simhash, "LEAF", 4)
    import pyarrow as pa

    keyed = []
    for f, s in zip(fps, signed, strict=True):
        for t, ((la, wa), (lb, wb)) in enumerate(simhash.patterns(4)):
            g = f
            for shift in (1, 2, 4, 8, 16, 32):
                g ^= g >> shift
            keyed.append((t << 48 | (f >> la & (1 << wa) - 1) << 24 | f >> lb & (1 << wb) - 1, g, s))
    keyed.sort()
    half = len(keyed) // 2
    links, pages = [], []
    for part in (keyed[:half], keyed[half:]):  # two tasks, in batches of 7 rows
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in part[i:i + 7]], pa.int64()), pa.array([s for _, _, s in part[i:i + 7]], pa.int64())], names=["key", "fp"]) for i in range(0, len(part), 7)]
        for b in run(4)(iter(batches)):
            for r in b.to_pylist():
                links.append((r["u"], r["v"])) if r["key"] is None else pages.append(r)
    cross = [(a, b) for i, a in enumerate(pages) for b in pages[i + 1:] if a["key"] == b["key"]]
    batch = pa.RecordBatch.from_arrays([pa.array([p[i]["members"] for p in cross], pa.list_(pa.int64())) for i in (0, 1)], names=["left", "right"])
    for b in simhash._cross_pages(4)(iter([batch])):
        links += [(r["u"], r["v"]) for r in b.to_pylist()]
    assert links_components([(a % (1 << 64), b % (1 << 64)) for a, b in links]) == brute and len(pages) > 100
    assert rank(1) == 1


def test_group_labels_equal_brute_force():
    rng = random.Random(3)
    for groups, size in ((1, 200), (20, 30), (3, 1)):
        fps = np.array(sorted(clusters(rng, groups, size, 7)), np.uint64)
        of = simhash.link_group(fps, 4)
        want = links_components([(int(a), int(a)) for a in fps] + [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1:] if (int(a) ^ int(b)).bit_count() <= 4])
        groups_ = defaultdict(set)
        for f, o in zip(fps, of, strict=True):
            groups_[int(o)].add(int(f))
        assert {frozenset(g) for g in groups_.values()} == want


def test_simhash_odd_rows_and_keep_one(spark):
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(5, None, 1), (4, "", 1), (None, " \n", 1), (3, "A b", 1), (2, "a B", 1), (2, "a B", 1), (9, long_text, 1), (8, long_text, 1), (None, "only this text here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (None, 4), (3, 2), (2, 2), (2, 2), (9, 8), (8, 8), (None, None)], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=str)
    assert kept == sorted([(4, ""), (2, "a B"), (8, long_text), (None, "only this text here")], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


# --- decontamination ---------------------------------------------------


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_vector_distance_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(400):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 90))]
        text = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))]
        edits, end = decontaminate.best_match(item, text)
        assert edits == brute_distance(item, text)
        assert min(len(item), edits) == edits and brute_distance(item[::-1], text[:end][::-1]) <= edits


def edited(rng, words, k):
    out = list(words)
    for p in sorted(rng.sample(range(len(words)), k), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            out[p] = f"zz{rng.randrange(999)}"
        elif kind == 1:
            del out[p]
        else:
            out.insert(p, f"yy{rng.randrange(999)}")
    return out


def test_recall_of_edited_items(spark):
    rng = random.Random(6)
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    index = decontaminate.Items(items)
    found = n = 0
    for item, text in items * 3:
        words = decontaminate.words_of(text)
        inside = ["pre"] * rng.randrange(30) + edited(rng, words, decontaminate.edits_allowed(len(words))) + ["post"] * rng.randrange(30)
        found += any(m[0] == item for m in index.matches_of_words(inside))
        n += 1
    assert found / n >= 0.95


@pytest.mark.parametrize("kind", ["sub", "del", "ins", "mixed"])
@pytest.mark.parametrize("size, trials", [(10, 200), (31, 200), (59, 200), (120, 100), (250, 60), (500, 40), (1000, 40)])
def test_recall_by_item_length_and_kind_of_edit(size, trials, kind):
    rng = random.Random(size)
    items = [(i, [f"w{rng.randrange(5000)}" for _ in range(size)]) for i in range(trials)]
    index = decontaminate.Items([(i, " ".join(w)) for i, w in items])
    found = 0
    for item, words in items:
        out = list(words)
        for p in sorted(rng.sample(range(size), decontaminate.edits_allowed(size)), reverse=True):
            how = rng.choice(["sub", "del", "ins"]) if kind == "mixed" else kind
            out[p:p + (how != "ins")] = [] if how == "del" else [f"zz{rng.randrange(999)}"]
        inside = [f"a{rng.randrange(999)}" for _ in range(rng.randrange(30))] + out + [f"b{rng.randrange(999)}" for _ in range(30)]
        found += any(m[0] == item for m in index.matches_of_words(inside))
    assert found / trials >= 0.95


def test_decontamination_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    items = {r["item_id"]: decontaminate.words_of(r["text"]) for r in table(spark, SF, "benchmark").collect()}
    got = queries.op2_cgk_decontamination(spark, SF).collect()
    exact = {(d, i) for d, t in docs.items() for i, w in items.items() if " ".join(w) in " ".join(decontaminate.words_of(t or ""))}
    assert exact and exact <= {(r["doc_id"], r["item_id"]) for r in got}
    for r in got:
        words = decontaminate.words_of(docs[r["doc_id"]])
        assert r["edits"] == brute_distance(items[r["item_id"]], words) <= 0.2 * len(items[r["item_id"]])
        inside = decontaminate.words_of(docs[r["doc_id"]][r["start"]:r["end"]])
        assert brute_distance(items[r["item_id"]], inside) == r["edits"]


def test_decontamination_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "short one"), (None, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    filler = "word " * 50_000
    docs = spark.createDataFrame(
        [(1, item.upper(), 0), (2, f"{filler}{item.replace(' five', '')} {filler}", 0), (3, None, 0), (4, "", 0), (5, filler, 0), (None, f"\0 {item}", 0), (6, "alpha beta gamma delta epsilon zeta", 0), (6, "alpha, beta; gamma delta epsilon zeta", 0), (7, "one two three four five", 0)],
        "doc_id long, text string, item_id int")
    got = Counter((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find_matches(docs, bench).collect())
    assert got == Counter({(1, 1, 0): 2, (2, 1, 1): 2, (None, 1, 0): 2, (6, None, 0): 2})
    kept = sorted(str(r["doc_id"]) for r in decontaminate.drop_contaminated(docs, bench).collect())
    assert kept == ["3", "4", "5", "7"]
    assert decontaminate.find_matches(docs, bench.limit(0)).count() == 0 and decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0
    many = decontaminate.blocks(bench, 8)
    assert len(many) > 1 and sum(len(i.ids) for i in many) == 3


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Short one"), (2, "yes"), (3, "a b c d"), (4, "日本語のテキストを読む"), (5, "--"), (6, "short one"), (7, "漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "a short, ONE"), (2, "short"), (3, "one yes"), (4, "a b c e d"), (5, "x a b c d"), (6, "これは日本語のテクストを読む人"), (7, "字漢漢字 short"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["item_id"], r["edits"], rows[r["doc_id"] - 1][1][r["start"]:r["end"]]) for r in decontaminate.find_matches(docs, bench).collect()}
    assert got == {(1, 1, 0, "short, ONE"), (1, 6, 0, "short, ONE"), (3, 2, 0, "yes"), (5, 3, 0, "a b c d"), (6, 4, 1, "日本語のテクストを読む"), (7, 7, 0, "漢字")}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 4, 8]
    index = decontaminate.Items(items)
    assert sorted(m[0] for m in index.matches("yes, short one")) == [1, 2, 6]
    unspaced = spark.createDataFrame([(i, "日本語" * 10) for i in range(8)], "item_id long, text string")
    assert len(decontaminate.blocks(unspaced, 60)) > 1


def test_matches_do_not_depend_on_the_texts_beside():
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for i, n in enumerate([5, 7, 10, 12, 16, 19, 31, 40] * 5)]
    index = decontaminate.Items(items)
    cut = [" ".join(t.split()[:-decontaminate.edits_allowed(len(t.split()))]) for _, t in items]
    alone = [decontaminate._found(index, [t])[0] for t in cut]
    assert all(any(m[0] == i for m in found) for i, found in enumerate(alone))
    assert [index.matches(t) for t in cut] == alone
    for k in range(5):  # behind others and as the last text of a run
        rng.shuffle(order := list(range(len(items))))
        assert decontaminate._found(index, [cut[i] for i in order]) == [alone[i] for i in order]
        assert decontaminate._found(index, ["one", None, "", cut[k], "w1 w2"])[3] == alone[k]
        assert decontaminate._found(index, ["x " * 50, cut[k]])[1] == alone[k]


# --- quality -----------------------------------------------------------


def brute_kneser_ney(trusted, order):
    """Probability of an n-gram (string) by the textbook recursion."""
    pad = "\0" * (order - 1)
    grams = Counter()
    for t in trusted:
        s = pad + " ".join(t.lower().split()) + "\1"
        grams.update(s[i:i + order] for i in range(len(s) - order + 1))
    counts = {order: grams}
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [0] + [min(k, max(0, k - (k + 1) * y * n[k + 1] / n[k])) if n[1] and n[k] else 0.5 * k for k in (1, 2, 3)]

    d = {m: discounts(c) for m, c in counts.items()}
    contexts = {m: defaultdict(list) for m in counts}
    for m, c in counts.items():
        for g, n in c.items():
            contexts[m][g[:-1]].append(n)

    def p(g):
        m = len(g)
        if m == 0:
            return 1 / (len(counts[1]) + 1)
        ns = contexts[m].get(g[:-1])
        below = p(g[1:])
        if not ns:
            return below
        cut = lambda n: d[m][min(n, 3)]
        n = counts[m].get(g, 0)
        return (max(0, n - cut(n)) + sum(min(x, cut(x)) for x in ns) * below) / sum(ns)

    return p


def test_perplexity_equals_brute_force(spark):
    docs = [(r["doc_id"], r["lang"], r["text"]) for r in table(spark, SF, "documents").limit(60).collect()]
    docs += [(900, "en", None), (901, None, " \n "), (902, None, "日本 and é"), (902, None, "日本 and é"), (None, "en", "no id at all")]
    good = [d for d, _, _ in docs if d is not None and d % 3 == 0]
    trusted = spark.createDataFrame([(d,) for d in [*good, *good, None]], "doc_id long")
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, lang string, text string, log_perplexity double")
    got = Counter((r["doc_id"], r["lang"], r["n_grams"], None if r["log_perplexity"] is None else round(r["log_perplexity"], 8)) for r in quality.perplexities(df, trusted).collect())
    p = brute_kneser_ney([t for d, _, t in docs if d in good and t], quality.ORDER)
    want = Counter()
    for d, lang, t in docs:
        s = "\0" * (quality.ORDER - 1) + " ".join((t or "").lower().split()) + "\1"
        grams = [s[i:i + quality.ORDER] for i in range(len(s) - quality.ORDER + 1)] if t and t.split() else []
        want[(d, lang, len(grams), round(-sum(math.log(p(g)) for g in grams) / len(grams), 8) if grams else None)] += 1
    assert got == want


def test_no_two_n_grams_share_a_key():
    # 3,840 + r and 4,095 + r once had one code
    texts = ["ကခ", "ჿᄀ", "日本語", "ệề", "“x”", "한국", "😀", "😁", *(chr(c) * 3 for c in range(0x4E00, 0x4E00 + 600))]
    spelled, keys = set(), set()
    for t in texts:
        units = f"\0\0\0{t}\1".encode("utf-16-le")
        spelled |= {units[i:i + 8] for i in range(0, len(units) - 6, 2)}
        keys |= set(quality.ngrams([t])[0].tolist())
    assert len(keys) == len(spelled)


def test_quality_separates_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    got = queries.op1_kneser_ney_quality(spark, sf).collect()
    assert len(got) == table(spark, sf, "documents").count()
    kept = {q: np.mean([r["keep"] for r in got if labels.get(r["doc_id"]) == q]) for q in (0, 1)}
    assert kept[1] > 0.99 and kept[0] < 0.25


def test_fences_are_quantiles_by_language_and_length(spark):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], 2 ** (6 + i % 4 * (i % 2)) + i % 60, 2 + i % 2 + rng.gauss(0, 0.1)) for i in range(2000)]
    rows += [(5000 + i, "c", 100, 2.5) for i in range(20)]
    schema = "doc_id long, lang string, n_grams long, log_perplexity double"
    scores = spark.createDataFrame(rows, schema)
    got = {(r["lang"], r["class"]): r for r in quality.fences(scores, scores.select("doc_id")).collect() if not r["all_langs"]}
    for lang, size in (("a", 6), ("b", 7), ("b", 9)):
        own = sorted(p for _, l, n, p in rows if l == lang and n.bit_length() - 1 == size)
        if len(own) >= quality.LEAST_TRUSTED:
            r = got[lang, size]
            assert r["low"] <= own[int(0.005 * (len(own) - 1))] < r["low"] + 0.0011
            assert r["high"] - 0.0011 < own[math.ceil(0.995 * (len(own) - 1))] <= r["high"]
    assert got["c", 9]["n_lang"] == 20


def test_quality_drops_repeated_words_and_most_bad_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents").select("doc_id", "lang", "text"), table(spark, sf, "labels")
    added = spark.createDataFrame([(-1, "de", "Der " * 1421), (-2, "en", "Of " * 2008), (-3, "en", "This " * 45)], docs.schema)
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs.unionByName(added), labels.where("quality = 1").select("doc_id")).collect()}
    assert not any(got[i] for i in (-1, -2, -3))
    bad = [got[r["doc_id"]] for r in labels.where("quality = 0").collect() if r["doc_id"] in got]
    assert np.mean(bad) < 0.125


def test_rows_of_one_id_are_dealt_over_blocks(spark, monkeypatch, tmp_path):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "en", f"the text {i % 3} of row {i % 50}") for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "docs"))
    docs, trusted = spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame([(7,), (8,), (8,), (None,)], "doc_id long")
    want = Counter((r["doc_id"], r["n_grams"], round(r["log_perplexity"], 8)) for r in quality.perplexities(docs, trusted).collect())
    count = quality._count_block

    def bounded(key, docs, good):
        assert docs.num_rows < 300  # of 1,200 in over 10 blocks
        return count(key, docs, good)

    monkeypatch.setattr(quality, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(quality, "_count_block", bounded)
    got = Counter((r["doc_id"], r["n_grams"], round(r["log_perplexity"], 8)) for r in quality.perplexities(docs, trusted).collect())
    assert got == want and sum(got.values()) == 1200


def test_quality_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "en", "some text")], "doc_id long, lang string, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert [r["keep"] for r in quality.classify(docs, none).collect()] == [False]
    assert quality.classify(docs.limit(0), none).count() == 0


def test_keep_one_with_clashing_names_and_many_equal_rows(spark):
    words = "one two three four five six seven eight"
    rows = [(1, words, 77, "a")] * 3000 + [(2, words, 88, "b"), (3, "other text " * 9, 88, "c"), (None, None, 5, None), (None, None, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, __row long, __kept_id string").repartition(6)
    got = simhash.keep_one(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, words, 77, "a"), (3, "other text " * 9, 88, "c"), (None, None, 5, None)], key=repr)


# --- chat --------------------------------------------------------------

SCHEMAS = {"sum": {"type": "object", "properties": {"x": {"type": "array", "items": {"type": "number", "maximum": 9}}, "mode": {"enum": ["a", "b"]}}, "required": ["x"], "additionalProperties": False}}


def test_argument_checks():
    check = lambda a, n="sum": chat.check_arguments(n, a, SCHEMAS)[1]
    assert check('{"x":[1,2.5],"mode":"a"}') is None
    assert check('{"mode":"a"}') == "$.x: missing" and check('{"x":[1,"2"]}') == "$.x[1]: not of type number"
    assert check('{"x":[],"mode":"c"}') == "$.mode: not in enum" and check('{"x":[true]}') == "$.x[0]: not of type number"
    assert check('{"x":[],"z":1}') == "$.z: not allowed" and check('{"x":[10]}') == "$.x[0]: range"
    assert check("{}", "other") == "unknown tool" and check(None) == "arguments: missing"
    for bad in ('{"x":[1],"x":[2]}', '{"x":[NaN]}', '{"x":[1e999]}', "{", "[" * 100_000):
        assert check(bad).startswith("arguments:")
    assert chat.canonical({"b": 1, "a": "é\ud800"}) == '{"a":"\\u00e9\\ud800","b":1}'


def test_links_levels_and_cycles(spark):
    calls = [("a", 1, 0, "sum", '{ "x" : [1] }', None), ("b", 1, 2, "sum", '{"x":[2]}', "a"), ("c", 1, 4, "sum", '{"x":[]}', "b"), ("c", 1, 5, "sum", "{}", "b"),
             ("p", 2, 0, "sum", '{"x":[]}', "q"), ("q", 2, 1, "sum", '{"x":[]}', "p"), ("r", 2, 2, "sum", '{"x":[]}', "q"), ("s", 2, 3, "sum", '{"x":[]}', "s"), ("t", 2, 4, "sum", '{"x":[]}', "nowhere"), (None, None, None, None, None, "a")]
    results = [("a", 1, 1, "one"), ("a", 1, 3, "again"), ("c", 1, 6, None), ("zz", 3, 0, "lost"), (None, 3, 1, "no id")]
    cs = spark.createDataFrame([(*c, 1) for c in calls], "call_id string, conv_id long, turn long, name string, arguments string, after string, level int")
    rs = spark.createDataFrame(results, "call_id string, conv_id long, turn long, content string")
    got = chat.link(cs, rs, SCHEMAS).collect()
    assert len(got) == 13
    by = defaultdict(list)
    for r in got:
        by[r["call_id"]].append(r)
    assert [by[i][0]["level"] for i in "bcpqrst"] == [1, 2, None, None, None, 0, 0]
    one = next(r for r in by["a"] if r["linked"])
    assert one["valid"] and one["message"] == '{"arguments":{"x":[1]},"id":"a","name":"sum","result":"one"}' and one["result_turn"] == 1
    assert [r["error"] for r in by["a"] if not r["linked"]] == ["no open call"] and by["p"][0]["error"] == "cycle"
    assert all(r["linked"] for r in by["c"]) and sorted(r["valid"] for r in by["c"]) == [False, True]
    assert sorted(r["error"] for r in by[None]) == ["arguments: missing", "no open call"]
    assert chat.link(cs.limit(0), rs.limit(0), SCHEMAS).count() == 0


def test_identifiers_belong_to_their_conversation(spark):
    calls = [("call_1", conv, 0, "sum", '{"x":[]}', None) for conv in (1, 2, 3, None)] + [("call_2", conv, 2, "sum", '{"x":[]}', "call_1") for conv in (1, 2)]
    calls += [("call_3", 2, 4, "sum", '{"x":[]}', "call_9"), ("call_9", 1, 4, "sum", '{"x":[]}', None), ("late", 5, 7, "sum", '{"x":[]}', None)]
    results = [("call_1", 1, 1, "of 1"), ("call_1", 2, 1, "of 2"), ("call_1", None, 5, "of none"), ("call_2", 2, 3, "2 of 2"), ("call_2", 1, 1, "too early"), ("late", 5, 6, "before"), ("late", 5, None, "some time")]
    cs = spark.createDataFrame(calls, "call_id string, conv_id long, turn long, name string, arguments string, after string")
    rs = spark.createDataFrame(results, "call_id string, conv_id long, turn long, content string")
    got = chat.link(cs, rs, SCHEMAS).collect()
    answers = {(r["conv_id"], r["call_id"]): json.loads(r["message"])["result"] for r in got if r["error"] != "no open call"}
    assert answers == {(1, "call_1"): "of 1", (2, "call_1"): "of 2", (3, "call_1"): None, (None, "call_1"): "of none", (1, "call_2"): None,
                       (2, "call_2"): "2 of 2", (2, "call_3"): None, (1, "call_9"): None, (5, "late"): "some time"}
    assert sorted((r["conv_id"], r["result_turn"]) for r in got if r["error"] == "no open call") == [(1, 1), (5, 6)]
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in got if r["level"]} == {(1, "call_2"): 1, (2, "call_2"): 1}  # call_9 is of another conversation


def test_conversations_query(spark):
    rows = {(r["conv_id"], r["turn"]): r for r in table(spark, SF, "conversations").collect()}
    got = queries.op4_tool_call_linking(spark, SF).collect()
    calls = {k for k, r in rows.items() if r["role"] != "assistant"}
    lost = {k for k, r in rows.items() if r["role"] == "assistant" and (k[0], k[1] - 1) not in calls}
    assert {(r["conv_id"], r["turn"]) for r in got} == calls | lost and len(got) == len(calls) + len(lost)
    for r in got:
        if r["error"] == "no open call":
            continue
        level, at = 0, r["turn"]
        while (r["conv_id"], at - 2) in calls:
            level, at = level + 1, at - 2
        answer = rows.get((r["conv_id"], r["turn"] + 1))
        answer = answer if answer and answer["role"] == "assistant" else None
        message = json.loads(r["message"])
        assert r["level"] == level and r["linked"] == (answer is not None) and message["arguments"]["text"] == rows[(r["conv_id"], r["turn"])]["text"]
        assert message["result"] == (answer["text"] if answer else None)


def test_long_chain_of_calls(spark):
    n = 700
    calls = spark.range(n).selectExpr("cast(id as string) AS call_id", "1L AS conv_id", "id AS turn", "'sum' AS name", "'{\"x\":[]}' AS arguments", "cast(id - 1 as string) AS after")
    assert sorted(tuple(r) for r in chat.levels(calls).selectExpr("cast(call_id as int)", "level").collect()) == [(i, i) for i in range(n)]
