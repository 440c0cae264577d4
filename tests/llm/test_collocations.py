"""Phrase mining against brute force: collisions, chunk borders, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from specweave.llm import collocations as co
from specweave.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, least, longest, top):
    f, n = {}, Counter()
    for text, lang in rows:
        counts = f.setdefault(lang or "und", Counter())
        for p in pieces_of(text):
            n[lang or "und"] += len(p)
            counts.update(tuple(p[i:i + s]) for s in range(1, longest + 1) for i in range(len(p) - s + 1))
    out = set()
    for lang, counts in f.items():
        found = []
        often = [g for g, a in counts.items() if a >= least and len(g) > 1]
        for g in often:
            a = counts[g]
            if any(len(h) > len(g) and counts[h] >= a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h in often):
                continue
            score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def sentences(seed, n, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "ÉX", "née", "a b", "中文"]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choice(["New York City", "hot dog", "Of the", *words]) + rng.choice(["", "", "", ",", ". ", "\n", "\t"]) for _ in range(rng.randint(0, 30)))
        rows.append((text, rng.choice(langs)))
    return rows + [rows[0]] * 5 + [("x y z " * 40, "en"), (None, None), ("", "en"), (" \t .,", "fr")]


@pytest.mark.parametrize(("bits", "longest", "top"), [(64, 5, 2000), (6, 5, 2000), (64, 3, 7)])
def test_phrases_equal_brute_force_also_with_collisions(spark, bits, longest, top):
    rows = sentences(bits, 250)
    docs = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n long, phrase string").repartition(5)
    got = co.collocations(docs, least=4, longest=longest, top=top, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, longest, top)


def test_query_on_a_table_with_frequent_phrases(spark, tmp_path):
    rows = [(t, lang) for t, lang in sentences(9, 700)]
    spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows, co.LEAST, co.LONGEST, co.TOP)
    got = queries.op11_phrase_collocations(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    phrases = spark.createDataFrame([("en", "a", 1, 7 * big), ("en", "b", 1, 9 * big), ("en", "a b", 2, big)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    r = co.scored(phrases, totals).first()
    assert r["score"] == 1000 * big * 10**15 // (7 * big * 9 * big) and (r["l"], r["r"]) == (7 * big, 9 * big)


def test_empty_tables_and_no_phrases(spark):
    docs = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert co.collocations(docs).count() == 0
    assert co.collocations(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        co.collocations(docs, longest=6)


def test_chunks_cut_long_texts_without_losing_phrases(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(co, "CHUNK_WORDS", 50)
    monkeypatch.setattr(co, "PART_BYTES", 64)
    rng = random.Random(2)
    text = "".join(rng.choice("abc") + rng.choice("   ,") for _ in range(4000))
    texts = [(text, "en"), ("a b c", "de"), (text[:300], "en"), ("longword" * 100, "de")]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in texts]), pa.array([lang for _, lang in texts])], names=["text", "lang"])
    chunks = list(co._chunk_batches(iter([batch])))
    assert len(chunks) > 50 and max(len(c.column("codes")[0].as_py()) for c in chunks) < 4 * 150
    everything = co.BitFilter(np.full(1 << 13, 255, np.uint8), 48)
    got = Counter()
    for lang, _, c in co._each_chunk(iter(chunks), 64):
        for size in (2, 5):
            for phrase, n in c.spelled(size, {size: everything}):
                got[lang, phrase.decode()] += n
    want = Counter((lang, " ".join(p[i:i + s])) for t, lang in texts for p in pieces_of(t) for s in (2, 5) for i in range(len(p) - s + 1))
    assert got == want
    assert sum(c.column("n_words")[0].as_py() for c in chunks) == sum(len(p) for t, _ in texts for p in pieces_of(t))


def test_fingerprints_and_filter():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    h[::17] = 0
    grams = co.Fingerprints(h)
    for size in (1, 2, 5):
        fp, inside = grams.of(size)
        for i in range(len(fp)):
            assert int(fp[i]) == sum(int(h[i + k]) * pow(co.BASE, k, 1 << 64) for k in range(size)) % (1 << 64)
            assert inside[i] == (h[i:i + size] != 0).all()


def test_filter_keeps_every_key(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    found = co.bit_filter(spark.createDataFrame([(int(k),) for k in keys], "fp long"), len(keys))
    assert found.test(keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert found.test(others).mean() < 0.05 and len(found.bits) * 8 <= co.FILTER_BITS
