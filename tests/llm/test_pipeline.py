"""The pipeline against a brute-force version, and its stages on odd rows."""

import zlib

import corpus_pipeline as pipeline
import numpy as np
from tokenizers import Tokenizer

from specweave.llm import decontaminate, langid, pii, queries, simhash
from specweave.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_groups(rows):
    fps = simhash.fingerprint_texts([r["text"] for r in rows])
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.DISTANCE
    label = np.arange(len(rows))
    while True:
        new = np.where(near, label[None, :], len(rows)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    labeller = langid.Labeller(langid.train_on_documents(docs))
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    pred, score, _ = labeller.label([r["text"] for r in rows])
    rows = [r for r, p, s in zip(rows, pred, score, strict=True) if p != "und" and s >= pipeline.MIN_LANGUAGE_SCORE]
    label = brute_groups(rows)
    rows = [r for i, r in enumerate(rows) if label[i] == i]  # rows are in order of doc_id
    index = decontaminate.Items(items)
    rows = [r for r in rows if not index.matches(r["text"])]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = set()
    for r in rows:
        ids = [*tokenizer.encode(pii.mask(r["text"], pii.find_spans(r["text"])), add_special_tokens=False).ids, 2]
        want |= {(r["doc_id"], at, zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes())) for at in range(0, len(ids), 4096)}
    got = pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)


def odd_documents(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in table(spark, SF, "documents").limit(80).collect()]
    rows += [rows[3], rows[3], (None, None, None, None, None), (None, "the and of that with this", None, None, 25), (5000, "", "en", "s", 0), (5001, "1234 ... 99", "en", "s", 11), (5002, "the of and " * 30_000, None, "s", None)]
    return spark.createDataFrame(rows, table(spark, SF, "documents").schema)


def test_stages_on_odd_rows(spark):
    docs, kept = odd_documents(spark), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == COLUMNS and out.dtypes == docs.dtypes
            docs = spark.createDataFrame(out.collect(), docs.schema)
            kept[name] = docs.collect()
        else:
            assert out.count() >= len(kept["pii"])
    first = kept["language_id"]
    assert not {5000, 5001} & {r["doc_id"] for r in first} and all(r["text"] for r in first)
    assert {r["lang"] for r in first if r["doc_id"] == 5002} == {"en"}
    ids = [r["doc_id"] for r in kept["simhash_near_duplicates"]]
    assert len(ids) == len(set(ids)) and {None, 5002} <= set(ids)
    assert all(not pii.find_spans(r["text"]) and len(r["text"]) == r["n_chars"] for r in kept["pii"] if "<EMAIL>" in r["text"])


def test_stages_on_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
