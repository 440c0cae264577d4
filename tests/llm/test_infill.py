"""Fill-in-the-middle against a character-wise version, and odd rows."""

import hashlib
import re

import numpy as np
import pytest

from specweave.llm import infill, queries
from specweave.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = ["", "\n", "a", "a\n", "\na", "é\n𝄞x\n中文", "\n\n\n", "a <P> b\nc", "<S>", "x<M>y\nz", "no newline é" * 3000, "é𝄞\n" * 40_000, "tab\t\r\nline\x00\n", "<P", "P>\n<"]


def brute(doc_id, text, units):
    text = text or ""
    found = re.findall(r"[^\n]*\n|[^\n]+", text) if units == "lines" else list(text)
    n = len(found)
    h = [int(x, 16) for x in re.findall("." * 8, hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest())[:4]]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 50:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_documents(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD * 4)] + [(None, "a\nb\nc", 2), (None, None, 2), (3, "same\ntext\n", 1), (3, "same\ntext\n", 1), (-5, "x\ny", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int")


@pytest.mark.parametrize("units", infill.UNITS)
def test_samples_equal_the_character_wise_version(spark, units):
    docs = odd_documents(spark).unionByName(table(spark, SF, "documents").selectExpr("doc_id", "text", "1 AS n"))
    want = sorted((brute(r["doc_id"], r["text"], units) for r in docs.collect()), key=repr)
    got = infill.samples(docs, units)
    again = got.select("doc_id", infill.restore(got["output"], got["form"]).alias("text"))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sorted((r["doc_id"], r["text"]) for r in again.where("doc_id IS NOT NULL").collect()) == sorted(
        (r["doc_id"], r["text"] or "") for r in docs.where("doc_id IS NOT NULL").collect())


def test_query_restores_every_text(spark):
    got = {r["doc_id"]: r for r in queries.op12_fill_in_middle(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d["doc_id"]]["restored_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    assert {r["form"] for r in got.values()} >= {"psm", "spm"}


def test_rates_units_and_empty_tables(spark):
    docs = table(spark, SF, "documents")
    assert {r["form"] for r in infill.samples(docs, rate=0).select("form").distinct().collect()} == {"plain"}
    assert {r["form"] for r in infill.samples(docs, spm_rate=0).select("form").distinct().collect()} <= {"plain", "psm"}
    assert infill.samples(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.samples(docs, "words")


def test_index_converts_both_ways():
    text = "aé中𝄞z" * 7 + "plain"
    index = infill.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    cuts = np.arange(len(text) + 1)
    byte = np.array([len(text[:c].encode()) for c in cuts])
    assert (index.bytes(cuts) == byte).all() and (index.chars(byte) == cuts).all()
    assert len(index.at) == 3 * 7
