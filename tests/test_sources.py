"""Sources and sinks: numbering, hashing, summaries, staging, on-disk order."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from specweave.operators.numbering import number_rows
from specweave.sources import files as FL
from specweave.sources import parquet as PQ
from specweave.sources import summary as SM


def test_number_rows_exact_with_small_buckets(spark):
    rows = [("a" if i % 5 else "b", i * 3 + (i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long")
    exp = {}
    for g in ("a", "b"):
        for n, k in enumerate(sorted(k for gg, k in rows if gg == g), start=1):
            exp[(g, k)] = n
    for width in (1 << 20, 7, 50):
        got = {(r.g, r.k): r.n for r in number_rows(df, ["g"], "k", "n", bucket_width=width).collect()}
        assert got == exp, width
    got = {(r.g, r.k): r.n for r in number_rows(df, ["g"], "k", "n", bucket_width=7, materialize=True).collect()}
    assert got == exp


def test_sha256_matches_hashlib(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "manifest.json")
    data = json.dumps({"x": list(range(100))}).encode()
    open(p, "wb").write(data)
    assert FL.file_sha256(spark, p).first().sha256 == hashlib.sha256(data).hexdigest()
    df = spark.createDataFrame([("héllo",)], "t string")
    assert FL.sha256_text(df, "t").first().sha256 == hashlib.sha256("héllo".encode()).hexdigest()


def test_summary_and_ready_roundtrip(spark, tmpdir_path):
    s = {"b": 1, "a": {"z": 2, "y": [1, 2]}, "splits": {"train": {"counts": {"molecules_written": 3},
                                                              "ir_lengths": {"400": 3}, "elapsed_seconds": 0.5}}}
    SM.write_summary(spark, tmpdir_path, s)
    text = open(os.path.join(tmpdir_path, "summary.json")).read()
    assert text == json.dumps(s, indent=2, sort_keys=True) + "\n"
    row = SM.split_summaries(spark, tmpdir_path).first()
    assert (row.split, row.counts["molecules_written"], row.ir_lengths["400"]) == ("train", 3, 3)
    assert SM.read_summary(spark, tmpdir_path).first().b == 1
    assert not SM.is_complete(spark, tmpdir_path)   # a summary without a finished write
    open(os.path.join(tmpdir_path, "_SUCCESS"), "w").close()
    assert SM.is_complete(spark, tmpdir_path)
    assert not SM.is_ready(spark, tmpdir_path)
    SM.write_ready(spark, tmpdir_path, {"train": 3, "test": 1})
    assert SM.is_ready(spark, tmpdir_path)
    assert {r.split: r.rows for r in SM.read_ready(spark, tmpdir_path).collect()} == {"train": 3, "test": 1}


def test_incomplete_output_is_refused(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "o")
    os.makedirs(out)
    assert SM.check_resumable(spark, out)          # empty -> run
    open(os.path.join(out, "part"), "w").write("x")
    import pytest
    with pytest.raises(FileExistsError):
        SM.check_resumable(spark, out)             # data without summary


def test_first_rows_and_staged_union(spark, tmpdir_path):
    df = spark.range(0, 1000).select(F.col("id").alias("line_number"), (F.col("id") * 2).alias("v"))
    d = os.path.join(tmpdir_path, "t")
    df.repartitionByRange(7, "line_number").sortWithinPartitions("line_number").write.parquet(d)
    got = [r.line_number for r in PQ.first_rows(spark, d, 333).collect()]
    assert sorted(got) == list(range(333))
    pos = PQ.rows_in_file_order(spark, d).select("position", "line_number").collect()
    assert all(r.position == r.line_number + 1 for r in pos)
    e = os.path.join(tmpdir_path, "eval")
    FL.stage_dataset(spark, e, {"train": d, "test": d})
    u = FL.read_staged(spark, e)
    assert {r.split: r["count"] for r in u.groupBy("split").count().collect()} == {"train": 1000, "test": 1000}
