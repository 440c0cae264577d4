"""The line index: only files that hold the wanted lines are read, changed files
are counted again, and conversions stop at a failing line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from specweave.operators import metrics as M
from specweave.plans import jobs as J
from specweave.plans import views as V
from specweave.sources import fixtures as FX
from specweave.sources import parquet as PQ
from specweave.sources import summary as SM
from specweave.sources import text as TX
from specweave.sources.line_index import LineIndex, text_files
from specweave.sources.text import write_text_view
from conftest import SF001

GOOD = "C 2 H 6 O 1HNMR 1.2 t 3 13CNMR 18.0 IR 0.1 0.2"
BAD = "C 1HNMR 1.2 IR 1"


def parts_view(root, files, per_file, bad=(), tgt_per_file=None):
    """A view of part files; ``bad`` lists (stem, line)."""
    view = os.path.join(root, "view")
    for stem in ("train", "val", "test"):
        for side, size in (("src", per_file), ("tgt", tgt_per_file or per_file)):
            d = os.path.join(view, "data", f"{side}-{stem}.txt")
            os.makedirs(d)
            line, part, total = 0, 0, files * per_file
            while line < total:
                with open(os.path.join(d, f"part-{part:05d}.txt"), "w") as f:
                    for _ in range(min(size, total - line)):
                        line += 1
                        f.write((BAD if (stem, line) in bad else GOOD) + "\n" if side == "src" else "C C O\n")
                part += 1
    return view


def read_files(df):
    """Text files of the scans (the chunk table is a Parquet file of the index)."""
    return sorted({os.path.relpath(p, os.path.dirname(os.path.dirname(p))) for p in df.inputFiles() if p.endswith(".txt")})


def test_first_lines_read_only_their_files(spark, tmpdir_path):
    view = parts_view(tmpdir_path, 6, 10, tgt_per_file=15)
    index = LineIndex.open(spark, os.path.join(tmpdir_path, "index"))
    df = TX.read_aligned(spark, view, max_molecules=12, index=index)  # lines up to 13
    assert read_files(df) == sorted(
        [f"src-{s}.txt/part-0000{i}.txt" for s in ("train", "val", "test") for i in (0, 1)] + [f"tgt-{s}.txt/part-00000.txt" for s in ("train", "val", "test")])
    assert df.groupBy("split").count().collect()[0]["count"] == 13
    # files beyond were not even counted
    assert {k[0].rsplit("/", 1)[-1] for k in index._lines} == {"part-00000.txt", "part-00001.txt"}


def test_a_range_of_lines_keeps_its_numbers(spark, tmpdir_path):
    view = parts_view(tmpdir_path, 5, 10, bad={("train", 34)})
    df = TX.read_aligned(spark, view, ranges={"train": (33, 41)})
    assert [(r.line_number, r.source) for r in df.orderBy("line_number").collect()] == [(i, BAD if i == 34 else GOOD) for i in range(33, 42)]
    assert read_files(df) == [f"src-train.txt/part-0000{i}.txt" for i in (3, 4)] + [f"tgt-train.txt/part-0000{i}.txt" for i in (3, 4)]
    tail = TX.read_aligned(spark, view, ranges={"test": (48, None)})
    assert sorted(r.line_number for r in tail.collect()) == [48, 49, 50]
    assert TX.read_aligned(spark, view, ranges={"test": (99, 120)}).count() == 0


def test_changed_files_are_counted_again_and_others_are_not(spark, tmpdir_path):
    view = parts_view(tmpdir_path, 3, 4)
    folder = os.path.join(tmpdir_path, "index")
    src = os.path.join(view, "data", "src-train.txt")
    index = LineIndex(spark, folder)
    assert index.count(text_files(spark, src)) == [4, 4, 4]
    with open(os.path.join(src, "part-00001.txt"), "a") as f:
        f.write(GOOD + "\n" + GOOD + "\n")
    again = LineIndex(spark, folder)  # another process: the entries come from the folder
    files = text_files(spark, src)
    assert [f.stamp in again._lines for f in files] == [True, False, True]
    assert again.count(files) == [4, 6, 4]
    # numbers follow, though the old chunk table is there
    lines = TX.read_line_groups(spark, {"train": src})
    assert lines.count() == 14 and lines.agg(F.max("line_number")).first()[0] == 14


def test_chunk_table_is_read_again_only_for_the_same_scan(spark, tmpdir_path):
    view = parts_view(tmpdir_path, 3, 4)
    index = LineIndex(spark, os.path.join(tmpdir_path, "index"))
    TX.read_aligned(spark, view, index=index)
    scans = os.path.join(tmpdir_path, "index", "scans")
    before = {d: os.path.getmtime(os.path.join(scans, d, "_SUCCESS")) for d in os.listdir(scans)}
    assert TX.read_aligned(spark, view, index=index).count() == 36
    assert {d: os.path.getmtime(os.path.join(scans, d, "_SUCCESS")) for d in os.listdir(scans)} == before and len(before) == 2
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        assert TX.read_aligned(spark, view, index=index).count() == 36
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(os.listdir(scans)) == 4


@pytest.mark.parametrize(("bad", "message"), [
    ({("train", 7), ("train", 95), ("val", 1)}, "train line 7: missing marker 13CNMR"),
    ({("train", 95), ("val", 1)}, "train line 95: missing marker 13CNMR"),
    ({("val", 3), ("test", 1)}, "validation line 3: missing marker 13CNMR"),
    ({("test", 100)}, "test line 100: missing marker 13CNMR"),
])
def test_conversion_stops_at_the_first_bad_line(spark, tmpdir_path, monkeypatch, bad, message):
    view = parts_view(tmpdir_path, 20, 5, bad)
    monkeypatch.setattr(J, "FIRST_WAVE_BYTES", 600)
    waves = []
    write = PQ.write_dataset
    monkeypatch.setattr(PQ, "write_dataset", lambda df, *a, **k: (waves.append(len(read_files(df))), write(df, *a, **k)))
    out = os.path.join(tmpdir_path, "out")
    index = os.path.join(tmpdir_path, "index")
    with pytest.raises(ValueError) as e:
        J.convert_hcir(spark, view, out, line_index=index)
    assert str(e.value) == message and os.listdir(out) == []
    if ("train", 7) in bad:
        assert sum(waves) <= 20  # of 120 files
        assert len(LineIndex.open(spark, index)._lines) <= 20
    else:
        assert len(waves) > 1


def test_waves_convert_like_one_pass(spark, tmpdir_path, monkeypatch):
    view = os.path.join(tmpdir_path, "view")
    write_text_view(FX.hcir_lines(spark, SF001), view, parts=7)
    one = J.convert_hcir(spark, view, os.path.join(tmpdir_path, "one"), expected_ir_length=64)
    monkeypatch.setattr(J, "FIRST_WAVE_BYTES", 4000)
    index = LineIndex.open(spark)
    assert len(list(TX.line_waves(spark, view, index, 4000))) > 2
    several = J.convert_hcir(spark, view, os.path.join(tmpdir_path, "several"), expected_ir_length=64)
    for s in one["splits"]:
        assert {k: v for k, v in one["splits"][s].items() if k != "elapsed_seconds"} == {k: v for k, v in several["splits"][s].items() if k != "elapsed_seconds"}
    for split, n in (("train", 400), ("test", 50)):
        a, b = [[r.smiles for r in PQ.rows_in_file_order(spark, os.path.join(tmpdir_path, d, f"split={split}")).orderBy("position").collect()] for d in ("one", "several")]
        assert a == b and len(a) == n
    bad = os.path.join(tmpdir_path, "bad")
    write_text_view(FX.hcir_lines(spark, SF001, bad=True), bad, parts=7)
    s = J.convert_hcir(spark, bad, os.path.join(tmpdir_path, "o"), expected_ir_length=64, on_error="quarantine", rejects=os.path.join(tmpdir_path, "rejects"))
    assert spark.read.parquet(os.path.join(tmpdir_path, "rejects")).count() + sum(v["counts"]["molecules_written"] for v in s["splits"].values()) == 500


def test_msms_counts_and_examples_in_waves(spark, tmpdir_path, monkeypatch):
    root = os.path.join(tmpdir_path, "payload")
    view = os.path.join(root, "opennmt", "VIEW")
    write_text_view(V.msms_valid_lines(spark, SF001), view, parts=5)
    open(os.path.join(root, "manifest.json"), "w").write("{}")
    ref = FX.molecule_ref(spark, SF001)
    want = [r.asDict() for r in M.mismatch_examples(J.msms_parsed(spark, view, ref), k=2).orderBy("split", "rank").collect()]
    monkeypatch.setattr(M, "EXAMPLES_PER_SPLIT", 2)
    for wave, stretches in ((1 << 30, 1 << 15), (20_000, 1 << 15), (20_000, 8)):
        monkeypatch.setattr(J, "FIRST_WAVE_BYTES", wave)
        monkeypatch.setattr(J, "STRETCHES", stretches)
        s = J.convert_msms(spark, view, os.path.join(tmpdir_path, f"o-{wave}-{stretches}"), ref)
        got = [dict(split=sp, **e) for sp in sorted(s["splits"]) for e in s["splits"][sp]["formula_mismatch_examples"][:2]]
        assert got == [{k: w[k] for k in ("split", "payload", "reference", "smiles")} for w in want]
        assert sum(v["counts"].get("formula_mismatches", 0) for v in s["splits"].values()) == 7
    train = s["splits"]["train"]["counts"]["molecules_written"]
    with pytest.raises(ValueError, match=f"train count mismatch: expected {train + 1}, wrote {train}"):
        J.convert_msms(spark, view, os.path.join(tmpdir_path, "o3"), ref, expected={"train": train + 1, "test": 10**6})


# --- manifest ---------------------------------------------------------------

def test_readers_take_only_the_files_of_the_manifest(spark, tmpdir_path):
    view, out = parts_view(tmpdir_path, 3, 4), os.path.join(tmpdir_path, "out")
    J.convert_hcir(spark, view, out)
    named = json.load(open(os.path.join(out, "_SUCCESS")))
    assert named["run"] == json.load(open(os.path.join(out, "summary.json")))["run"]
    assert all(os.path.exists(os.path.join(out, f)) for fs_ in named["files"].values() for f in fs_)
    stray = os.path.join(out, "split=train", "part-00099-of-another-run.zstd.parquet")
    import shutil
    shutil.copy(os.path.join(out, named["files"]["train"][0]), stray)
    train = os.path.join(out, "split=train")
    assert PQ.read_dataset(spark, out, PQ.HCIR_SCHEMA).where("split = 'train'").count() == 12
    assert PQ.read_path(spark, train).count() == PQ.count_rows(spark, train) == PQ.rows_in_file_order(spark, train).count() == 12
    assert PQ.first_rows(spark, train, 100).count() == 12
    assert {r.split: r.rows for r in PQ.row_counts(spark, out).collect()} == {"train": 12, "validation": 12, "test": 12}
    assert SM.is_complete(spark, out)
    named["run"] = "another"
    PQ.publish(spark, out, named["run"], named["files"])
    assert not SM.is_complete(spark, out)


def test_a_run_that_dies_publishes_nothing(spark, tmpdir_path, monkeypatch):
    """As if the process had been killed while the last split was prepared: nobody
    cleans up, yet no reader here and no later run takes what lies there."""
    view, out = parts_view(tmpdir_path, 3, 4), os.path.join(tmpdir_path, "out")

    class Killed(BaseException):
        pass

    def die(*a, **k):
        raise Killed

    monkeypatch.setattr(J._Run, "publish", die)
    monkeypatch.setattr(J._Run, "discard", lambda self: None)
    with pytest.raises(Killed):
        J.convert_hcir(spark, view, out)
    assert os.path.isdir(os.path.join(out, "split=train"))  # data files, but
    assert not os.path.exists(os.path.join(out, "_SUCCESS")) and not os.path.exists(os.path.join(out, "summary.json"))
    assert not SM.is_complete(spark, out)
    with pytest.raises(FileExistsError, match="incomplete non-empty"):
        SM.check_resumable(spark, out)


def test_no_data_file_is_renamed(spark, tmpdir_path, monkeypatch):
    from specweave.sources import fs

    view = parts_view(tmpdir_path, 2, 3)
    renamed = []
    monkeypatch.setattr(fs, "rename", lambda spark, a, b: renamed.append((a, b)))
    J.convert_hcir(spark, view, os.path.join(tmpdir_path, "out"))
    assert renamed == []


def test_counts_come_from_footers(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "out")
    J.convert_hcir(spark, parts_view(tmpdir_path, 2, 3), out)
    with PQ._footer_aggregates(spark):
        plan = PQ.footer_counts(PQ.read_path(spark, out), "split")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [split]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList").find("parquet") >= 0


def test_empty_view(spark, tmpdir_path):
    data = os.path.join(tmpdir_path, "view", "data")
    os.makedirs(data)
    for stem in ("train", "val", "test"):
        os.makedirs(os.path.join(data, f"src-{stem}.txt"))
        open(os.path.join(data, f"tgt-{stem}.txt"), "w").close()
    s = J.convert_hcir(spark, os.path.join(tmpdir_path, "view"), os.path.join(tmpdir_path, "out"))
    assert [v["counts"]["molecules_written"] or 0 for v in s["splits"].values()] == [0, 0, 0]
    assert PQ.read_dataset(spark, os.path.join(tmpdir_path, "out"), PQ.HCIR_SCHEMA).count() == 0
