"""End-to-end jobs on the sf0.001 fixtures, against FIXTURES.md golden numbers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from specweave.plans import jobs as J
from specweave.plans import views as V
from specweave.sources import fixtures as FX
from specweave.sources import parquet as PQ
from specweave.sources import summary as SM
from specweave.sources.text import write_text_view
from conftest import SF001


def test_hcir_convert_summary_and_schema(spark, tmpdir_path):
    view = os.path.join(tmpdir_path, "view")
    write_text_view(FX.hcir_lines(spark, SF001), view)
    out = os.path.join(tmpdir_path, "out")
    s = J.convert_hcir(spark, view, out, expected_ir_length=64)
    counts = {k: v["counts"] for k, v in s["splits"].items()}
    assert counts == {"train": {"molecules_written": 400, "multiplets_written": 800},
                      "validation": {"molecules_written": 50, "multiplets_written": 100},
                      "test": {"molecules_written": 50, "multiplets_written": 100}}
    assert s["splits"]["train"]["ir_lengths"] == {"64": 400}
    on_disk = json.load(open(os.path.join(out, "summary.json")))
    assert on_disk["schema"] == ["molecular_formula", "h_nmr_text", "ir_spectra", "smiles"]
    df = spark.read.parquet(os.path.join(out, "split=train"))
    assert df.schema == PQ.HCIR_SCHEMA
    # on-disk order is line order
    pos = PQ.rows_in_file_order(spark, os.path.join(out, "split=test")).orderBy("position").collect()
    exp = FX.hcir_lines(spark, SF001).where("split = 'test'").orderBy("line_number").collect()
    assert [r.smiles for r in pos] == ["".join(e.target.split()) for e in exp]
    # staging: first 32 test rows, READY marker, gate
    eval_dir = os.path.join(tmpdir_path, "eval")
    staged = J.stage_hcir(spark, view, out, eval_dir, {"train": 400, "validation": 50, "test": 50},
                          eval_rows=32, expected_ir_length=64)
    assert staged == {"train": 400, "validation": 50, "test": 32}
    assert SM.is_ready(spark, eval_dir)
    assert {r.split: r.rows for r in SM.read_ready(spark, eval_dir).collect()} == staged


def test_hcir_bad_view_fails_fast(spark, tmpdir_path):
    view = os.path.join(tmpdir_path, "view")
    write_text_view(FX.hcir_lines(spark, SF001, bad=True), view)
    with pytest.raises(ValueError, match=r"^train line 33: missing marker 13CNMR$"):
        J.convert_hcir(spark, view, os.path.join(tmpdir_path, "out"), expected_ir_length=64)


def test_msms_golden_counts(spark):
    m = V.msms(spark, SF001)
    got = {r.rule: r.n for r in m.groupBy(F.col("error.rule").alias("rule")).agg(F.count("*").alias("n")).collect()}
    assert got["C17"] == 27
    assert got[None] == 541
    assert got["C15"] == 9
    msgs = {r.message: r.n for r in m.groupBy(F.col("error.message").alias("message")).agg(F.count("*").alias("n")).collect()}
    assert msgs["missing marker E10Pos"] == 392
    assert msgs["missing marker E20Pos"] == 285
    assert msgs["missing marker E40Pos"] == 218
    assert [msgs[f"{e} has no positive-intensity peaks"] for e in ("E10Pos", "E20Pos", "E40Pos")] == [8, 8, 12]
    v = m.where(F.col("error").isNull()).agg(F.sum("zero_peaks").alias("z"), F.count_if("formula_mismatch").alias("f")).first()
    assert (v.z, v.f) == (114, 7)


def test_msms_convert_and_fail_fast(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "payload")
    view = os.path.join(root, "opennmt", "VIEW")
    write_text_view(V.msms_valid_lines(spark, SF001), view)
    with open(os.path.join(root, "manifest.json"), "w") as f:
        f.write("{}")
    out = os.path.join(tmpdir_path, "out")
    counts = {r.split: r["count"] for r in V.msms_valid_lines(spark, SF001).groupBy("split").count().collect()}
    s = J.convert_msms(spark, view, out, FX.molecule_ref(spark, SF001), expected=counts)
    c = [v["counts"] for v in s["splits"].values()]
    assert [sum(x.get(k, 0) for x in c) for k in ("molecules_written", "spectra_written", "formula_mismatches")] == [541, 1623, 7]
    assert sum(len(v["formula_mismatch_examples"]) for v in s["splits"].values()) == 7
    assert s["total_spectra"] == 1623
    import hashlib
    assert s["source_manifest_sha256"] == hashlib.sha256(b"{}").hexdigest()
    assert spark.read.parquet(os.path.join(out, "split=train")).schema == PQ.MSMS_SCHEMA
    n = counts["train"]
    with pytest.raises(ValueError, match=f"train count mismatch: expected {n - 1}, wrote {n}"):
        J.convert_msms(spark, view, os.path.join(tmpdir_path, "o2"), FX.molecule_ref(spark, SF001),
                       expected={"train": n - 1})
    assert os.listdir(os.path.join(tmpdir_path, "o2")) == []   # nothing half-written stays
    # raw view with all lines: first bad line is 1 (C1 E40Pos) at sf0.001
    raw_root = os.path.join(tmpdir_path, "raw")
    raw_view = os.path.join(raw_root, "opennmt", "VIEW")
    lines = FX.msms_lines(spark, SF001).where("source is not null")
    from specweave.operators.numbering import number_rows
    lines = number_rows(lines.withColumnRenamed("line_number", "o"), ["split"], "o")
    write_text_view(lines, raw_view)
    with open(os.path.join(raw_root, "manifest.json"), "w") as f:
        f.write("{}")
    with pytest.raises(ValueError, match=r"^train line 1: missing marker E40Pos$"):
        J.convert_msms(spark, raw_view, os.path.join(tmpdir_path, "o3"), FX.molecule_ref(spark, SF001))


def test_msms_staging_and_gate(spark, tmpdir_path):
    from specweave.streaming.gate import NotReady, ready_gate

    three = V.msms_valid_lines(spark, SF001)
    counts = {r.split: r["count"] for r in three.groupBy("split").count().collect()}
    root = os.path.join(tmpdir_path, "payload")
    view = os.path.join(root, "opennmt", "VIEW")
    write_text_view(three, view)
    with open(os.path.join(root, "manifest.json"), "w") as f:
        f.write("{}")
    full = os.path.join(tmpdir_path, "full")
    ref = FX.molecule_ref(spark, SF001)
    J.convert_msms(spark, view, full, ref, expected=counts)
    eval_dir = os.path.join(tmpdir_path, "eval")
    expected = {s: (n, 3 * n) for s, n in counts.items()}
    with pytest.raises(J.VerificationError):   # 7 formula mismatches are not tolerated
        J.stage_msms(spark, view, full, eval_dir, ref, expected, eval_rows=100)
    with pytest.raises(NotReady):
        ready_gate(spark, eval_dir)
    # first 100 rows of the test split = 33 whole molecules + E10Pos of the 34th
    sub = PQ.first_rows(spark, os.path.join(full, "split=test"), 100).collect()
    assert len(sub) == 100
    assert [len(r.spectrum) > 0 for r in sub] == [True] * 100


def test_stage_hcir_skips_complete_conversion(spark, tmpdir_path):
    view = os.path.join(tmpdir_path, "view")
    write_text_view(FX.hcir_lines(spark, SF001), view)
    full = os.path.join(tmpdir_path, "full")
    J.convert_hcir(spark, view, full, expected_ir_length=64)
    mtime = os.path.getmtime(os.path.join(full, "summary.json"))
    J.stage_hcir(spark, view, full, os.path.join(tmpdir_path, "eval"), {"train": 400, "validation": 50, "test": 50},
                 eval_rows=16, expected_ir_length=64)
    assert os.path.getmtime(os.path.join(full, "summary.json")) == mtime   # not converted again
    with pytest.raises(J.VerificationError):
        J.stage_hcir(spark, view, full, os.path.join(tmpdir_path, "eval2"), {"train": 401, "validation": 50, "test": 50},
                     eval_rows=16, expected_ir_length=64)


def test_msms_staging_succeeds_and_resumes(spark, tmpdir_path):
    from specweave.plans import queries as Q
    from specweave.sources import files as FL

    eval_dir = Q._msms_staged(spark, SF001)
    assert FL.read_staged(spark, eval_dir, PQ.MSMS_SCHEMA).where("split = 'test'").count() == Q.STAGED_EVAL_ROWS
    members = FL.staged_members(spark, eval_dir)
    full = os.path.dirname(members["train"])
    os.remove(os.path.join(full, "_SUCCESS"))
    assert not SM.is_complete(spark, full)
    with pytest.raises(FileExistsError, match="incomplete non-empty"):
        SM.check_resumable(spark, full)
    open(os.path.join(full, "_SUCCESS"), "w").close()
    # a cut-off evaluation write is done again
    test_dir = members["test"]
    os.remove(os.path.join(test_dir, "_SUCCESS"))
    J._stage_eval(spark, full, eval_dir, {s: spark.read.parquet(members[s]).count() for s in ("train", "validation")}, 7)
    assert spark.read.parquet(test_dir).count() == 7


def test_empty_split_is_published(spark, tmpdir_path):
    view = os.path.join(tmpdir_path, "view")
    write_text_view(FX.hcir_lines(spark, SF001).where("split <> 'validation'"), view)
    out, eval_dir = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "eval")
    staged = J.stage_hcir(spark, view, out, eval_dir, {"train": 400, "validation": 0, "test": 50}, eval_rows=32, expected_ir_length=64)
    assert staged == {"train": 400, "validation": 0, "test": 32}
    assert spark.read.parquet(os.path.join(out, "split=validation")).schema == PQ.HCIR_SCHEMA


def test_quarantine(spark, tmpdir_path):
    view = os.path.join(tmpdir_path, "view")
    write_text_view(FX.hcir_lines(spark, SF001, bad=True), view)
    out, rejects = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "rejects")
    s = J.convert_hcir(spark, view, out, expected_ir_length=64, on_error="quarantine", rejects=rejects)
    bad = spark.read.parquet(rejects)
    assert bad.count() + sum(v["counts"]["molecules_written"] for v in s["splits"].values()) == 500
    assert bad.where("split = 'train' AND line_number = 33").first().error == "missing marker 13CNMR"
    with pytest.raises(ValueError):
        J.convert_hcir(spark, view, os.path.join(tmpdir_path, "o2"), on_error="quarantine")


def test_invalid_utf8_fails(spark, tmpdir_path):
    data = os.path.join(tmpdir_path, "view", "data")
    os.makedirs(data)
    line = b"C 2 H 6 O 1HNMR 1.2 t 3 13CNMR 18.0 IR 0.1 0.2\n"
    for stem in ("train", "val", "test"):
        open(os.path.join(data, f"src-{stem}.txt"), "wb").write(line + (b"C\xff" + line if stem == "val" else line))
        open(os.path.join(data, f"tgt-{stem}.txt"), "wb").write(b"C C O\nC C O\n")
    with pytest.raises(ValueError, match="^validation line 2: not valid UTF-8$"):
        J.convert_hcir(spark, os.path.join(tmpdir_path, "view"), os.path.join(tmpdir_path, "out"))


@pytest.mark.parametrize("fault", ["twice", "null formula", "null smiles", "bits"])
def test_reference_table_contract(spark, fault):
    from specweave.operators.enrich import ReferenceTableError, check_reference

    bits = [0] * 128
    rows = [("CO", "CO", bits, "C1"), ("CN", "CN", bits, "C1")]
    rows.append({"twice": ("CO", "CO", bits, "C1"), "null formula": ("CP", "CP", bits, None),
                 "null smiles": (None, "x", bits, "C1"), "bits": ("CP", "CP", bits[:5], "C1")}[fault])
    schema = "smiles string, canonical_smiles string, fingerprint array<tinyint>, formula string"
    check_reference(spark.createDataFrame(rows[:2], schema))
    with pytest.raises(ReferenceTableError):
        check_reference(spark.createDataFrame(rows, schema))


def test_hot_molecule_in_a_sorted_join(spark):
    """A third of all lines carry one SMILES; the join keeps every line."""
    from specweave.operators.enrich import enrich_molecules
    from specweave.operators import rules as R

    ref = FX.molecule_ref(spark, SF001)
    hot = ref.orderBy("smiles").first()["smiles"]
    lines = V.msms_valid_lines(spark, SF001)
    lines = lines.withColumn("target", F.when(F.col("line_number") % 3 == 0, F.lit(hot)).otherwise(F.col("target")))
    d = enrich_molecules(R.parse_msms(lines), ref.hint("merge"))
    assert d.where("error IS NULL").count() == lines.count() and d.where(F.col("smiles") == hot).count() >= lines.count() // 4


def test_stored_reference_is_not_exchanged(spark, tmpdir_path):
    """Bucketed by SMILES: one exchange (of the lines); a hot SMILES by broadcast;
    the same conversion."""
    from specweave.operators import enrich as EN

    ref, path = FX.molecule_ref(spark, SF001), os.path.join(tmpdir_path, "ref")
    EN.store_reference(ref, path, 6)
    assert EN.stored_buckets(spark, path) == 6 and EN.open_reference(spark, path).count() == ref.count()
    with pytest.raises(FileExistsError):
        EN.store_reference(ref, path, 6)
    lines = V.msms_valid_lines(spark, SF001).select("split", "line_number", F.regexp_replace("target", " ", "").alias("key"))
    plan = EN.attach_reference(lines, EN.open_reference(spark, path).hint("merge"), "key")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert "hashpartitioning(smiles" not in plan.replace("_ref_smiles", "smiles") and plan.count("Exchange hashpartitioning(key") == 1
    hot = ref.orderBy("smiles").first()["smiles"]
    many = lines.withColumn("key", F.when(F.col("line_number") % 3 == 0, F.lit(hot)).when(F.col("line_number") % 50 == 1, F.lit(None)).otherwise(F.col("key")))
    got = EN.attach_stored_reference(many, path, "key", many.count())
    assert [r.smiles for r in EN.hot_smiles(many, "key", 1 / 24, many.count()).collect()] == [hot]
    want = EN.attach_reference(many, ref, "key")
    columns = ["split", "line_number", "key", "_canonical", "ref_formula", "_known"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)
    root = os.path.join(tmpdir_path, "payload")
    view = os.path.join(root, "opennmt", "VIEW")
    write_text_view(V.msms_valid_lines(spark, SF001), view)
    open(os.path.join(root, "manifest.json"), "w").write("{}")
    s = J.convert_msms(spark, view, os.path.join(tmpdir_path, "out"), path)
    assert s["total_spectra"] == 1623 and sum(v["counts"].get("formula_mismatches", 0) for v in s["splits"].values()) == 7


def test_throughput():
    assert J.throughput(10, 2.0) == 5.0 and J.throughput(3, 0.0) == 3e9
