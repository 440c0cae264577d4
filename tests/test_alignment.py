"""Alignment, limits and line numbering over real text files."""

import os

import pytest

from specweave.plans import jobs as J
from specweave.sources import text as TX

GOOD = "C 2 H 6 O 1HNMR 1.2 t 3 13CNMR 18.0 IR 0.1 0.2"
BAD = "C 1HNMR 1.2 IR 1"


def make_view(root, n_src, n_tgt, bad_line=None, splits=("train", "val", "test")):
    data = os.path.join(root, "view", "data")
    os.makedirs(data, exist_ok=True)
    for stem in splits:
        with open(os.path.join(data, f"src-{stem}.txt"), "w") as f:
            for i in range(1, (n_src if stem == "train" else 1) + 1):
                f.write((BAD if (stem == "train" and i == bad_line) else GOOD) + "\n")
        with open(os.path.join(data, f"tgt-{stem}.txt"), "w") as f:
            for i in range((n_tgt if stem == "train" else 1)):
                f.write("C C O\n")
    return os.path.join(root, "view")


# (src lines, tgt lines, N, bad line, expected molecules or error text)
CASES = [
    (3, 3, 0, None, 3),
    (3, 2, 0, None, "train source/target mismatch at line 3"),
    (3, 2, 2, None, "train source/target mismatch at line 3"),
    (5, 3, 2, None, 2),
    (3, 3, 2, 3, 2),
    (3, 2, 0, 2, "train line 2: missing marker 13CNMR"),
]


@pytest.mark.parametrize("n_src,n_tgt,limit,bad,expected", CASES)
def test_alignment_and_limit(spark, tmpdir_path, n_src, n_tgt, limit, bad, expected):
    view = make_view(tmpdir_path, n_src, n_tgt, bad)
    out = os.path.join(tmpdir_path, "out")
    if isinstance(expected, str):
        with pytest.raises(ValueError) as e:
            J.convert_hcir(spark, view, out, max_molecules=limit)
        assert str(e.value) == expected
    else:
        s = J.convert_hcir(spark, view, out, max_molecules=limit)
        assert s["splits"]["train"]["counts"]["molecules_written"] == expected
        assert os.path.exists(os.path.join(out, "summary.json"))


def test_line_numbers_independent_of_split_size(spark, tmpdir_path):
    """Metamorphic: tiny byte splits, several part files, CRLF -> same numbers."""
    d = os.path.join(tmpdir_path, "lines")
    os.makedirs(d)
    expected = []
    n = 0
    for part in range(3):
        with open(os.path.join(d, f"part-{part:05d}.txt"), "w", newline="") as f:
            for _ in range(50 + part * 7):
                n += 1
                text = f"line {n} " + "x" * (n % 13)
                expected.append((n, text))
                f.write(text + ("\r\n" if n % 3 == 0 else "\n"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r.line_number, r.value) for r in TX.read_lines(spark, d).collect())
            assert got == expected, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_missing_inputs_and_nonempty_output(spark, tmpdir_path):
    view = make_view(tmpdir_path, 2, 2)
    os.remove(os.path.join(view, "data", "tgt-val.txt"))
    with pytest.raises(FileNotFoundError, match="missing validation source/target files"):
        J.convert_hcir(spark, view, os.path.join(tmpdir_path, "o1"))
    view2 = make_view(os.path.join(tmpdir_path, "v2"), 2, 2)
    out = os.path.join(tmpdir_path, "o2")
    os.makedirs(out)
    J.convert_hcir(spark, view2, out)  # an existing empty directory is fine
    with pytest.raises(FileExistsError, match="output directory is not empty"):
        J.convert_hcir(spark, view2, out)
    with pytest.raises(ValueError):
        J.convert_hcir(spark, view2, os.path.join(tmpdir_path, "o3"), max_molecules=-1)


def test_paths_with_spaces_and_plus(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "a b+c")
    os.makedirs(os.path.join(d, "dir x"))
    open(os.path.join(d, "dir x", "p 1.txt"), "w").write("l1\nl2\nl3\n")
    open(os.path.join(d, "z+1.txt"), "w").write("m1\nm2\n")
    got = sorted(map(tuple, TX.read_line_groups(
        spark, {"a": os.path.join(d, "dir x"), "b": os.path.join(d, "z+1.txt")}).collect()))
    assert got == [("a", 1, "l1"), ("a", 2, "l2"), ("a", 3, "l3"), ("b", 1, "m1"), ("b", 2, "m2")]


def test_first_error_and_counts_independent_of_partitioning(spark, tmpdir_path):
    """Metamorphic: split size changes no count and no first error."""
    from specweave.sources import fixtures as FX
    from specweave.sources.text import write_text_view
    from conftest import SF001

    good = os.path.join(tmpdir_path, "good")
    bad = os.path.join(tmpdir_path, "bad")
    write_text_view(FX.hcir_lines(spark, SF001), good, parts=3)
    write_text_view(FX.hcir_lines(spark, SF001, bad=True), bad, parts=5)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    results = []
    try:
        for size in ("2048", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            s = J.convert_hcir(spark, good, os.path.join(tmpdir_path, f"o-{size}"), expected_ir_length=64)
            with pytest.raises(ValueError) as e:
                J.convert_hcir(spark, bad, os.path.join(tmpdir_path, f"b-{size}"), expected_ir_length=64)
            results.append(({k: v["counts"] for k, v in s["splits"].items()}, str(e.value)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert results[0] == results[1]
    assert results[0][1] == "train line 33: missing marker 13CNMR"


def test_target_longer_than_source(spark, tmpdir_path):
    """Tail mismatch in either direction."""
    view = make_view(tmpdir_path, 2, 4)
    with pytest.raises(ValueError) as e:
        J.convert_hcir(spark, view, os.path.join(tmpdir_path, "o1"))
    assert str(e.value) == "train source/target mismatch at line 3"
    view2 = make_view(os.path.join(tmpdir_path, "v2"), 4, 2)
    with pytest.raises(ValueError) as e:
        J.convert_hcir(spark, view2, os.path.join(tmpdir_path, "o2"))
    assert str(e.value) == "train source/target mismatch at line 3"
    s = J.convert_hcir(spark, make_view(os.path.join(tmpdir_path, "v3"), 5, 3), os.path.join(tmpdir_path, "o3"),
                       max_molecules=2)
    assert s["splits"]["train"]["counts"]["molecules_written"] == 2
    got = sorted(map(tuple, TX.read_aligned(spark, view).collect()))
    assert [(r[1], r[2] is None, r[3] is None) for r in got if r[0] == "train"] == \
        [(1, False, False), (2, False, False), (3, True, False), (4, True, False)]


def test_part_files_in_numeric_order(spark, tmpdir_path):
    """``part-100000`` follows ``part-99999`` for text and for Parquet."""
    import shutil

    from specweave.sources import parquet as PQ

    texts, tables = os.path.join(tmpdir_path, "texts"), os.path.join(tmpdir_path, "tables")
    os.makedirs(texts)
    os.makedirs(tables)
    for number, rows in ((99999, [1, 2]), (100000, [3, 4])):
        with open(os.path.join(texts, f"part-{number:05d}-x.txt"), "w") as f:
            f.write("".join(f"l{i}\n" for i in rows))
        one = os.path.join(tmpdir_path, str(number))
        spark.createDataFrame([(i,) for i in rows], "x int").coalesce(1).write.parquet(one)
        name = next(n for n in os.listdir(one) if n.startswith("part-"))
        shutil.copy(os.path.join(one, name), os.path.join(tables, f"part-{number:05d}-y.parquet"))
    assert sorted((r.line_number, r.value) for r in TX.read_lines(spark, texts).collect()) == [(i, f"l{i}") for i in (1, 2, 3, 4)]
    assert [r.x for r in PQ.first_rows(spark, tables, 2).collect()] == [1, 2]
    assert sorted((r.position, r.x) for r in PQ.rows_in_file_order(spark, tables).collect()) == [(i, i) for i in (1, 2, 3, 4)]


def test_conversion_plan_has_one_exchange_of_lines(spark, tmpdir_path):
    view = make_view(tmpdir_path, 30, 30)
    plan = J.hcir_parsed(spark, view)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 2 and plan.count("Exchange shufflepartitionid") == 1
    assert plan.count("Exchange") == plan.count("BroadcastExchange") + 1 and "Join" not in plan.replace("BroadcastHashJoin", "")
