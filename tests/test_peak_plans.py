"""The peak queries read and parse each line once."""

import re

from pyspark.sql import Row

from specweave.plans import queries as Q


def _tables(spark, tmp_path):
    orders = [Row(o_orderkey=k, o_custkey=7 * k, o_orderstatus="F") for k in range(12)]
    items = [Row(l_orderkey=k, l_partkey=p, l_discount=p % 3 / 100, l_returnflag=flag)
             for k in range(10) for p, flag in enumerate("ANRRNA" if k % 4 else "ANN", start=k)]
    spark.createDataFrame(orders).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items).write.parquet(f"{tmp_path}/lineitem.parquet")
    return items


def test_peaks_in_one_pass(spark, tmp_path):
    items = _tables(spark, tmp_path)
    for query, least in ((Q.q_peak_pairs, 0), (Q.q_positive_peaks, 1)):
        found = query(spark, str(tmp_path))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"l_partkey#\d+L?,.*parquet", plan)) == 1  # one scan of lineitem
        assert "Union" not in plan
        got = sorted((r["energy"], r["mz"], r["intensity"]) for r in found.collect())
        energy = {"A": "E10Pos", "N": "E20Pos", "R": "E40Pos"}
        want = sorted((energy[i.l_returnflag], i.l_partkey + 1, i.l_partkey % 3) for i in items
                      if i.l_orderkey % 4 and i.l_partkey % 3 >= least)
        assert got == want


def test_numbering_input_is_narrow(spark, tmp_path):
    from specweave.plans import views as V

    _tables(spark, tmp_path)
    assert V.msms_valid(spark, str(tmp_path), ["source"]).columns == ["split", "source_line", "source", "line_number"]


def _generators(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan, [line for line in plan.split("\n") if "Generate " in line]


def test_sections_take_one_list_per_order(spark, tmp_path):
    from specweave.sources import fixtures as FX

    spark.createDataFrame([(1, 7, "F"), (2, 8, "O"), (2, 9, "P"), (3, 7, "F"), (4, 7, "F")],
                          "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(1, 5, 0.02, "R"), (1, 20, 0.01, "A"), (1, 3, 0.0, "A"), (1, None, 0.03, "A"), (1, 3, None, "A"), (1, 3, 0.0, "A"),
             (2, None, 0.01, "N"), (2, 4, 0.05, "X"), (3, 4, 0.05, None), (None, 4, 0.05, "A")]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_discount double, l_returnflag string").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    lines = FX.msms_lines(spark, str(tmp_path))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1
    aggregate = plan.index("Aggregate [l_orderkey")
    assert "RepartitionByExpression [l_orderkey" in plan[aggregate:]  # dealt below the aggregate
    found = sorted((r["o_orderkey"], r["target"][-1], r["source"]) for r in lines.where("o_orderkey < 4").collect())
    head, tail = "1HNMR 1.2 t 3 13CNMR 12", "IR 1 2"
    assert found == [(1, "F", f"C 8 {head} E10Pos 4 0 4 0 21 1 E40Pos 6 2 {tail}"), (2, "O", f"C 9 {head} E20Pos  {tail}"),
                     (2, "P", f"C 10 {head} E20Pos  {tail}"), (3, "F", f"C 8 {head} {tail}")]
    assert lines.where("o_orderkey = 4").first()["source"] is None


def test_totals_parse_without_peak_lists(spark, tmp_path):
    _tables(spark, tmp_path)
    totals = Q.q_dataset_totals(spark, str(tmp_path))
    plan, generators = _generators(totals)
    assert "zero_peaks" not in plan and "peaks_E10Pos" not in plan
    assert generators and not any("lambda" in line for line in generators)  # such a generator is interpreted
    assert totals.first().asDict() == {"total_molecules": 4, "total_spectra": 12}


def test_energies_are_built_below_the_generator(spark, tmp_path):
    from specweave.operators.subsets import explode_energies
    from specweave.plans import views as V

    _tables(spark, tmp_path)
    spectra = explode_energies(V.msms(spark, str(tmp_path)).where("error IS NULL"))
    _, generators = _generators(spectra)
    assert generators and not any("lambda" in line for line in generators)


def test_lines_are_split_as_python_does(spark):
    from pyspark.sql import functions as F

    from specweave.functions import tokens as T

    texts = ["", " ", "a  b ", "a\tb c d", "a\x7fb c", " a\x1fb　", "é b", "a\nb\r\n c", "a​b c", "1_0 ~ !"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.tokens(F.col("t")).alias("k"))
    assert [r["k"] for r in got.orderBy("i").collect()] == [t.split() for t in texts]
