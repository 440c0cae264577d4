"""Fixture views over the driver's synthetic tables (FIXTURES.md §3).

The molecules are made up and carry no chemical meaning.  Every view is a
Spark plan over the given Parquet tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_rows

HCIR_EXPECTED_IR_LENGTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hcir_parts(e: DataFrame) -> DataFrame:
    vid = F.col("vec_id")
    ir = F.array_join(
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000).cast("long").cast("string")), " "
    )
    h1 = (
        F.when(vid % 4 == 0, F.lit("1.2 t 3"))
        .when(vid % 4 == 1, F.lit("1.2 t 3 | 2.1 s 1"))
        .when(vid % 4 == 2, F.lit("1.2 t 3 | 2.1 s 1 | 7.3 m 5"))
        .otherwise(F.lit("0.9 d 6 |"))
    )
    formula = F.concat(F.lit("C "), (F.col("label") + 1).cast("string"), F.lit(" H "),
                       (vid % 9 + 1).cast("string"))
    split = F.when(vid % 10 < 8, F.lit("train")).when(vid % 10 == 8, F.lit("validation")).otherwise(F.lit("test"))
    return e.select(
        vid.alias("vec_id"),
        split.alias("split"),
        formula.alias("_f"),
        h1.alias("_h"),
        ir.alias("_ir"),
        F.concat(F.repeat(F.lit("C "), F.col("label") + 1), F.lit("O")).alias("_t"),
    )


def hcir_lines(spark: SparkSession, sf_dir: str, bad: bool = False) -> DataFrame:
    """``(split, line_number, source, target, vec_id)`` from ``embeddings``.

    ``bad=True`` injects one fault per ``k = vec_id % 49`` in 40..47
    (C1..C8 in that order).
    """
    p = _hcir_parts(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    f, h, ir = F.col("_f"), F.col("_h"), F.col("_ir")
    good = F.concat(f, F.lit(" 1HNMR "), h, F.lit(" 13CNMR 12 34 IR "), ir)
    source, target = good, F.col("_t")
    if bad:
        k = F.col("vec_id") % 49
        source = (
            F.when(k == 40, F.concat(f, F.lit(" 1HNMR "), h, F.lit(" 12 34 IR "), ir))
            .when(k == 41, F.concat(f, F.lit(" 1HNMR "), h, F.lit(" IR "), ir, F.lit(" 13CNMR 12 34")))
            .when(k == 42, F.concat(F.lit("1HNMR "), h, F.lit(" 13CNMR 12 34 IR "), ir))
            .when(k == 43, F.concat(f, F.lit(" 1HNMR 13CNMR 12 34 IR "), ir))
            .when(k == 44, F.concat(good, F.lit(" x")))
            .when(k == 45, F.concat(f, F.lit(" 1HNMR "), h, F.lit(" 13CNMR 12 34 IR")))
            .when(k == 46, F.concat(f, F.lit(" 1HNMR "), h, F.lit(" 13CNMR 12 34 IR 1 2 3")))
            .otherwise(good)
        )
        target = F.when(k == 47, F.lit("  ")).otherwise(F.col("_t"))
    lines = p.select("vec_id", "split", source.alias("source"), target.alias("target"))
    return number_rows(lines, ["split"], "vec_id").select("split", "line_number", "source", "target", "vec_id")


def _intensity(discount: Column) -> Column:
    return F.floor(discount * 100 + F.lit(0.5)).cast("long")


def msms_peak_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: the three peak sections as text (NULL when the flag is absent).

    The line items are dealt by order first: an order has few of them, far apart, so
    partial lists before the exchange would only be sorted and written twice.  One
    list per order holds all its peaks, with their texts.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_returnflag")
    sections = (("A", "E10Pos"), ("N", "E20Pos"), ("R", "E40Pos"))
    mz, it = F.col("l_partkey") + 1, _intensity(F.col("l_discount"))
    peak = F.struct(F.col("l_returnflag").alias("flag"), mz.alias("mz"), it.alias("it"),
                    F.concat(mz.cast("string"), F.lit(" "), it.cast("string")).alias("text"))
    peak = F.when(F.col("l_returnflag").isin([flag for flag, _ in sections]), peak)
    dealt = li.repartition("l_orderkey").select("l_orderkey", peak.alias("peak"))
    per_order = dealt.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("peak")).alias("peaks"))
    per_order = per_order.select(
        "l_orderkey", *[F.filter("peaks", lambda p: p["flag"] == F.lit(flag)).alias(marker) for flag, marker in sections])  # noqa: B023  called at once
    return per_order.select("l_orderkey", *[
        F.when(F.size(marker) > 0, F.concat(F.lit(marker + " "), F.array_join(F.col(marker)["text"], " "))).alias(marker)
        for _, marker in sections])


def _order_line(key: Column) -> tuple[Column, Column]:
    """(split, line number) of an order: of ten keys in a row eight are train
    lines, the ninth is a validation line, the tenth a test line."""
    ten, rest = F.floor(key / 10).cast("long"), key % 10
    split = F.when(rest < 8, F.lit("train")).when(rest == 8, F.lit("validation")).otherwise(F.lit("test"))
    return split, F.when(rest < 8, ten * 8 + rest + 1).otherwise(ten + 1)


def msms_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(split, line_number, source, target, o_orderkey)``; one line per order.

    ``source`` is NULL for an order without line items (an alignment gap).
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    secs = msms_peak_sections(spark, sf_dir)
    k = F.col("o_custkey") % 50 + 1
    n = k + F.when(F.col("o_orderkey") % 97 == 0, F.lit(1)).otherwise(F.lit(0))
    source = F.concat_ws(
        " ", F.lit("C"), n.cast("string"), F.lit("1HNMR 1.2 t 3 13CNMR 12"),
        F.col("E10Pos"), F.col("E20Pos"), F.col("E40Pos"), F.lit("IR 1 2"),
    )
    joined = o.join(secs, o["o_orderkey"] == secs["l_orderkey"], "left")
    split, line = _order_line(F.col("o_orderkey"))
    return joined.select(
        split.alias("split"),
        line.alias("line_number"),
        F.when(F.col("l_orderkey").isNotNull(), source).alias("source"),
        F.concat(F.repeat(F.lit("C "), k), F.col("o_orderstatus")).alias("target"),
        F.col("o_orderkey"),
    )


def msms_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(split, line_number, source, target)``; one line per order, two peaks
    per energy, one fault per ``o_orderkey % 20`` in 0..14: C9..C13 (div 3) in
    the first, second or third energy (mod 3)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    fault = F.col("o_orderkey") % 20
    low = F.col("o_custkey") % 50 + 10
    a, b = low.cast("string"), (low + 5).cast("string")
    good = F.concat(a, F.lit(" 5 "), b, F.lit(" 7"))
    faults = [
        F.concat(a, F.lit(" 5 "), b),                # C9: no pairs
        F.concat(a, F.lit(" x "), b, F.lit(" 7")),   # C10: not a number
        F.concat(a, F.lit(" nan "), b, F.lit(" 7")),  # C11: not finite
        F.concat(a, F.lit(" -5 "), b, F.lit(" 7")),  # C12: negative intensity
        F.concat(b, F.lit(" 5 "), a, F.lit(" 7")),   # C13: not sorted
    ]
    sections = []
    for e, marker in enumerate(("E10Pos", "E20Pos", "E40Pos")):
        text = good
        for rule, bad in enumerate(faults):
            text = F.when(fault == 3 * rule + e, bad).otherwise(text)
        sections += [F.lit(marker), text]
    split, line = _order_line(F.col("o_orderkey"))
    return o.select(
        split.alias("split"), line.alias("line_number"),
        F.concat_ws(" ", F.lit("C 1 1HNMR 1.2 t 3 13CNMR 12"), *sections, F.lit("IR 1 2")).alias("source"),
        F.concat(F.repeat(F.lit("C "), F.col("o_custkey") % 50 + 1), F.col("o_orderstatus")).alias("target"),
    )


def molecule_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic molecule reference ``(smiles, canonical_smiles, fingerprint, formula)``.

    Not chemistry: canonical form = input, formula = carbon count, and the
    128 fingerprint bits come from a fixed arithmetic rule.
    """
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    keys = o.select((F.col("o_custkey") % 50 + 1).alias("k"), F.col("o_orderstatus").alias("st")).where(
        F.col("k") != 50
    ).distinct()
    smiles = F.concat(F.repeat(F.lit("C"), F.col("k")), F.col("st"))
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(127)),
        lambda i: F.when(((F.col("k") * (i + 7) + F.ascii(F.col("st"))) % 3) == 0, F.lit(1))
        .otherwise(F.lit(0)).cast("tinyint"),
    )
    return keys.select(
        smiles.alias("smiles"),
        smiles.alias("canonical_smiles"),
        bits.alias("fingerprint"),
        F.concat(F.lit("C"), F.col("k").cast("string")).alias("formula"),
    )


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as metric samples: key ``user_id``, order ``event_id``."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")


def align_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(source side, target side): documents vs labels by ``doc_id``."""
    src = table(spark, sf_dir, "documents").select(
        F.lit("train").alias("split"), (F.col("doc_id") + 1).alias("line_number"), F.col("text").alias("source")
    )
    tgt = table(spark, sf_dir, "labels").select(
        F.lit("train").alias("split"), (F.col("doc_id") + 1).alias("line_number"),
        F.col("quality").cast("string").alias("target"),
    )
    return src, tgt
