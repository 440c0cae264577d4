"""Corpus pipeline: the stages that turn raw documents into training sequences.

Each stage reads what its predecessor kept (Parquet) and calls one operator of
``specweave.llm``. All but the last return the columns of documents.

  language ID        documents without a recognised language go, and those whose
                     leading language has under MIN_LANGUAGE_SCORE of their
                     letters; a missing ``lang`` is filled in
  near duplicates    one document of each SimHash group stays (smallest doc_id)
  decontamination    documents that hold a benchmark item, edited or not, go
  PII                personal data is replaced by placeholders, ``n_chars`` follows
  packing            token pieces of sequences of 4096
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm import decontaminate, langid, packing, pii, simhash
from specweave.llm.common import like, table
from specweave.llm.queries import tokenizer_path
from specweave.session import scratch_path
from specweave.sources import fs

#: Least share of a document's letters in its leading language.
MIN_LANGUAGE_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.train_on_documents(docs), spans=False)
    kept = found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return like(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Viterbi labels, fingerprints and tokens are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the
    shared folder and read back, and removed once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if before:  # its successor is written
            fs.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
