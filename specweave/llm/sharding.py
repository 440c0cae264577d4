"""Sharding by weighted rendezvous hashing.

Every (key, shard) pair draws u in (0, 1) from XXH64; the shard with the highest
score -weight / ln(u) takes the key. Adding a shard adds one score and leaves
the others as they are, so a key either stays or moves to the new shard.
DataFrame functions only.

Slots: a shard's rows are ordered by 16 bits of a hash of key, size, checksum and
scan partition, then by these. Numbering first counts rows per (shard, bucket), at
most shards x 65,536 counts at any input size, and then numbers each bucket
by itself, so no task sees a whole shard, nor all rows of a hot key (all in one
shard, by the law, but in all its buckets). Rows with the same text as well are
counted before the shuffle (per scan partition) and expanded after numbering.

Null keys are one key ("null"). Null text has no bytes. Ties of equal rows
take neighbouring slots. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.common import need
from specweave.session import materialize

BUCKETS = 65_536
_DRAW_BITS = 52  # exact in a double


def _draw(key: Column, shard: int) -> Column:
    """52 pseudo-random bits of (key, shard) as a double."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 64 - _DRAW_BITS).cast("double")


def _score(key: Column, shard: int, weight: float) -> Column:
    u = (_draw(key, shard) + F.lit(0.5)) / F.lit(float(2**_DRAW_BITS))
    return F.lit(-float(weight)) / F.log(u)


def choose(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0 .. len(weights)-1 of ``key``; equal scores go to the lower."""
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("weights must be positive and finite")
    scores = [F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def shard_rows(docs: DataFrame, weights: Sequence[float], new_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``grown_shard`` is the shard after one more of ``new_weight`` is added.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    n = len(weights)
    scored = need(docs, ("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.struct(*[_score(key, i, w).alias(f"s{i}") for i, w in enumerate([*weights, new_weight])]).alias("s"),
        F.spark_partition_id().alias("part"),
    )
    pairs = [F.struct(F.col(f"s.s{i}").alias("score"), F.lit(-i).alias("shard")) for i in range(n)]
    best = F.greatest(*pairs) if n > 1 else pairs[0]
    placed = scored.withColumn("best", best).select(
        "doc_id", "size", "text_crc32",
        (-F.col("best.shard")).cast("int").alias("shard"),
        F.when(F.col(f"s.s{n}") > F.col("best.score"), F.lit(n)).otherwise(-F.col("best.shard")).cast("int").alias("grown_shard"),
        "part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "part"), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    counted = materialize(placed.groupBy("shard", "bucket", "doc_id", "size", "text_crc32", "grown_shard", "part").agg(F.count(F.lit(1)).alias("n")), "sharding")
    before = counted.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    over_buckets = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("shard", "bucket", F.coalesce(F.sum("rows").over(over_buckets), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32", "part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("first", F.coalesce(F.sum("n").over(in_bucket), F.lit(0))).join(before, ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "before", "first", "grown_shard",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"),
    ).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("first") + F.col("i")).alias("slot"), "grown_shard")

