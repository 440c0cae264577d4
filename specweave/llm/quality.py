"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

The model counts character n-grams (ORDER UTF-16 code units, so any alphabet is
counted as it is; a character beyond 65,535 is two units; text in lower case, white
space runs as one space, padded before the first character and closed by an end
mark) of all trusted documents. Counts, contexts and discounts are Spark tables;
no table of the corpus goes to the driver or is broadcast.

1. Documents are dealt into blocks of about BLOCK_BYTES of text by a hash of
   their id and place in the input, so rows of one id or of none are spread like
   others; a block gets the trusted ones of its own ids. Each block reports its
   distinct n-grams with their count in trusted text.
2. Per order, from the highest down: counts (continuation counts below the
   highest order), counts of counts for the three discounts, and context totals;
   then probabilities of the n-grams that occur anywhere, joined on n-gram,
   context and suffix.
3. Sharded count join: (block, n-gram) meets the probabilities by n-gram and
   returns to its block, where the documents sum their logarithms. A block
   receives its own n-grams only, each once, however often they occur.
4. Fences are the QUANTILES of log-perplexity of trusted documents (a histogram
   with bins of 1 / BINS, so the same at any partitioning) of the same language
   and length class (n-grams by powers of two, as the mean of a short text
   scatters more). A class with under LEAST_TRUSTED trusted documents takes
   neighbouring classes in, the nearest first. A document stays between its fences.
   Languages with under LEAST_TRUSTED trusted documents use the fences of all.

Documents without words (null, empty) have no perplexity and do not stay.
The input is read more than once and must give its rows in the same partitions
and order each time, as files do; a row that comes back elsewhere is an error.
Unlabelled and repeated rows are scored like others; repeated or contradictory
labels count as trusted if one says so. Null language is a language of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import need, tidy_shuffles
from specweave.session import materialize

ORDER = 4
BITS = 16
PAD, END = 0, 1
BLOCK_BYTES = 24_000_000
BINS = 1000
QUANTILES = (0.005, 0.995)
LEAST_TRUSTED = 50


def _codes(texts: list[str], order: int) -> np.ndarray:
    joined = "".join(["\0" * (order - 1) + " ".join(t.replace("\0", " ").replace("\1", " ").lower().split()) + "\1" for t in texts])
    return np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.int64)


def ngrams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys of all texts in order, number of keys of each text).

    A key holds its code units in BITS bits each, the last lowest."""
    codes = _codes(texts, order)
    keys = np.zeros(max(0, len(codes) - order + 1), np.int64)
    for i in range(order):
        keys = (keys << BITS) | codes[i:len(keys) + i]
    last = codes[order - 1:]
    keys = keys[last != PAD]
    ends = np.cumsum(last[last != PAD] == END)
    return keys, np.bincount(ends - (last[last != PAD] == END), minlength=len(texts))


def _chunks(texts: list[str | None]):
    from specweave.llm.langid import chunks

    return chunks(texts)


def _count_block(key, docs, trusted):
    import pyarrow as pa

    texts = docs.column("text").to_pylist()
    good = set(trusted.column("good_id").to_pylist())
    known = [d in good for d in docs.column("doc_id").to_pylist()]
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for cut in _chunks(texts):
        for wanted in (True, False):
            own = [t for t, k in zip(texts[cut], known[cut], strict=True) if t and k is wanted]
            if not own:
                continue
            grams, n = np.unique(ngrams(own)[0], return_counts=True)
            merged, at = np.unique(np.concatenate([found, grams]), return_inverse=True)
            total = np.zeros(len(merged), np.int64)
            total[at[:len(found)]] += counts
            if wanted:
                total[at[len(found):]] += n
            found, counts = merged, total
    block = key[0].as_py()
    return pa.table({"block": pa.array(np.full(len(found), block, np.int32)), "gram": pa.array(found), "n": pa.array(counts)})


def _score_block(key, docs, grams):
    import pyarrow as pa

    order = np.argsort(grams.column("gram").to_numpy())
    known, logs = grams.column("gram").to_numpy()[order], grams.column("logp").to_numpy()[order]
    texts = docs.column("text").to_pylist()
    n_all, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for cut in _chunks(texts):
        full = [i for i in range(cut.start, cut.stop) if texts[i] and not texts[i].isspace()]
        if not full:
            continue
        keys, n = ngrams([texts[i] for i in full])
        at = np.searchsorted(known, keys)
        if not len(known) or (known[np.minimum(at, len(known) - 1)] != keys).any():
            raise ValueError("quality: the documents changed between two reads; write them to files first")
        values = logs[at]
        n_all[full] = n
        sums[full] = np.add.reduceat(values, np.concatenate([[0], np.cumsum(n)[:-1]]))
    blank = n_all == 0
    return pa.table({
        "doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "n_grams": pa.array(n_all),
        "log_perplexity": pa.array(-sums / np.maximum(1, n_all), mask=blank),
    })


def _suffix(gram: Column, order: int) -> Column:
    """The last order - 1 characters of an order-gram."""
    return gram.bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1).cast("long"))


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, BITS)


def _discounts(counts: DataFrame) -> DataFrame:
    """One row (d1, d2, d3) from the counts of counts of (gram, n)."""
    of = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    row = counts.agg(*of)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def d(k: int) -> Column:
        plain = F.lit(0.5 * k)  # where a count of counts is empty
        value = F.lit(float(k)) - F.lit(k + 1.0) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        sound = (F.col("n1") > 0) & (F.col(f"n{k}") > 0)
        return F.when(sound, F.least(F.lit(float(k)), F.greatest(F.lit(0.0), value))).otherwise(plain).alias(f"d{k}")

    return row.select(*[d(k) for k in (1, 2, 3)])


def _discount(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p) of every n-gram of ``grams`` (gram, n); n, the count in trusted
    text, may be 0."""
    counts = {order: grams.where("n > 0")}
    asked = {order: grams.select("gram")}
    for m in range(order - 1, 0, -1):  # continuation counts: distinct characters before
        counts[m] = materialize(counts[m + 1].groupBy(_suffix(F.col("gram"), m + 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "quality-counts")
        asked[m] = asked[m + 1].select(_suffix(F.col("gram"), m + 1).alias("gram")).distinct()
    lower = None
    for m in range(1, order + 1):
        discounted = counts[m].crossJoin(F.broadcast(_discounts(counts[m])))  # one row
        least = F.col("n").cast("double") - _discount(F.col("n"))
        seen = discounted.select("gram", F.greatest(F.lit(0.0), least).alias("left_over"))
        totals = discounted.groupBy(_context(F.col("gram")).alias("context")).agg(
            F.sum("n").cast("double").alias("total"), F.sum(F.least(F.col("n").cast("double"), _discount(F.col("n")))).alias("held"))
        q = asked[m].join(seen, "gram", "left").withColumn("context", _context(F.col("gram"))).join(totals, "context", "left")
        if m == 1:
            size = counts[1].agg((F.count(F.lit(1)) + 1).cast("double").alias("size"))
            q = q.crossJoin(F.broadcast(size)).withColumn("below", F.lit(1.0) / F.col("size"))
        else:
            q = q.withColumn("suffix", _suffix(F.col("gram"), m)).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise((F.coalesce("left_over", F.lit(0.0)) + F.col("held") * F.col("below")) / F.col("total"))
        lower = materialize(q.select("gram", p.alias("p")), "quality-p")
    return lower


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, n_grams, log_perplexity) of every row of ``docs`` (doc_id,
    lang, text) under the model of the documents in ``trusted`` (doc_id)."""
    spark = docs.sparkSession
    rows = need(docs, ("doc_id", "lang", "text")).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")
    rows = rows.select("doc_id", "lang", "text", block)
    good = need(trusted, ("doc_id",)).select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
    good = rows.select("doc_id", "block").distinct().join(good, "doc_id", "left_semi")  # an id at most once a block
    good = good.select(F.col("doc_id").alias("good_id"), F.col("block").alias("good_block"))
    with tidy_shuffles(spark):
        found = materialize(rows.groupBy("block").cogroup(good.groupBy("good_block")).applyInArrow(_count_block, "block int, gram long, n long"), "quality-grams")
        grams = materialize(found.groupBy("gram").agg(F.sum("n").alias("n")), "quality-grams")
        logs = probabilities(grams).select("gram", F.log("p").alias("logp"))
        dealt = found.select("block", "gram").join(logs, "gram").select("block", "gram", "logp")
        scores = rows.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(_score_block, "doc_id long, lang string, n_grams long, log_perplexity double")
        return materialize(scores, "quality-scores")


def _length_class() -> Column:
    """Number of doublings in n_grams."""
    return (F.length(F.bin("n_grams")) - 1).alias("class")


def fences(scores: DataFrame, trusted: DataFrame) -> DataFrame:
    """(lang, all_langs, class, low, high, n_lang) by language and length class;
    the rows with all_langs are those of all languages together."""
    from pyspark.sql import Window

    good = need(trusted, ("doc_id",)).select(F.col("doc_id").cast("long")).distinct()
    own = scores.where("log_perplexity IS NOT NULL").join(good, "doc_id", "left_semi")
    bins = own.groupBy("lang", _length_class(), F.floor(F.col("log_perplexity") * BINS).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = bins.groupBy("class", "bin").agg(F.sum("n").alias("n"))
    bins = bins.select("lang", F.lit(False).alias("all_langs"), "class", "bin", "n").unionByName(every.select(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("all_langs"), "class", "bin", "n"))
    bins = materialize(bins, "quality-bins")
    # widest distance of classes taken in: the first that has enough documents, or all
    classes = scores.select(_length_class().alias("of")).distinct()  # under 64
    distance = F.abs(F.col("class") - F.col("of"))
    sums = bins.groupBy("lang", "all_langs", "class").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(classes)).groupBy("lang", "all_langs", "of", distance.alias("distance")).agg(F.sum("n").alias("n"))
    group = Window.partitionBy("lang", "all_langs", "of")
    upto = sums.withColumn("upto", F.sum("n").over(group.orderBy("distance")))
    near = upto.groupBy("lang", "all_langs", "of").agg(F.coalesce(F.min(F.when(F.col("upto") >= LEAST_TRUSTED, F.col("distance"))), F.max("distance")).alias("within"), F.sum("n").alias("n_lang"))
    near = near.select(F.col("lang").alias("near_lang"), F.col("all_langs").alias("near_all"), "of", "within", "n_lang")
    on = F.col("lang").eqNullSafe(F.col("near_lang")) & (F.col("all_langs") == F.col("near_all")) & (distance <= F.col("within"))
    taken = bins.join(near, on).groupBy("lang", "all_langs", "of", "n_lang", "bin").agg(F.sum("n").alias("n"))
    ranked = taken.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))

    def first_bin(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("bin")))

    low, high = (F.col("total") - 1) * QUANTILES[0], (F.col("total") - 1) * QUANTILES[1]
    return ranked.groupBy("lang", "all_langs", F.col("of").alias("class"), "n_lang").agg(
        (first_bin(F.floor(low)) / BINS).alias("low"), ((first_bin(F.ceil(high)) + 1) / BINS).alias("high"))


def classify(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_grams, perplexity, low, high (fences as perplexities) and
    keep of every row; without any trusted text nothing stays."""
    scores = perplexities(docs, trusted)
    table = materialize(fences(scores, trusted), "quality-fences")
    own = table.where(~F.col("all_langs") & (F.col("n_lang") >= LEAST_TRUSTED)).select(F.col("lang").alias("own_lang"), F.col("class").alias("own_class"), F.col("low").alias("own_low"), F.col("high").alias("own_high"))
    every = table.where("all_langs").select(F.col("class").alias("any_class"), F.col("low").alias("any_low"), F.col("high").alias("any_high"))
    out = scores.withColumn("class", _length_class())
    out = out.join(own, F.col("lang").eqNullSafe(F.col("own_lang")) & (F.col("class") == F.col("own_class")), "left")
    out = out.join(F.broadcast(every), F.col("class") == F.col("any_class"), "left")  # under 64 rows
    out = out.withColumn("low", F.coalesce("own_low", "any_low")).withColumn("high", F.coalesce("own_high", "any_high"))
    keep = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select("doc_id", "lang", "n_grams", *[F.exp(a).alias(b) for a, b in (("log_perplexity", "perplexity"), ("low", "low"), ("high", "high"))], keep.alias("keep"))
