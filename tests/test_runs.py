"""W1 batch runs vs a brute-force scan; K2 streaming equals the batch."""

import os

from pyspark.sql import functions as F

from specweave.operators.runs import consecutive_runs, idle_predicate
from specweave.streaming.runs import consecutive_runs_stream
from conftest import SF001


def brute(rows, n):
    out, run, last = [], {}, {}
    for key, order, p in sorted(rows, key=lambda r: (r[0], r[1])):
        run[key] = run.get(key, 0) + 1 if p else 0
        if run[key] == n:
            out.append((key, order))
    return sorted(out)


def test_runs_match_brute_force(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    rows = [(r.user_id, r.event_id, (r.value is not None and r.value <= 20)) for r in ev.collect()]
    exp = brute(rows, 3)
    for width in (1 << 20, 5, 64):
        got = sorted(map(tuple, consecutive_runs(ev, "user_id", "event_id", F.col("value") <= 20, 3, width)
                         .select("user_id", "event_id").collect()))
        assert got == exp, width


def test_hot_key_runs(spark):
    # one key holds most rows; runs cross bucket edges
    rows = [(1, i, i % 11 != 0) for i in range(3000)] + [(2, i, True) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, o long, p boolean")
    got = sorted(map(tuple, consecutive_runs(df, "k", "o", F.col("p"), 4, bucket_width=7).select("k", "o").collect()))
    assert got == brute(rows, 4)


def test_idle_predicate(spark):
    df = spark.createDataFrame([(900, 5), (1000, 10), (1001, 0), (10, 11)], "m long, u long")
    assert [r.i for r in df.select(idle_predicate(F.col("m"), F.col("u")).alias("i")).collect()] == [True, True, False, False]


def test_stream_matches_batch_across_microbatches(spark, tmpdir_path):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src = os.path.join(tmpdir_path, "stream-in")
    # four files = four micro-batches, runs crossing their edges
    bounds = [0, 250, 500, 750, 1000]
    for i in range(4):
        ev.where((F.col("event_id") >= bounds[i]) & (F.col("event_id") < bounds[i + 1])).coalesce(1) \
          .write.parquet(os.path.join(src, f"b{i}"))
    import glob
    import shutil
    flat = os.path.join(tmpdir_path, "flat")
    os.makedirs(flat)
    for i, f in enumerate(sorted(glob.glob(os.path.join(src, "b*", "*.parquet")))):
        dst = os.path.join(flat, f"part-{i}.parquet")
        shutil.copy(f, dst)
        os.utime(dst, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))  # file source reads oldest first
    got = consecutive_runs_stream(spark, flat, "user_id", "event_id", "value <= 20", 3, max_files_per_trigger=1)
    exp = consecutive_runs(ev, "user_id", "event_id", F.col("value") <= 20, 3)
    assert sorted(map(tuple, got.select("user_id", "event_id").collect())) == \
        sorted(map(tuple, exp.select("user_id", "event_id").collect()))


def test_null_keys_string_keys_and_timestamps(spark):
    import datetime as dt

    at = [dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=37 * i * i) for i in range(40)]
    rows = [(k, t, i % 9 != 4) for k in ("a", None, "b") for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "host string, t timestamp, p boolean")
    exp = sorted(brute([(k or "", t, p) for k, t, p in rows], 3))
    for width in (None, 1000, 50):
        got = consecutive_runs(df, "host", "t", F.col("p"), 3, bucket_width=width).select("host", "t").collect()
        assert sorted((r.host or "", r.t) for r in got) == exp


def test_every_row_is_kept_and_ties_are_stable(spark):
    from specweave.operators.numbering import number_rows
    from specweave.operators.runs import run_lengths

    rows = [(1, 5, True), (1, 5, False), (1, None, True), (None, 5, True), (None, None, None), (1, 6, True)]
    df = spark.createDataFrame(rows, "k long, o long, p boolean")
    got = run_lengths(df, "k", "o", F.col("p"))
    assert got.columns == ["k", "o", "p", "run_length"] and got.count() == 6
    # the false sample of a tie comes first, so the run is 1, then 2
    assert [(r.o, r.p, r.run_length) for r in got.where("k = 1 AND o IS NOT NULL").orderBy("o", "p").collect()] == [(5, False, 0), (5, True, 1), (6, True, 2)]
    numbered = number_rows(spark.createDataFrame([(None, 1), (None, 2), (1, None)], "g long, x long"), ["g"], "x")
    assert sorted((str(r.g), r.line_number) for r in numbered.collect()) == [("1", 1), ("None", 1), ("None", 2)]


def stream_folder(spark, root, batches, schema):
    """One file per batch, oldest first."""
    import glob
    import shutil

    flat = os.path.join(root, "flat")
    os.makedirs(flat)
    for i, rows in enumerate(batches):
        one = os.path.join(root, f"one{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(one)
        dst = os.path.join(flat, f"part-{i}.parquet")
        shutil.copy(glob.glob(os.path.join(one, "part-*"))[0], dst)
        os.utime(dst, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    return flat


def test_stream_with_string_and_null_keys(spark, tmpdir_path):
    batches = [[(k, 10 * b + i, (b + i) % 7 != 3) for i in range(10) for k in ("hot", None, f"k{b}")] for b in range(3)]
    schema = "host string, o long, p boolean"
    got = consecutive_runs_stream(spark, stream_folder(spark, tmpdir_path, batches, schema), "host", "o", "p", 4, max_files_per_trigger=1)
    exp = brute([(k or "", o, p) for b in batches for k, o, p in b], 4)
    assert sorted((r.host or "", r.o) for r in got.collect()) == exp and exp


def test_late_file_fails_the_stream(spark, tmpdir_path):
    import pytest

    from specweave.streaming.runs import LateSampleError

    batches = [[("a", 5, True)], [("a", 4, True)]]
    with pytest.raises(LateSampleError, match="sample at 4 after one at 5"):
        consecutive_runs_stream(spark, stream_folder(spark, tmpdir_path, batches, "k string, o long, p boolean"), "k", "o", "p", 2, max_files_per_trigger=1)


def test_stream_equals_batch_on_random_runs(spark, tmpdir_path):
    import random

    rng = random.Random(4)
    rows, batches = [], []
    for b in range(5):
        batch = [(k, 100 * b + i, rng.random() < 0.8) for k in range(6) for i in rng.sample(range(100), rng.randint(0, 6))]
        batch += [(9, 100 * b + i, True) for i in range(3)]  # one run over all batches
        rows, batches = rows + batch, [*batches, batch]
    flat = stream_folder(spark, tmpdir_path, batches, "k long, o long, p boolean")
    for n, files in ((3, 2), (14, 1)):
        got = consecutive_runs_stream(spark, flat, "k", "o", "p", n, max_files_per_trigger=files).collect()
        assert sorted((r.k, r.o) for r in got) == brute(rows, n) and all(r.run_length == n for r in got)


def test_stream_goes_on_from_its_checkpoint(spark, tmpdir_path):
    import pytest

    from specweave.streaming.runs import LateSampleError

    schema = "k string, o long, p boolean"
    batches = [[("a", 10 * b + i, True) for i in range(2)] + [(f"only{b}", 10 * b, True)] for b in range(3)]
    folder, checkpoint = stream_folder(spark, tmpdir_path, batches[:1], schema), os.path.join(tmpdir_path, "state")

    def go(**kw):
        return sorted(map(tuple, consecutive_runs_stream(spark, folder, "k", "o", "p", 5, checkpoint=checkpoint, **kw).collect()))

    assert go() == []
    for b in (1, 2):
        spark.createDataFrame(batches[b], schema).coalesce(1).write.mode("append").parquet(folder)
        assert go() == ([("a", 20, 5)] if b == 2 else [])
    assert go() == [("a", 20, 5)]  # nothing new
    with pytest.raises(ValueError, match="other settings"):
        consecutive_runs_stream(spark, folder, "k", "o", "p", 4, checkpoint=checkpoint)
    # the second query saw one row per key and batch, in the keyed store
    assert spark.read.parquet(f"{checkpoint}/segments/*").count() == 6 and os.path.isdir(f"{checkpoint}/state/state")
    spark.createDataFrame([("only0", 0, True)], schema).coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(LateSampleError, match="key 'only0': sample at 0 after one at 0"):
        go()


def test_idle_keys_are_retired(spark, tmpdir_path):
    import datetime as dt

    def at(minute):
        return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)

    batches = [[("a", at(0), True), ("a", at(1), True), ("b", at(0), True)], [("a", at(2), True), ("b", at(300), True)], [("a", at(301), True), ("b", at(301), True), ("b", at(302), True)]]
    folder = stream_folder(spark, tmpdir_path, batches, "k string, t timestamp, p boolean")
    kept = consecutive_runs_stream(spark, folder, "k", "t", "p", 4, max_files_per_trigger=1).collect()
    assert sorted((r.k, r.t) for r in kept) == [("a", at(301)), ("b", at(302))]
    retired = consecutive_runs_stream(spark, folder, "k", "t", "p", 3, max_files_per_trigger=1, retire_after_seconds=3600).collect()
    assert sorted((r.k, r.t) for r in retired) == [("a", at(2)), ("b", at(302))]


def test_shared_folder_is_demanded_on_a_cluster():
    import pytest

    from specweave.session import checkpoint_root

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def uneven_rows(n):
    """A hot key with most of its rows close together, one far outlier, ties and NULL
    orders; all columns of many rows are equal."""
    rows = [(1, i, i % 7 != 0) for i in range(n)] + [(1, 10**15, True)]
    rows += [(1, n + 5, i % 2 == 0) for i in range(n // 2)]
    rows += [(2, None, True)] * (n // 2) + [(2, i, True) for i in range(50)] + [(None, 3, True)] * 20
    return rows


def test_uneven_orders_keep_buckets_small(spark):
    from specweave.operators import numbering
    from specweave.operators.runs import run_lengths

    n, bound = 20_000, 2000
    rows = uneven_rows(n)
    df = spark.createDataFrame(rows, "k long, o long, p boolean").repartition(4)
    parts, part, _ = numbering.sorted_parts(df, ["k"], [F.col("o")], -(-len(rows) // bound))
    assert parts.groupBy(part).count().agg(F.max("count")).first()[0] <= 3 * bound
    # numbers: dense per group, in order, NULL orders first
    got = numbering.number_rows(df, ["k"], "o", max_rows=bound).collect()
    assert "sorted" not in got[0].asDict() and len(got) == len(rows)
    for k in (1, 2, None):
        mine = sorted((r.line_number, -1 if r.o is None else r.o) for r in got if r.k == k)
        assert [i for i, _ in mine] == list(range(1, len(mine) + 1))
        assert [o for _, o in mine] == sorted(o for _, o in mine)
    # run lengths: as with one bucket per key
    def lengths(**kw):
        found = run_lengths(df, "k", "o", F.col("p"), **kw)
        return sorted((str(r.k), str(r.o), r.p, r.run_length) for r in found.collect())

    assert lengths(rows_per_bucket=bound // 4) == lengths(bucket_width=1 << 60)


def test_even_orders_need_no_sort(spark):
    from specweave.operators.runs import run_lengths

    df = spark.range(20_000).selectExpr("id % 3 AS k", "id AS o", "id % 5 > 0 AS p")
    plan = run_lengths(df, "k", "o", F.col("p"), rows_per_bucket=1000)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "numbering-parts" not in plan


def test_columns_with_the_operators_own_names(spark):
    from specweave.operators.numbering import number_rows
    from specweave.operators.runs import run_lengths

    names = ["_nb", "_off", "_p", "_o", "_b", "_bucket", "_count", "_k", "_rn", "_part", "_place", "_salt", "_k0"]
    df = spark.range(3000).selectExpr("id % 2 AS k", "CASE WHEN id = 7 THEN 1000000000000 ELSE id END AS o", "id % 3 > 0 AS p", *[f"id AS `{n}`" for n in names])
    for kw in ({}, {"max_rows": 500}):
        got = number_rows(df, ["k"], "o", **kw)
        assert got.columns == [*df.columns, "line_number"]
        assert got.where(" OR ".join(f"`{n}` <> _nb" for n in names)).count() == 0 and got.where("_nb <> 7 AND _nb <> o").count() == 0
    for kw in ({}, {"rows_per_bucket": 100}):
        got = run_lengths(df, "k", "o", F.col("p"), **kw)
        assert got.columns == [*df.columns, "run_length"] and got.where(" OR ".join(f"`{n}` <> _nb" for n in names)).count() == 0
