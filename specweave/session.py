"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "specweave",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own master."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session's cluster, once: a
    small archive that Spark hands to them, so they need neither the driver's
    working folder nor an installation.  (Nothing to do where the package comes from
    such an archive itself.)"""
    context, here = spark.sparkContext, Path(__file__).parent
    if getattr(context, "_specweave_shipped", False) or not here.is_dir():
        return
    modules = sorted(here.rglob("*.py"))
    digest = hashlib.sha256(b"".join(m.read_bytes() for m in modules)).hexdigest()[:16]
    folder = tempfile.mkdtemp(prefix="specweave-package-")
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/specweave-{digest}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for m in modules:
            z.write(m, m.relative_to(here.parent))
    context.addPyFile(archive)
    context._specweave_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the session has none, a local master (unit tests, a laptop) gets a
    private folder; on a cluster that folder would differ from machine to
    machine, so the setting is demanded there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="specweave-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_SCRATCH: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh, never reused path under the shared checkpoint folder; it is
    removed when this process ends (or by :func:`clear_scratch`)."""
    if not _SCRATCH:
        atexit.register(clear_scratch)
    path = f"{checkpoint_root(spark)}/specweave/{name}-{uuid.uuid4().hex}"
    _SCRATCH[path] = spark
    return path


def clear_scratch() -> None:
    """Remove what :func:`scratch_path` has named so far; results read from
    there must have been consumed."""
    while _SCRATCH:
        path, spark = _SCRATCH.popitem()
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder
    and read it back: cuts the lineage (a lost executor re-reads the table
    instead of recomputing) and lets several consumers share one computation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
