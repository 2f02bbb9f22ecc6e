"""Session helpers: one place for the configuration every operator assumes.

Operators never create sessions themselves; they take the caller's DataFrames.
These helpers exist for tests, the bench and the query catalogue.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "tessera", driver_memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``checkpoint()`` has a reliable directory.

    On a cluster the shared folder comes from ``spark.checkpoint.dir``; we only
    invent a directory when that is unset *and* the master is local (tests,
    the bench). A cluster without the setting is a configuration error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
        return path
    raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver can (it is neither installed,
    nor on PYTHONPATH, nor in the working directory): Spark sends them a zip of it, once a session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    sc = spark.sparkContext
    if root in known or "site-packages" in root or getattr(sc, "_tessera_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tessera-package-")  # the driver's own copy; Spark serves it to the workers
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "tessera"), "zip", root, "tessera"))
    sc._tessera_shipped = True


def ensure_parallel(df):
    """Spread a scan that yields fewer splits than the cluster has cores.

    A large table already arrives in thousands of splits and is returned as is;
    a single small file (one row group = one task) is round-robin repartitioned
    once so the per-row work that follows (unpivots, Expand, hashing) uses every
    core. Round-robin repartition sorts locally first, so retries are stable.
    """
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < max(2, target // 2):
        return df.repartition(target)
    return df


def table(spark: SparkSession, sf_dir: str, name: str):
    return ensure_parallel(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def materialize(df):
    """Cut lineage with a reliable checkpoint in the session's checkpoint folder.

    Used where a composed operator would otherwise re-plan (and re-run) a deep
    DAG several times; survives executor loss, unlike a local checkpoint.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    # without persisting, the checkpoint write recomputes the whole plan a second time
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


def small_frame(df):
    """Pin a frame that is small by construction (one row per column or model) by collecting it and
    recreating it from its rows -- cheaper than a checkpoint write. Not for frames that grow with the data."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
