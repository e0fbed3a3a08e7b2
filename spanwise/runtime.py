"""Session, table and materialisation helpers shared by every operator."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "spanwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the queries assume: UTC and adaptive execution."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small input has fewer partitions than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and all tasks run in the driver's own process
    is a temporary folder of this machine used; on a cluster that is an error, since executors wouldn't see each other's files.
    What went before is of no use any more: Spark removes its shuffle files and checkpoints when the driver collects its garbage, which is asked for here.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spanwise-"))
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    sc._jvm.System.gc()
    return out


def is_blank(c: Column) -> Column:
    """Null or nothing but white space of any script."""
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1c-\x1f\u0085]")


def hot_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], share: int = 4096) -> DataFrame:
    """Inner join with a table (key columns, n, ...) of one row a key, n being the rows of ``left`` that have it.

    Keys that hold over one ``share``-th of all rows are hot. At most ``share`` keys can, so they are
    broadcast and their rows stay where they are; all other rows take one shuffled join. The right side is
    read several times and should be materialised.
    """
    key = [key] if isinstance(key, str) else list(key)
    total = right.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    limit = max(total // share, 1000)
    hot, rest = F.broadcast(right.where(F.col("n") > limit)), right.where(F.col("n") <= limit)
    return left.join(hot, key).unionByName(left.join(hot.select(*key), key, "left_anti").join(rest, key))


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once a context, unless their path has it."""
    root = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_spanwise_sent", False):
        return
    # the driver serves the archive to executors for as long as it lives
    d = tempfile.mkdtemp(prefix="spanwise-")
    atexit.register(shutil.rmtree, d, True)
    shutil.make_archive(f"{d}/spanwise_package", "zip", root.parent, root.name)
    sc.addPyFile(f"{d}/spanwise_package.zip")
    sc._spanwise_sent = True
