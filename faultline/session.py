"""SparkSession construction with the settings every job here relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    return (builder
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false"))


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "faultline") -> SparkSession:
    builder = configure(SparkSession.builder.appName(app))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (HDFS/object store) folder and is
    used as is.  Only when it is unset — local tests — a scratch folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="faultline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def ship_package(spark: SparkSession) -> None:
    """Make ``faultline`` importable in Python workers (pandas UDFs / state functions
    defined in the package are pickled by reference): zip it once and ``addPyFile``."""
    import shutil
    import sys

    sc = spark.sparkContext
    if getattr(sc, "_faultline_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="faultline-pkg-", dir=os.environ.get("TMPDIR", "/tmp"))
    archive = shutil.make_archive(os.path.join(out, "faultline"), "zip", root_dir=os.path.dirname(pkg),
                                  base_dir="faultline")
    sc.addPyFile(archive)
    sc._faultline_shipped = True
    if os.path.dirname(pkg) not in sys.path:
        sys.path.insert(0, os.path.dirname(pkg))


def materialize(df, name: str = "t"):
    """Cut lineage by writing ``df`` as a parquet table in the shared checkpoint folder
    and reading it back.  Unlike a reliable ``checkpoint()`` of an unpersisted plan
    (one job to count, a second to recompute and write), the plan runs once; the table
    survives lost executors and gives AQE real statistics for the next stage."""
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")     # the table replaces the shuffle files it came from
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, kept)
    out = spark.read.parquet(path)
    out._stored_at = path
    return out


#: Most rows of a table that is broadcast after counting it; its rows are to be narrow.
BROADCAST_ROWS = 100_000


def broadcast_if_small(stored):
    """A stored table with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows, counted
    here; beyond that the join is left to shuffle.  The result is the same either way."""
    return F.broadcast(stored) if stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else stored


def shuffled(df):
    """A side of a join that is to shuffle, whatever size Spark takes it for: rows behind an explode, a
    union or a grouping are sized by the file that they come from, and millions would be broadcast."""
    return df.hint("merge")


def discard(*tables) -> None:
    """Delete tables that ``materialize`` stored, once nothing will read them again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
