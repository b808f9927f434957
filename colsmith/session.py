"""Session helpers: a local session for tests and benchmarks, the folder that executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str | None = None, partitions: int = 8, app: str = "colsmith") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("COLSMITH_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where that is unset, a local master (tests) gets a
    temporary one; on a cluster it is an error, as executors have no local folder in common."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='colsmith-shared-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/colsmith-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM is gone already; the cluster's own clean-up applies
        pass
