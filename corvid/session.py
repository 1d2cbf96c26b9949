"""Spark session helpers.

Cluster settings (executor sizes, shuffle partitions, checkpoint folder) come
from whoever submits the job.  Local defaults below are applied only when the
setting is absent, so the same code runs unchanged under ``spark-submit``.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC wall clock (the test tables hold
# timestamp_ntz values compared with dates), adaptive execution for runtime
# re-planning (coalescing, skew-join splitting, broadcast switch on measured
# sizes), and no web UI.
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def is_local(master: str) -> bool:
    """One process: ``local``, ``local[n]``, but not ``local-cluster``."""
    return master.startswith("local") and not master.startswith("local-cluster")


def get_spark(master: str | None = None, app: str = "corvid",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    if master and is_local(master) and not conf.get("spark.checkpoint.dir"):
        # Local runs only: a cluster names its shared folder in the conf.
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(
            prefix="corvid-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Register the checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there.  Only a ``local`` master may fall
    back to a private scratch folder; elsewhere executors could not read each
    other's files, so a missing setting is an error.
    """
    sc = spark.sparkContext
    conf_dir = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not conf_dir:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="corvid-ckpt-",
                                    dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` computed once, as Parquet in the shared folder, so that Spark knows its size and every read gets the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A task of repeated passes over a table has so many rows if that takes no more tasks than there are cores, else more.
ROWS_PER_TASK = 50_000
MOST_ROWS_PER_TASK = 500_000


def dealt_out(df: DataFrame, name: str = "rows", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``written`` over enough tasks to use the cluster in later passes; few rows stay where they are."""
    kept = written(df, name)
    n, cores = kept.count(), kept.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(math.ceil(n / rows_per_task), cores), math.ceil(n / MOST_ROWS_PER_TASK))
    return written(kept.repartition(tasks), name) if tasks > 1 else kept
