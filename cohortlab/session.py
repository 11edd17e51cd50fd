"""Spark session defaults used by the tests, the bench and the batch job.

On a cluster the session is created by the platform; ``configure`` only fills in settings
that are unset, so cluster-level values (shuffle partitions, checkpoint dir, ...) win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "cohortlab", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("COHORTLAB_DRIVER_MEMORY", "12g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster sets it to a shared file system. Only on a local master, as in tests, a scratch
    folder is made when it is unset; elsewhere executors would write to their own disks.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="cohortlab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


#: Paths of the tables written by ``materialize`` in this process and not dropped since.
STORED: list[str] = []


def drop_stored(spark: SparkSession, paths=None) -> None:
    """Delete stored tables that nothing reads any more (all of this process by default)."""
    jvm = spark.sparkContext._jvm
    for path in list(STORED if paths is None else paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if path in STORED:
            STORED.remove(path)


def materialize(df, name: str):
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but computes the plan once (no count + write double run),
    stores it columnar, and lets readers prune columns and push filters into the scan.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/cohortlab-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    STORED.append(path)
    return spark.read.parquet(path)
