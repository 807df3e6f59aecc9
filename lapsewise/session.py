"""Spark session helpers.

On a cluster the session comes from the platform; ``get_session`` is the
local/test entry point. Settings that matter at scale are applied only when
the caller has not set them already.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime re-planning: broadcast small join sides at run time (size checked by
# Spark itself), split skewed shuffle partitions, coalesce tiny ones.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "lapsewise",
                shuffle_partitions: int | None = None) -> SparkSession:
    builder = (SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # remove reliable checkpoints once their DataFrames are garbage-collected
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        builder = builder.config("spark.driver.memory", os.environ.get("LAPSEWISE_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    for key, value in SCALE_DEFAULTS.items():
        if key == "spark.sql.session.timeZone" or spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the setting is absent in local mode (tests) a fresh folder is
    created and registered; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: lapsewise never "
                           "materialises into a machine-local folder on a cluster")
    local = tempfile.mkdtemp(prefix="lapsewise-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def materialize(df):
    """Cut lineage: reliable ``checkpoint`` into the shared checkpoint folder.

    Used where a result is read by many later plans (split cuts, the scored
    table); a reliable checkpoint survives executor loss, unlike a local one.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df):
    """``df`` written once as zstd Parquet in the shared checkpoint folder, and the frame that reads it.

    Like ``materialize`` for wide rows read by many passes: a checkpoint keeps them uncompressed, with eight
    bytes and more a value.
    """
    path = scratch_path(df.sparkSession, f"rows-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder under the checkpoint folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
