"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_staged: list[str] = []


def build_session(app_name: str = "vigia", **conf: str) -> SparkSession:
    """Session with AQE (coalescing, skew joins) and UTC times; extra settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoint(): the cluster's shared one; a private one only if none is named."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF, None
    )
    if named:
        spark.sparkContext.setCheckpointDir(named)
        return named
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder before running on a cluster")
    path = tempfile.mkdtemp(prefix="vigia-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back. What reads the result scans only
    the columns it needs, nothing above is computed again, and a lost executor costs a read. The table goes when
    the process ends, or earlier with ``drop_staged``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(_drop_at_exit, spark)
    _staged.append(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs left: plans in the driver's memory, and shuffle files and broadcasts, which Spark's
    cleaner deletes only after the driver's collector has found nothing that refers to them. Spark itself asks for
    that every half hour (``spark.cleaner.periodicGC.interval``), too late for a query of many staged steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table of this process; for callers whose results are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop().rpartition("/")[0])
        path.getFileSystem(conf).delete(path, True)


def _drop_at_exit(spark: SparkSession) -> None:
    try:
        drop_staged(spark)
    except Exception:  # the session has gone; the owner of the folder cleans up
        pass
