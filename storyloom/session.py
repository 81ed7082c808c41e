"""Session set-up and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "storyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on. AQE splits skewed join partitions."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Pages and articles are large rows: bound what one Python batch holds.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of texts that one Arrow batch takes to Python.
BATCH_BYTES = 4 * 1024 * 1024


def bound_batches(spark: SparkSession | None = None) -> None:
    """From now on, Arrow batches of this session are bounded in bytes, whatever it was set up with.

    Batches are counted in rows otherwise, and ten thousand long texts, and what Python makes of them, are large.
    """
    (spark or SparkSession.active()).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder named by ``spark.checkpoint.dir``; pick one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="storyloom-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def durable(df: DataFrame) -> DataFrame:
    """Materialize in the checkpoint folder: cuts lineage and survives lost executors.

    A checkpoint computes its input twice (once to run, once to write) unless it is cached meanwhile.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, for stream state and stream output."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
