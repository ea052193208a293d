"""Session defaults, shared scratch storage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A table is broadcast only up to both limits; beyond them a shuffle join is used.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 256 << 20


def build_session(app: str = "glyphloom", master: str | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow on; ``conf`` overrides by name."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Checkpoints of finished training rounds are removed.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Local sessions without the setting get a temporary folder; on a cluster the
    setting is required, since executors do not share the driver's disk.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="glyphloom-")
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to reliable storage, its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of fixed-width columns and at most ``rows`` rows, with a broadcast hint if
    that is within the limit."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def parallelism(spark: SparkSession) -> int:
    """Partition count for compute-heavy stages: every core, or more on request."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, shuffle)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan by ``key`` when its files give fewer tasks than cores.

    A large table has more splits than cores and passes through without a shuffle.
    Call it on plain scans only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
