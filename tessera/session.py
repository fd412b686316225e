"""Session helpers: sane defaults for tests/bench, checkpoint-dir discovery."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A derived table is broadcast only when it is measured to be at most this.
BROADCAST_BYTES = 16 << 20


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """Local session used by tests and bench. On a cluster, build your own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # drop checkpoint files once the pinned DataFrames are garbage collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. A fresh scratch folder is
    used only in one-process (``local[...]``) sessions that configure none; on
    any other master a machine-local folder would lose data, so that raises."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared checkpoint dir) to cut lineage / pin a
    derived table that is read more than once. Never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(pinned: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint for a pinned table of ``rows`` rows of at most
    ``row_bytes`` bytes, if that is at most BROADCAST_BYTES; else no hint."""
    return F.broadcast(pinned) if rows * row_bytes <= BROADCAST_BYTES else pinned
