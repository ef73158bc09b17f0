"""Session construction and lineage cutting.

Configuration follows the execution model the library is written for:
AQE on (runtime partition coalescing, skew-join splitting and runtime
conversion of a join to broadcast only when the measured side is below
the threshold), UI off, UTC, Arrow for pandas transfer.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "terrascore", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("TERRASCORE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialised intermediate tables.

    Uses the checkpoint directory the cluster names (``spark.checkpoint.dir``
    or one already set on the context).  Only a local-mode session without
    one gets a private temporary folder; a cluster session without one is an
    error, because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrascore-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing a
    shuffle) and fixes partition contents, which the prefix-sum helper
    relies on between its jobs.  One computation, unlike an RDD checkpoint
    that evaluates the plan twice.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: a lookup table of at most this many bytes is broadcast
BROADCAST_BYTES = 32 << 20


def measured_bytes(table: DataFrame) -> int:
    """Size of a table's values, with 16 bytes of overhead a value."""
    one = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + F.lit(16) for c in table.columns]
    return table.agg(F.sum(sum(one[1:], one[0]).cast("long"))).head()[0] or 0


def join_lookup(df: DataFrame, lookup: DataFrame, on, how: str = "left") -> DataFrame:
    """Join ``df`` with a written table of one row per key.

    The lookup is broadcast when its measured size is within
    ``BROADCAST_BYTES``, so a table whose key has few values is not shuffled
    on it.  A larger one has many keys; that join shuffles, and adaptive
    execution splits the partitions of hot keys."""
    return df.join(F.broadcast(lookup) if measured_bytes(lookup) <= BROADCAST_BYTES else lookup, on, how)
