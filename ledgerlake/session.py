"""Session helpers.

Library code never builds its own cluster session: every job takes the
``SparkSession`` it is given. ``local_session`` exists for tests and the
bench only. ``checkpoint_dir`` reads the shared folder the cluster names
in ``spark.checkpoint.dir``; a local session without one gets a scratch
folder, any other raises.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Sensible local defaults; on a cluster these come from the deployment.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Cluster profile for the 100 TB target (applied by the deployment, e.g. via
# spark-submit --conf; the library only reads the session it is given).
# Sizing: ~100 TB of order lines in 256 MB input splits is ~400k scan tasks;
# 1000 executors x 8 cores work through them in ~50 waves. Shuffles start at
# 32k partitions and AQE coalesces them towards 256 MB each, so a partition
# stays far below executor memory at every stage; skewed partitions (a key
# with a third of the rows) are split by AQE's skew join handling, and every
# aggregation in the library is partial on the map side.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "32768",
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    # dimensions up to 64 MB (after pruning) broadcast by size; the fact never
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # spark.checkpoint.dir: the shared folder of the cluster (set by the deployment)
}


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  driver_memory: str = "16g", app: str = "ledgerlake") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or (cpus if isinstance(cpus, int) else 8))
    conf["spark.driver.memory"] = driver_memory
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring the context if needed.

    Order: the context's current dir, then ``spark.checkpoint.dir`` from the
    session conf, then, in a local session only, a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="ledgerlake-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df):
    """Write an intermediate that several branches of one plan consume to
    reliable storage once (``checkpoint``), instead of letting each branch
    re-run its upstream plan. Used for the per-customer aggregate behind the
    RFM scores, never for raw fact rows; also cuts the lineage, so a lost
    executor does not trigger a recomputation from the source tables."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
