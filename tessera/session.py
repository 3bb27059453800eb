"""Spark session defaults and the shared checkpoint location.

Everything in the library takes a ``SparkSession`` from the caller; this module
only offers the settings we rely on (UTC session time zone, AQE with skew-join
handling, Arrow for pandas UDFs) and a helper that resolves the checkpoint
folder from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of the library assumes.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "tessera",
                  shuffle_partitions: int | None = None,
                  extra_conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    On a cluster leave ``master`` unset so spark-submit decides; tests pass
    ``local[*]`` and a small shuffle partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_python_path(spark: SparkSession) -> None:
    """Make the package importable by Python workers started for UDFs.

    On a cluster ship the package with ``--py-files``; locally the folder that
    holds the package is added to the PYTHONPATH handed to new workers.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root] + parts)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/S3/...) folder there and we use it as is. It
    may be unset only where driver and executors are one process (master
    ``local``), as in tests; then a fresh scratch folder is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    ensure_python_path(spark)
    return configured


def cuts_dir(spark: SparkSession) -> str:
    """Where this application writes its intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder (with
    the writer's ``options``) and read it back.

    Used where an intermediate is read by several branches of a plan; it
    survives executor loss because the data sits in the shared folder, not
    on a machine-local disk, and later stages read it column-pruned. The files
    stay until ``drop_cuts``: a lazy result may still read them.
    """
    path = f"{cuts_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, when no frame that
    reads them is needed any more (at the end of a job)."""
    from pyarrow import fs

    folder = cuts_dir(spark)
    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


def cluster_conf(input_bytes: int, executor_cores: int = 4, target_partition_bytes: int = 128 * 1024 * 1024,
                 broadcast_limit_bytes: int = 64 * 1024 * 1024) -> dict:
    """Settings sized from the input volume for a large cluster.

    Shuffle partitions are chosen so each initial partition holds about
    ``target_partition_bytes`` of input (AQE then coalesces small ones and
    splits skewed ones); file splits match the same size; the broadcast
    threshold is an explicit, bounded number.
    """
    parts = max(200, int(input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.autoBroadcastJoinThreshold": str(broadcast_limit_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(broadcast_limit_bytes),
        "spark.sql.session.timeZone": "UTC",
        "spark.executor.cores": str(executor_cores),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
