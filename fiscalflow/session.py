"""SparkSession construction and the shared output folder."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Session settings every job of the library relies on.
#  * UTC session zone: the model's timestamps are zone-less (TIMESTAMP_NTZ) and the
#    month window is computed from an explicit as-of date, never the wall clock.
#  * AQE with partition coalescing and skew-join splitting: the documents x tasks
#    join is M:N over process_instance_id and one process may be hot. Splitting is
#    forced even when the operator after the join relies on the join's partitioning
#    (the report's distinct, the purchase-order roll-up): AQE then adds the one
#    shuffle needed, but only when a partition is actually skewed.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.ui.enabled": "false",
}

# Settings for a cluster (applied when the master is not ``local``). The number of
# shuffle partitions follows the input (``size_shuffles``); until a job has set it,
# Spark's default holds.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    # broadcast only what the planner measures below 10 MB (Spark's default)
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


# Single machine: inputs are a few MB, so let AQE coalesce small shuffles down to
# partitions of 64 KB rather than 1 MB, keeping every core busy after a shuffle.
LOCAL_CONF = {
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 * 1024),
}


def build_session(
    master: str | None = None,
    app_name: str = "fiscalflow",
    shuffle_partitions: int | None = None,
    profile: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or get) a session with the library's settings. ``profile`` is "local" or
    "cluster"; by default it follows the master (given, or of the submitted job)."""
    if profile is None:
        named = master or SparkConf().get("spark.master", "local")
        profile = "local" if named.split("[")[0] == "local" else "cluster"
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    else:
        conf.update(LOCAL_CONF)
    if shuffle_partitions is None and profile != "cluster":
        # one reducer per local core (AQE coalesces further when data is small)
        shuffle_partitions = os.cpu_count() or 8
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001 - Spark Connect
        pass
    return spark


# One reducer reads about this much of a shuffle that carries the whole input.
REDUCER_BYTES = 128 * 1024 * 1024


def shuffle_partitions_for(input_bytes: int, least: int) -> int:
    return max(least, -(-input_bytes // REDUCER_BYTES))


def size_shuffles(spark: SparkSession, *paths: str) -> int:
    """Set the session's shuffle partitions from the size of the input folders: about
    ``REDUCER_BYTES`` of input each, at least two per core. AQE coalesces them where a
    filter leaves little."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        total += at.getFileSystem(conf).getContentSummary(at).getLength()
    n = shuffle_partitions_for(total, 2 * spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def app_id(spark: SparkSession) -> str:
    """The application id (also under Spark Connect, where there is no SparkContext)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect session
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder under the cluster's shared checkpoint directory.

    The checkpoint directory named by the cluster (``spark.checkpoint.dir`` or
    ``SparkContext.setCheckpointDir``) is the only place the library writes
    intermediate or exported tables. Only when none is set and the session is a
    single-machine ``local[...]`` one (tests, local runs) is a fresh folder created
    and registered; on a cluster a missing setting is an error, since a
    machine-local folder is not visible to the other executors.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: only the session setting exists
        sc = None
    base = sc.getCheckpointDir() if sc is not None else None
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = sc.master if sc is not None else spark.conf.get("spark.master", "")
            if not master.startswith("local"):
                raise RuntimeError(
                    "set spark.checkpoint.dir (or SparkContext.setCheckpointDir) to a "
                    "folder shared by the cluster before writing tables"
                )
            base = tempfile.mkdtemp(prefix="fiscalflow-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(base)
            base = sc.getCheckpointDir() or base
    path = base.rstrip("/")
    for part in parts:
        path = f"{path}/{part}"
    if path.startswith("/") or path.startswith("file:"):
        os.makedirs(path.removeprefix("file:"), exist_ok=True)
    return path
