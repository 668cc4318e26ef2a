"""Materialised tables in the cluster's shared folder.

Written tables cut lineage (the fact's joins and aggregates are not recomputed for
every panel) and survive executor loss, unlike cached blocks. They live under the
session's checkpoint directory (``shared_dir``), never in a machine-local folder.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fiscalflow.session import shared_dir

DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # the folder of a null partition value


def materialize(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    sort_within: Sequence[str] = (),
    spark: SparkSession | None = None,
) -> DataFrame:
    """Write ``df`` as parquet under ``<shared>/tables/<name>/<version>`` and return
    the table read back."""
    spark = spark or df.sparkSession
    path = store(df, name, partition_by, sort_within, spark)
    return read_stored(spark, path, df.schema, partition_by)


def store(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    sort_within: Sequence[str] = (),
    spark: SparkSession | None = None,
) -> str:
    """Write ``df`` as a new version of the table ``name`` and return its path.

    With partition columns, rows are range-partitioned on (partition columns,
    ``sort_within``) before the write: the ranges are balanced by sampling, so a
    large partition value (a busy month) is split over many tasks instead of one,
    while each task still covers a contiguous range and writes into few partition
    folders. ``sort_within`` orders rows inside files so min/max statistics prune
    row groups."""
    spark = spark or df.sparkSession
    # A new version folder per call: a failed write never destroys the previous
    # version, and readers of the previous version keep their files. Old versions
    # are left for the caller's retention policy.
    version = f"v{time.strftime('%Y%m%d%H%M%S')}-{uuid.uuid4().hex[:8]}"
    path = f"{shared_dir(spark, 'tables', name)}/{version}"
    writer = laid_out(df, partition_by, sort_within).write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def laid_out(df: DataFrame, partition_by: Sequence[str], sort_within: Sequence[str]) -> DataFrame:
    """The rows as ``store`` writes them."""
    if partition_by:
        df = df.repartitionByRange(*partition_by, *sort_within)
    return df.sortWithinPartitions(*partition_by, *sort_within) if partition_by or sort_within else df


def read_stored(spark: SparkSession, path: str, schema: StructType, partition_by: Sequence[str] = ()) -> DataFrame:
    reader = spark.read
    if partition_by:
        # keep partition values as written (no type inference of 'yyyy-MM')
        reader = reader.schema(schema)
    return reader.parquet(path)


def replace_partitions(rows: DataFrame, path: str, partition_by: str, emptied: Sequence[str | None], sort_within: Sequence[str] = ()) -> None:
    """Overwrite the partitions of the table at ``path`` that ``rows``, a stored table,
    holds, and delete those in ``emptied``. All other partitions keep their files.

    Each partition is replaced when the job commits. A run that fails may be repeated with
    the same rows."""
    spark = rows.sparkSession
    (
        laid_out(rows, [partition_by], sort_within).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)
    )
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for value in emptied:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{partition_by}={DEFAULT_PARTITION if value is None else value}")
        folder.getFileSystem(conf).delete(folder, True)
