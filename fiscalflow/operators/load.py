"""Keyed loading: insert-if-absent (``INSERT .. ON CONFLICT (id) DO NOTHING``).

The source system inserts rows one at a time; the first row of a key wins and rows
whose key already exists are ignored. Here the whole batch is one job:

1. drop null keys (a primary key rejects them; ``rejected_rows`` lists them);
2. keep the first row per key in load order - ``min`` over a struct whose leading
   fields are the load-order columns. It is an ordinary aggregate, so it is
   partially aggregated on the map side: a key holding a third of the batch
   leaves every map task as a single row, not as one giant group;
3. anti-join with the target's keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from fiscalflow.session import shared_dir


def first_per_key(incoming: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """One row per non-null ``key``: the first in ``order_by`` order (ascending,
    a null load-order value first; remaining ties broken by the row's own values,
    so the result is deterministic)."""
    others = [c for c in incoming.columns if c != key]
    packed = F.struct(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)],
        F.struct(*[F.col(c) for c in others]).alias("_row"),
    )
    return (
        incoming.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(packed).alias("_first"))
        .select(key, *[F.col(f"_first._row.{c}").alias(c) for c in others])
        .select(*incoming.columns)
    )


def rejected_rows(incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows that a primary key would reject (null key)."""
    return incoming.filter(F.col(key).isNull())


def rows_to_insert(
    target: DataFrame, incoming: DataFrame, key: str, order_by: Sequence[str]
) -> DataFrame:
    """Incoming rows with a key that insert-if-absent would add to ``target``. Rows
    whose key the target has leave first, so only new keys are aggregated."""
    fresh = incoming.join(target.select(key).distinct(), key, "left_anti")
    return first_per_key(fresh.select(*incoming.columns), key, order_by)


def insert_if_absent(
    target: DataFrame, incoming: DataFrame, key: str, order_by: Sequence[str]
) -> DataFrame:
    """The target after insert-if-absent: existing rows untouched, plus new keys. Rows
    without a key are no part of it; ``rejected_rows`` has them.

    Applying it twice with the same batch gives the same result as once.
    """
    new_rows = rows_to_insert(target, incoming, key, order_by).select(*target.columns)
    return target.unionByName(new_rows)


def _existing(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    """The dataset at ``path``, or None if there is no such path; any other failure to
    read it is raised."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


REJECTED = "__rejected"


@dataclass(frozen=True)
class StagedBatch:
    """A batch written once: its rows with a key, its rows without one, and their numbers."""

    accepted: DataFrame
    rejected: DataFrame
    rows: int
    rejected_rows: int


def stage_batch(spark: SparkSession, incoming: DataFrame, key: str) -> StagedBatch:
    """Evaluate ``incoming`` once: it is written to the shared folder, split into rows with
    and without a key, and counted while it is written. What follows reads those files, so
    that a source that changes between two reads cannot be counted one way and loaded
    another. Staged batches are left to the folder's retention policy."""
    path = f"{shared_dir(spark, 'staging')}/{uuid.uuid4().hex}"
    seen = Observation()
    keyless = F.col(key).isNull()
    counted = incoming.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(keyless).alias("rejected"))
    counted.withColumn(REJECTED, keyless).write.partitionBy(REJECTED).parquet(path)
    schema = StructType([*incoming.schema.fields, StructField(REJECTED, BooleanType())])
    staged = spark.read.schema(schema).parquet(path)
    counts = seen.get
    return StagedBatch(
        staged.filter(~F.col(REJECTED)).drop(REJECTED), staged.filter(REJECTED).drop(REJECTED), counts["rows"], counts["rejected"]
    )


def set_aside(batch: StagedBatch, key: str, path: str | None, fmt: str = "parquet") -> int:
    """Write the rows without a key to ``path`` and return their number. With such rows
    and no path nothing may be loaded: ValueError, as a database fails the transaction."""
    if batch.rejected_rows:
        if path is None:
            raise ValueError(f"{batch.rejected_rows} rows without {key}")
        batch.rejected.write.mode("append").format(fmt).save(path)
    return batch.rejected_rows


def load_if_absent(
    spark: SparkSession,
    target_path: str,
    incoming: DataFrame,
    key: str,
    order_by: Sequence[str],
    fmt: str = "parquet",
    rejected_path: str | None = None,
) -> int:
    """Append the new rows of ``incoming`` to the dataset at ``target_path`` and return
    the number of rows without a key. ``incoming`` is evaluated once (``stage_batch``).

    Rows without a key are written to ``rejected_path``; if none is given and there are
    such rows, nothing is loaded and ValueError is raised.

    Only new files are added (mode append); the files being read are never
    rewritten, and the write is committed by Spark's output committer, so a lost
    executor's task is simply retried. A missing target is created. One writer
    per target at a time: two concurrent loads could both add the same new key
    (the streaming ingest serialises its batches). The target's keys are read whole;
    ``KeyedTarget`` is the layout for targets too large for that.
    """
    target = _existing(spark, target_path, fmt)
    batch = stage_batch(spark, incoming, key)
    rejected = set_aside(batch, key, rejected_path, fmt)
    if target is None:
        new_rows = first_per_key(batch.accepted, key, order_by)
    else:
        new_rows = rows_to_insert(target, batch.accepted, key, order_by).select(*target.columns)
    new_rows.write.mode("append").format(fmt).save(target_path)
    return rejected


# --- a large target -------------------------------------------------------------------

BUCKET = "key_bucket"
LAYOUT = "_layout"
POINT_KEYS = 10  # so many keys go to the scan one by one, where Bloom filters answer them


@dataclass(frozen=True)
class LoadReport:
    """What a load did: rows given, without key and added, and the target's files that
    could hold keys of the batch."""

    rows: int
    rejected: int
    added: int
    files_read: int


class KeyedTarget:
    """A table laid out for insert-if-absent: partitioned by a hash of the key, files
    sorted by key, with min/max statistics and Bloom filters on it.

    A load reads only the buckets that hold keys of the batch, and in them only row groups
    whose key range meets the batch's (for ``POINT_KEYS`` keys or fewer: whose Bloom filter
    knows one). Its cost follows the batch and the buckets it meets, not the table. The
    number of buckets is set when the table is created and stored with it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 256):
        self.spark, self.path, self.key = spark, path, key
        stored = _existing(spark, f"{path}/{LAYOUT}", "parquet")
        if stored is None:
            stored = spark.createDataFrame([(key, buckets)], "key string, buckets int").coalesce(1)
            stored.write.parquet(f"{path}/{LAYOUT}")
        layout = stored.first()
        if layout["key"] != key:
            raise ValueError(f"{path} is keyed by {layout['key']}")
        self.buckets = layout["buckets"]

    def read(self) -> DataFrame | None:
        """The table without its bucket column; None before the first load."""
        found = self._read()
        return None if found is None else found.drop(BUCKET)

    def _read(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
                return None
            raise

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def candidates(self, rows: DataFrame) -> DataFrame | None:
        """The part of the table that can hold keys of ``rows`` (with their bucket), None
        if there is none: what comes to the driver is one row per bucket and at most
        ``POINT_KEYS`` keys."""
        met = rows.groupBy(BUCKET).agg(F.min(self.key).alias("lo"), F.max(self.key).alias("hi")).collect()
        folders = [f for f in (f"{self.path}/{BUCKET}={r[BUCKET]}" for r in met) if self._exists(f)]
        if not folders:
            return None
        found = self.spark.read.option("basePath", self.path).parquet(*folders)  # no other folder is listed
        key = F.col(self.key)
        keys = [r[0] for r in rows.select(self.key).distinct().limit(POINT_KEYS + 1).collect()]
        wanted = key.isin(keys) if len(keys) <= POINT_KEYS else key.between(min(r["lo"] for r in met), max(r["hi"] for r in met))
        return found.filter(wanted)

    def _exists(self, folder: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def load(self, incoming: DataFrame, order_by: Sequence[str], rejected_path: str | None = None) -> LoadReport:
        """Insert the rows whose key is new, the first of each key in load order."""
        batch = stage_batch(self.spark, incoming, self.key)
        rejected = set_aside(batch, self.key, rejected_path)
        rows = batch.accepted.withColumn(BUCKET, self._bucket())
        candidates = self.candidates(rows)
        files = 0
        if candidates is not None:
            files = len(candidates.inputFiles())
            rows = rows.join(candidates.select(BUCKET, self.key), [BUCKET, self.key], "left_anti")
        added = Observation()
        new_rows = first_per_key(rows, self.key, order_by).observe(added, F.count(F.lit(1)).alias("rows"))
        columns = [c for c in incoming.columns if c != BUCKET]
        (
            new_rows.select(*columns, BUCKET).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, self.key)
            .write.mode("append").partitionBy(BUCKET).option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(self.path)
        )
        return LoadReport(batch.rows, rejected, added.get["rows"], files)


# --- several tables at once -----------------------------------------------------------

COMMITTED = "_committed"


def load_together(spark: SparkSession, base: str, tables: dict[str, DataFrame], batch: str) -> None:
    """Bulk insert of one batch into several tables, all or nothing.

    Each table's rows go to its own ``batch=...`` folder; the batch counts only once its
    marker is written, after the last table. A batch that failed midway is invisible to
    ``read_together`` and may be loaded again under its name; a committed one is
    refused.
    """
    if batch in committed_batches(spark, base):
        raise ValueError(f"batch {batch} is already loaded")
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")
    spark.createDataFrame([(batch,)], "name string").coalesce(1).write.mode("append").parquet(f"{base}/{COMMITTED}")


def committed_batches(spark: SparkSession, base: str) -> list[str]:
    marks = _existing(spark, f"{base}/{COMMITTED}", "parquet")
    return [] if marks is None else sorted(r["name"] for r in marks.distinct().collect())


def read_together(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The rows of one table in committed batches (only their folders are read)."""
    batches = committed_batches(spark, base)
    if not batches:
        raise ValueError(f"nothing is loaded under {base}")
    return spark.read.parquet(*[f"{base}/{name}/batch={b}" for b in batches])
