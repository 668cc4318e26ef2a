"""Keyed insert-if-absent as a stream of file batches.

New files landing in ``source_dir`` are read as micro-batches; each batch is
applied to the target dataset with insert-if-absent (first row per key wins, existing
keys are skipped, rows without a key go to ``rejected_path`` - or fail the batch if
none is given). ``foreachBatch`` plus the checkpoint
gives exactly-once progress tracking, and the batch function itself is idempotent
(a replayed batch finds its keys already present), so a restart after a lost
executor or driver never duplicates rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fiscalflow.operators.load import load_if_absent


def start_keyed_ingest(
    spark: SparkSession,
    source_dir: str,
    schema: StructType,
    target_path: str,
    key: str,
    order_by: Sequence[str],
    checkpoint_location: str,
    fmt: str = "parquet",
    available_now: bool = True,
    processing_time: str = "1 minute",
    max_files_per_trigger: int | None = None,
    rejected_path: str | None = None,
) -> StreamingQuery:
    """Start the ingest stream; ``available_now`` processes what is there and stops."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(source_dir)

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        load_if_absent(batch.sparkSession, target_path, batch, key, order_by, fmt, rejected_path)

    writer = stream.writeStream.foreachBatch(apply_batch).option(
        "checkpointLocation", checkpoint_location
    )
    writer = (
        writer.trigger(availableNow=True)
        if available_now
        else writer.trigger(processingTime=processing_time)
    )
    return writer.start()
