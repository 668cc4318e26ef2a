"""Documents and tasks stored for the join on their process.

Both tables are bucketed by ``process_instance_id`` into the same number of buckets, so
the join reads bucket by bucket and shuffles neither side. Nothing splits a bucket at run
time, as AQE splits a skewed shuffle partition. Rows of a process with more than
``busy_rows`` documents and tasks are therefore stored apart, in tables without buckets,
and joined by a shuffle; so are rows without a process, which meet nothing but belong to
the tables.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalflow.operators.fact import build_fact, docs_tasks_join
from fiscalflow.operators.store import materialize
from fiscalflow.session import shared_dir
from fiscalflow.sources.model import Model

PROCESS = "process_instance_id"
BUSY_ROWS = 1_000_000


def busy_processes(model: Model, busy_rows: int = BUSY_ROWS) -> DataFrame:
    """``(process_instance_id)`` of more than ``busy_rows`` documents and tasks, stored;
    there are fewer of them than rows divided by ``busy_rows``."""
    rows = model.tax_documents.select(PROCESS).unionByName(model.tasks.select(PROCESS)).filter(F.col(PROCESS).isNotNull())
    counted = rows.groupBy(PROCESS).agg(F.count(F.lit(1)).alias("rows"))
    return materialize(counted.filter(F.col("rows") > busy_rows).select(PROCESS), "busy_processes")


def _bucketed(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    """``rows`` as a bucketed table of the session's catalog, in the shared folder. Rows
    meet by bucket before the write, so that a bucket is one file, or a few if large."""
    spark, table = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    bucket = F.pmod(F.hash(PROCESS), F.lit(buckets))
    (
        rows.withColumn("_bucket", bucket).hint("rebalance", "_bucket").drop("_bucket")
        .write.format("parquet").bucketBy(buckets, PROCESS).sortBy(PROCESS)
        .option("path", shared_dir(spark, "tables", table)).saveAsTable(table)
    )
    return spark.table(table)


@dataclass(frozen=True)
class ProcessBuckets:
    """The model with its bucketed rows, and with those stored apart."""

    even: Model
    apart: Model

    @classmethod
    def store(cls, model: Model, buckets: int, busy_rows: int = BUSY_ROWS) -> ProcessBuckets:
        """Store documents and tasks. A bucket is joined by one task: give enough of them
        that each holds some hundred MB."""
        busy = busy_processes(model, busy_rows)
        even, apart = {}, {}
        for name in ("tax_documents", "tasks"):
            rows = model.table(name)
            even[name] = _bucketed(rows.filter(F.col(PROCESS).isNotNull()).join(busy, PROCESS, "left_anti").select(*rows.columns), name, buckets)
            known = rows.join(busy, PROCESS, "left_semi").select(*rows.columns)
            apart[name] = materialize(known.unionByName(rows.filter(F.col(PROCESS).isNull())), f"{name}_apart")
        return cls(model.with_tables(**even), model.with_tables(**apart))

    def table(self, name: str) -> DataFrame:
        """All rows of ``tax_documents`` or ``tasks``."""
        return self.even.table(name).unionByName(self.apart.table(name))

    def docs_tasks_join(self) -> DataFrame:
        """``fact.docs_tasks_join`` of the whole tables (columns that both have are the
        document's, then the task's)."""
        return docs_tasks_join(self.even).union(docs_tasks_join(self.apart))

    def fact(self) -> DataFrame:
        """``fact.build_fact`` of the whole tables."""
        return build_fact(self.even).unionByName(build_fact(self.apart))
