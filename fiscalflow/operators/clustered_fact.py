"""The fact stored in the order of a bit-interleaved key of its filter columns.

A table sorted by one column lets a scan skip row groups for filters on that column
only. Here every filter column (day, type, task, status, state) gives a rank of a few
bits, and the ranks' bits in turn, highest first, make one key. Rows near in the key are
near in every column, so the min/max statistics of a row group are narrow in all of them
and a filter on any one column, or several, skips row groups.

Ranks are places between bounds: for days even quantiles, for texts the most frequent
values, so that a frequent value stands alone. Bounds come from one aggregate of one row
(both are sketches of bounded size) and decide the layout only, never a result. Null has
a rank of its own, before all.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalflow.operators import filters
from fiscalflow.operators.filters import FilterSpec
from fiscalflow.operators.store import materialize
from fiscalflow.session import shared_dir

DAY = "posted_on"
TEXTS = ("document_type", "task_name", "task_status", "supplier_state")
BITS = 6  # of a rank at most
ACCURACY = 10_000  # of the day quantiles
KEY = "_cluster_key"
ROW_GROUP_BYTES = 128 * 1024 * 1024
FILE_BYTES = 128 * 1024 * 1024  # stored; the task that sorts a file reads about twice that


def bounds_of(fact: DataFrame, bits: int = BITS) -> dict[str, list]:
    """Ascending bounds per filter column, fewer than ``2 ** bits`` each."""
    most = 2**bits - 2  # one rank before the first bound, one for null
    days = F.percentile_approx(F.unix_date(DAY), [(i + 1) / (most + 1) for i in range(most)], ACCURACY).alias(DAY)
    texts = [F.expr(f"approx_top_k({c}, {most}) filter (where {c} is not null)").alias(c) for c in TEXTS]
    row = fact.agg(days, *texts).first()
    found = {DAY: sorted(set(row[DAY] or []))}
    return found | {c: sorted((x["item"] for x in row[c] or []), key=lambda v: v.encode()) for c in TEXTS}


def place(value: Column, bounds: Sequence) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, by halving."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(bounds[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))

    return between(0, len(bounds))


def interleaved(ranks: Sequence[tuple[Column, int]]) -> Column:
    """One long of the bits of ``ranks`` (a column and its number of bits), the highest
    bit of each first; a rank without bits left is passed over."""
    taken = [(rank, bits - 1 - level) for level in range(max((b for _, b in ranks), default=0)) for rank, bits in ranks if level < bits]
    key = F.lit(0).cast("long")
    for i, (rank, bit) in enumerate(taken):
        one = F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long")
        key = key.bitwiseOR(F.shiftleft(one, len(taken) - 1 - i))
    return key


def files_for(stored_bytes: int) -> int:
    """Files, each sorted by one task, for a table of ``stored_bytes``."""
    return max(1, -(-stored_bytes // FILE_BYTES))


def cluster_key(bounds: dict[str, list]) -> Column:
    """The key of a row of the fact. At most 5 x 6 bits of a long."""
    ranks = []
    for column, cuts in bounds.items():
        value = F.unix_date(column) if column == DAY else F.col(column)
        rank = F.when(value.isNull(), F.lit(0)).otherwise(place(value, cuts) + 1)
        ranks.append((rank, (len(cuts) + 1).bit_length()))
    return interleaved(ranks)


@dataclass(frozen=True)
class ClusteredFact:
    """The stored fact and selections of it."""

    fact: DataFrame
    path: str
    bounds: dict[str, list]

    @classmethod
    def store(
        cls, fact: DataFrame, name: str = "clustered_fact", files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, bits: int = BITS,
    ) -> ClusteredFact:
        """Store ``fact`` (the columns of ``build_fact``, more may follow) by its key.

        The fact runs once: its rows are written as they come, and bounds, range bounds
        and the sort read that table. Ranges are of (key, completion, id), so a cell of
        the key that holds a third of all rows is split over files. ``files`` follows
        the bytes of that table unless given."""
        spark = fact.sparkSession
        rows = materialize(fact, f"{name}_unsorted")
        bounds = bounds_of(rows, bits)
        if files is None:
            files = files_for(int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        path = f"{shared_dir(spark, 'tables', name)}/v{time.strftime('%Y%m%d%H%M%S')}-{uuid.uuid4().hex[:8]}"
        made = cls(rows, path, bounds)
        made._write(rows, files, row_group_bytes)
        return cls(spark.read.schema(rows.schema).parquet(path), path, bounds)

    def append(self, rows: DataFrame, files: int = 1, row_group_bytes: int = ROW_GROUP_BYTES) -> ClusteredFact:
        """Add later rows in files of their own, laid out by the bounds of the first: any
        bounds give right results, and stale ones only wider row groups."""
        self._write(materialize(rows.select(*self.fact.columns), "clustered_fact_added"), files, row_group_bytes)
        return ClusteredFact(rows.sparkSession.read.schema(self.fact.schema).parquet(self.path), self.path, self.bounds)

    def _write(self, rows: DataFrame, files: int, row_group_bytes: int) -> None:
        order = [KEY, "completed_at", "id"]
        (
            rows.withColumn(KEY, cluster_key(self.bounds)).repartitionByRange(files, *order).sortWithinPartitions(*order).drop(KEY)
            .write.mode("append").option("parquet.block.size", row_group_bytes).parquet(self.path)
        )

    def select(self, spec: FilterSpec) -> DataFrame:
        """``filters.apply_filters`` on the stored rows: each conjunct reaches the scan
        and skips row groups. The period is asked of the day too: Parquet compares dates
        with its statistics, but not zone-less timestamps."""
        return filters.apply_filters(self.fact.filter(filters.day_predicate(spec.period)), spec)


def rows_scanned(selection: DataFrame) -> int:
    """Rows that the scan below a selection without a shuffle reads when it runs: those
    of the row groups that statistics do not rule out."""
    execution = selection._jdf.queryExecution()
    execution.toRdd().count()
    node = execution.executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()
