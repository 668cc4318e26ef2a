"""Purchase-order lists joined while sorted rows stream by.

``report.po_rollup`` lists the distinct orders of a document in an aggregation buffer,
which holds the whole list of a document. Here (document, order) pairs are
range-partitioned and sorted (a secondary sort), and each Arrow batch is cut at the
documents' borders: the orders of a run become one piece of text. A task holds one batch
at a time, however many orders a document has, and a document of very many orders is
spread over several ranges. Equal pairs fall into one range, next to each other, so the
stream drops them without a list or a set.

Defined cases: null orders are in no list; a document of only null orders has a null
text; items without a document form one group of their own, as in ``po_rollup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fiscalflow.operators.report import PO_SEPARATOR

SEPARATOR = PO_SEPARATOR


def _codes(column: pa.Array) -> np.ndarray:
    """A number per distinct value, null too: neighbours with equal numbers are equal."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def joined_runs(documents: pa.Array, orders: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """One row per run of equal documents: the document, its first order and the distinct
    orders as one text, both null if all orders are. Rows are sorted by document and
    order, nulls first."""
    document, order = _codes(documents), _codes(orders)
    new_document = np.r_[True, document[1:] != document[:-1]]
    new_pair = new_document | np.r_[True, order[1:] != order[:-1]]
    listed = new_pair & orders.is_valid().to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new_document)
    counts = np.add.reduceat(listed.astype(np.int64), starts)
    offsets = np.r_[0, np.cumsum(counts)]
    values = orders.filter(pa.array(listed)).cast(pa.large_string())
    texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), values), pa.scalar(SEPARATOR, pa.large_string()))
    some = pa.array(counts > 0)
    first = values.take(pa.array(np.where(counts > 0, offsets[:-1], 0), mask=counts == 0))
    empty = pa.scalar(None, pa.large_string())
    return documents.take(pa.array(starts)), first, pc.if_else(some, texts, empty)


def order_pieces(items: DataFrame, key: str = "tax_document_id", partitions: int | None = None) -> DataFrame:
    """``(key, first_order, purchase_orders)``: the distinct orders of a document in
    pieces of at most one Arrow batch (``spark.sql.execution.arrow.maxRecordsPerBatch``)
    each, which follow one another by ``first_order``. Reads ``items`` twice, once to
    sample the ranges. A list too long for one row may be stored as these pieces."""
    pairs = items.select(key, F.col("purchase_order").cast("string").alias("purchase_order"))
    order = [key, "purchase_order"]
    ranged = pairs.repartitionByRange(partitions, *order) if partitions else pairs.repartitionByRange(*order)
    schema = StructType([pairs.schema[key], StructField("first_order", StringType()), StructField("purchase_orders", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the pair before the batch
        for batch in batches:
            if batch.num_rows == 0:
                continue
            documents, orders = batch.columns
            skipped = 0
            if last is not None:  # the last pair may go on
                same = pc.and_(_equal(documents, last[0]), _equal(orders, last[1])).to_numpy(zero_copy_only=False)
                skipped = len(same) if same.all() else int(np.argmin(same))
            last = documents[-1], orders[-1]
            if skipped < batch.num_rows:
                columns = joined_runs(documents.slice(skipped), orders.slice(skipped))
                names = [key, "first_order", "purchase_orders"]
                yield pa.RecordBatch.from_arrays([columns[0], *(c.cast(pa.string()) for c in columns[1:])], names)

    return ranged.sortWithinPartitions(*order).mapInArrow(run, schema)


def _equal(column: pa.Array, value: pa.Scalar) -> pa.Array:
    """Whether each entry is ``value``; null is null's equal."""
    if not value.is_valid:
        return column.is_null()
    return pc.fill_null(pc.equal(column, value), False)


def po_rollup_streamed(items: DataFrame, key: str = "tax_document_id", partitions: int | None = None) -> DataFrame:
    """``report.po_rollup`` from pieces: the aggregate holds a document's text in a few
    pieces instead of a list of its orders."""
    piece = F.struct("first_order", "purchase_orders")
    pieces = F.array_sort(F.collect_list(F.when(F.col("purchase_orders").isNotNull(), piece)))
    text = F.when(F.size(pieces) > 0, F.array_join(F.transform(pieces, lambda p: p["purchase_orders"]), SEPARATOR))
    return order_pieces(items, key, partitions).groupBy(key).agg(text.alias("purchase_orders"))
