"""Token ids as ORC files: written in order of doc_id, read back by stripe.

The rows are range-partitioned and sorted by doc_id, encoded in place and written as
one ORC file per partition: ids in integer run-length encoding, a row index every
``ROW_INDEX`` rows and a Bloom filter on doc_id, so that a reader of some ids opens
only the stripes and row groups that can hold them, and readers share a file by
stripes. ``part`` and ``at`` (tokens before the row in its file) are columns; with one
token total per file they give each document's place in the whole, read from the files.

Skew and ties: rows are ranged by (doc_id, hash of the text), so that a doc_id that
many rows repeat is spread over files; rows equal in both are the same row. Null
doc_ids come first, null text is empty and has the end id alone, an empty table gives
files without rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalflow.llm.common import batches, crc32_of, fresh_path, id_text, partition_bases, range_partitions, task_number, texts_of
from fiscalflow.llm.tokens import END_ID, WORD_BPE, encoder, with_end

SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"
STRIPE_BYTES = 64 * 1024 * 1024
ROW_INDEX = 1000
BLOOM_FPP = 0.01


def ordered(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` ranged and sorted by doc_id, in partitions sized by the input's
    bytes; equal doc_ids by text hash."""
    keyed = id_text(docs).withColumn("tie", F.xxhash64("text"))
    return keyed.repartitionByRange(range_partitions(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")


def encode_rows(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int | None = END_ID) -> DataFrame:
    """Rows of the file format from rows in their final order."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = task_number(), 0
        for batch in batches(rows, 256):
            ids, lengths = with_end(*encoder(tokenizer).encode(texts_of(batch.column(1))), end_id)
            ends = np.cumsum(lengths)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(batch.num_rows, part, np.int32)),
                    pa.array(before + ends - lengths),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
                ],
                ["doc_id", "part", "at", "n_tokens", "ids"],
            )
            before += int(lengths.sum())

    return docs.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int | None = END_ID) -> str:
    """Encode ``docs`` and write them under ``path`` in ascending doc_id order."""
    rows = encode_rows(ordered(docs), tokenizer, end_id)
    (
        rows.write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(path)
    )
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, with ``start``: the tokens of all documents before the row."""
    rows = spark.read.schema(SCHEMA).orc(path)
    bases = partition_bases(rows.groupBy("part").agg(F.sum("n_tokens").alias("total")))
    return rows.withColumn("start", F.col("at") + _base(F.col("part"), bases))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents: min/max and Bloom filters skip the other stripes."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id").isin(doc_ids))


def _base(part, bases: dict[int, int]):
    """The place of each file, by position in an array of one number per file."""
    if not bases:
        return F.lit(0).cast("long")
    held = F.lit([bases.get(p, 0) for p in range(max(bases) + 1)]).cast("array<long>")
    return F.get(held, part)


def digests(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from rows that were read."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 512):
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            lengths = np.fromiter((len(x) for x in lists), np.int64, len(lists))
            ends = np.cumsum(lengths)
            crc = [crc32_of(flat[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "start", "ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def write_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and digest what they hold."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-ids")
    return digests(read(spark, write(docs, path)))
