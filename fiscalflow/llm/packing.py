"""Packing: documents are concatenated and cut into fixed windows.

Pass 1 encodes the rows of each partition, numbers their tokens within the partition
and writes ids and numbers to the shared folder. The token totals of the partitions,
one row each, give each partition's place in the whole by a prefix sum. Pass 2 adds
that place, cuts every document at the window borders and returns one boundary record
per piece. Nothing is shuffled and no window needs its rows together: a piece knows
its sequence and offset by arithmetic.

The order of the documents is that of the partitions; only the last sequence has
padding. Defined cases: null text is empty and has the end id alone; repeated rows and
null or repeated doc_ids are packed row by row; an empty table has no pieces; other
columns are ignored. A document's ids are held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalflow.llm.common import batches, crc32_of, id_text, materialize, partition_bases, task_number, texts_of
from fiscalflow.llm.tokens import END_ID, WORD_BPE, encoder, with_end

WINDOW = 4096
ENCODED = "part int, doc_id long, at long, n_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids binary, ids_crc32 long, "
    "doc_tokens long, sequence_id long, offset long"
)


def encode_partitions(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int | None = END_ID) -> DataFrame:
    """Pass 1: little-endian uint32 ids of each row, and the tokens before it in its
    partition. ``part`` names the partition in the written table."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = task_number(), 0
        for batch in batches(rows, 256):
            ids, lengths = with_end(*encoder(tokenizer).encode(texts_of(batch.column(1))), end_id)
            ends = np.cumsum(lengths)
            borders = np.concatenate([[0], 4 * ends]).tolist()
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(batch.num_rows, part, np.int32)),
                    batch.column(0),
                    pa.array(before + ends - lengths),
                    pa.array(lengths),
                    pa.array([raw[a:b] for a, b in zip(borders, borders[1:])], pa.binary()),
                ],
                ["part", "doc_id", "at", "n_tokens", "ids"],
            )
            before += int(lengths.sum())

    return materialize(id_text(docs).mapInArrow(run, ENCODED), "packing-ids")


def totals_of(encoded: DataFrame) -> DataFrame:
    """Tokens of each partition: the ids themselves are not read."""
    return encoded.groupBy("part").agg(F.sum("n_tokens").alias("total"))


def cut(encoded: DataFrame, bases: dict[int, int], window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pass 2: one boundary record per piece of a document in a window."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 256):
            part, doc, at, raw = (batch.column(i) for i in range(4))
            first = at.to_numpy() + np.array([bases[p] for p in part.to_pylist()], np.int64)
            held = [np.frombuffer(x, "<u4") for x in raw.to_pylist()]
            tokens = np.fromiter(map(len, held), np.int64, len(held))
            windows = np.where(tokens > 0, (first + tokens - 1) // window - first // window + 1, 0)
            row = np.repeat(np.arange(len(held)), windows)
            order = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            sequence = first[row] // window + order
            begin = np.maximum(sequence * window, first[row])
            end = np.minimum((sequence + 1) * window, first[row] + tokens[row])
            pieces = [held[r][a:b] for r, a, b in zip(row.tolist(), (begin - first[row]).tolist(), (end - first[row]).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    doc.take(pa.array(row)),
                    pa.array(begin - first[row]),
                    pa.array(end - begin),
                    pa.array([p.tobytes() if with_ids else None for p in pieces], pa.binary()),
                    pa.array([crc32_of(p) for p in pieces], pa.int64()),
                    pa.array(tokens[row]),
                    pa.array(sequence),
                    pa.array(begin - sequence * window),
                ],
                ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return encoded.select("part", "doc_id", "at", "ids").mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, window: int = WINDOW, tokenizer: str = WORD_BPE, end_id: int | None = END_ID, with_ids: bool = True
) -> DataFrame:
    """Pieces of all rows of ``docs`` in windows of ``window`` tokens: ``doc_id``,
    ``start`` and ``length`` within the document, ``ids`` (null without ``with_ids``)
    and their crc32, ``doc_tokens``, ``sequence_id`` and the ``offset`` in it."""
    encoded = encode_partitions(docs, tokenizer, end_id)
    return cut(encoded, partition_bases(totals_of(encoded)), window, with_ids)
