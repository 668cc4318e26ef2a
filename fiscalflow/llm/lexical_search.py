"""Ranked lexical search, reversed: the documents stream past an index of the items.

The items' terms form an inverted index, term -> (item, occurrences). One pass over the
documents counts their terms and stores the counts of the terms that some item holds,
with the document's length; from that table come the corpus statistics (documents,
length, document frequency of each indexed term). A second pass streams the stored
counts through the broadcast index and updates one heap of at most ``k`` documents per
item; the heaps of all tasks are merged per item.

Size bounds: the index holds at most ``BLOCK_POSTINGS`` postings. More items are searched
in blocks of items, each block with its own index and passes, so that what is broadcast
does not grow. A task's heaps hold ``k`` documents per item of the block, and so many
rows per task reach the merge. No statistic and no document is left out.

Scores are integers and equal scores go to the smaller doc_id, so the result does not
depend on the partitions.

Defined cases: null text has no terms; a document without terms does not count as one;
documents without doc_id count in the statistics and are not ranked; rows that repeat a
doc_id are documents of their own; rows that share an item_id are one item with all their
terms; items without item_id, without terms or without a document above 0 give no row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscalflow.llm.common import batches, id_text, materialize, ragged, raw_texts

K = 10
BLOCK_POSTINGS = 200_000
LENGTH_SHARE = 75  # of 100: how much a document's length counts
SCORE_CELLS = 1 << 21  # (documents, items) scored at a time
POSTING_CELLS = 1 << 22  # postings that the documents scored together can meet
BATCH_ROWS = 2048
# Separators (the ASCII characters that are neither letters nor digits) become spaces,
# A-Z lower case; bytes of other characters stay.
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
FOLD = bytes.maketrans(
    SEPARATORS + bytes(range(ord("A"), ord("Z") + 1)), b" " * len(SEPARATORS) + bytes(range(ord("a"), ord("z") + 1))
)

COUNTS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item_id long, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of one UTF-8 text."""
    return text.translate(FOLD).split()


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


# --- items ------------------------------------------------------------------------------

def item_blocks(items: DataFrame, block_postings: int) -> Iterator[dict[int, Counter]]:
    """The items' term counts in blocks of at most ``block_postings`` postings (or one
    item), read one after the other from the ordered items."""
    rows = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    block: dict[int, Counter] = {}
    postings = 0
    for row in rows.filter("item_id is not null").orderBy("item_id").toLocalIterator():
        found = Counter(terms_of((row["text"] or "").encode()))
        if row["item_id"] not in block and block and postings + len(found) > block_postings:
            yield block
            block, postings = {}, 0
        block.setdefault(row["item_id"], Counter()).update(found)
        postings += len(found)
    if block:
        yield block


class Index:
    """Postings of a block: term number t is in items ``items[starts[t]:starts[t + 1]]``
    (places in ``ids``), ``times`` times each."""

    def __init__(self, block: dict[int, Counter]):
        self.ids = np.array(sorted(block), np.int64)
        self.numbers: dict[bytes, int] = {}
        by_term: list[list[tuple[int, int]]] = []
        for place, item in enumerate(self.ids.tolist()):
            for term, times in block[item].items():
                number = self.numbers.setdefault(term, len(by_term))
                if number == len(by_term):
                    by_term.append([])
                by_term[number].append((place, times))
        sizes = np.array([len(p) for p in by_term], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = np.array([x for p in by_term for x in p], np.int64).reshape(-1, 2)
        self.items, self.times = flat[:, 0], flat[:, 1]


# --- documents --------------------------------------------------------------------------

def term_counts(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Per document with a term: its length in terms, and the numbers and counts of the
    terms that the index holds."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches(rows, BATCH_ROWS):
            keep, lengths, terms, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(raw_texts(batch.column(1))):
                words = terms_of(text)
                if not words:
                    continue
                keep.append(i)
                lengths.append(len(words))
                counted = Counter(words)
                for term in counted.keys() & known.keys():
                    terms.append(known[term])
                    tfs.append(counted[term])
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    return id_text(docs).mapInArrow(run, COUNTS)


def statistics(counts: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms with repeats, and the document frequency of each indexed term
    (one number per term of the block)."""
    total = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).first()
    df = np.zeros(n_terms, np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    return total["n"], total["terms"] or 0, df


class Heaps:
    """The ``k`` best documents of each item; a document is ``(score, -doc_id)``."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # scores above it, or equal with a smaller id, enter
        self.last = np.full(items, np.iinfo(np.int64).min)  # the id that an equal score must be below

    def update(self, scores: np.ndarray, ids: np.ndarray) -> None:
        enters = (scores > self.least) | ((scores == self.least) & (ids[:, None] < self.last))
        for doc, item in zip(*(x.tolist() for x in np.nonzero(enters))):
            heap, entry = self.best[item], (int(scores[doc, item]), -int(ids[doc]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item], self.last[item] = heap[0][0], -heap[0][1]


def document_scores(index: Index, weights: np.ndarray, documents: int, length: int, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
    """Scores of documents (rows) for the items of the index, in 64-bit integers."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // length
    row = np.repeat(np.arange(len(n)), sizes)
    cell = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[row]))
    spread = index.starts[terms + 1] - index.starts[terms]
    at = ragged(index.starts[terms], spread)
    scores = np.zeros(len(n) * len(index.ids), np.int64)
    np.add.at(scores, np.repeat(row, spread) * len(index.ids) + index.items[at], np.repeat(cell, spread) * index.times[at])
    return scores.reshape(len(n), -1)


def best_of_block(spark: SparkSession, docs: DataFrame, block: dict[int, Counter], k: int) -> DataFrame:
    """``(item_id, doc_id, score)``: each task's best documents of each item."""
    index = Index(block)
    counts = materialize(term_counts(docs, index.numbers), "lexical-counts")
    documents, length, df = statistics(counts, len(index.numbers))
    weights = np.array([term_weight(documents, int(x)) for x in df], np.int64)
    held = spark.sparkContext.broadcast((index, weights))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = held.value
        heaps = Heaps(len(index.ids), k)
        together = max(1, min(SCORE_CELLS // len(index.ids), POSTING_CELLS // max(1, len(index.items))))
        for batch in batches(rows, together):
            terms = batch.column(2)
            sizes = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            scores = document_scores(
                index, weights, documents, length, batch.column(1).to_numpy(), sizes,
                terms.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy().astype(np.int64),
            )
            heaps.update(scores, batch.column(0).to_numpy())
        rows_out = [(int(index.ids[i]), -less, score) for i, heap in enumerate(heaps.best) for score, less in heap]
        columns = list(zip(*rows_out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return counts.filter("doc_id is not null").mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of ``docs`` (``doc_id``,
    ``text``) for each row of ``items`` (``item_id``, ``text``)."""
    spark = docs.sparkSession
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    found = None
    for block in item_blocks(items, block_postings):
        part = best_of_block(spark, docs, block, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
