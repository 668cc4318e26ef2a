"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions.

A sketch is the ascending array of the ``K`` smallest distinct hashes (48 bits of an
XXH64 chained over the shingle's words) of a text's shingles of five words. Words are
what white space separates, as written; a text of fewer words is one shingle, one without
words has an empty sketch. A sketch with fewer than ``K`` hashes holds all of them.

The sketch of a union is the ``K`` smallest of its parts' hashes, so sketches of parts
(files, sources, days) merge without the texts: ``merged`` for two, ``merged_by`` for
groups, where each task keeps ``K`` hashes per group before the shuffle.

Two sketches know all shingles up to the smaller of their largest hashes (a sketch that is
not full: all of them). Over those, resemblance is the share of the union that both hold,
containment the share of one that the other holds; the distinct count follows from the
k-th smallest hash. For sets that fit into the sketches all three are exact.

``against_edited`` compares each document with its edited text, in which the first half of
the next document replaces the last half, and with the next document. The order of the
ids is made from the ids alone (range partitions with one boundary row each); every text
then crosses the shuffle once and half a text once more, to its predecessor.

Defined cases: null text is empty; equal texts have equal sketches; two texts without
words resemble each other fully, one with and one without not at all; rows that repeat a
doc_id share the next document, which is the one of the next greater doc_id (of rows that
repeat it the text with the smallest XXH64); after the greatest comes the smallest, so
that a single document follows itself; a row without doc_id has no next document: its
edited text is its first half and its ``next_sketch`` null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from fiscalflow.llm.common import materialize

K = 128
SHINGLE_WORDS = 5
HASH_BITS = 48
SPACE = " \t\n\x0b\x0c\r"
NO_HASHES = "array<bigint>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t-\r]+"))


def shingle_hashes(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Hashes of the shingles, with repeats, in the order of the text."""

    def of_words(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.size(w) - (shingle_words - 1))
        each = F.transform(starts, lambda x, i: _short(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, shingle_words)])))
        whole = F.when(F.size(w) > 0, F.array(_short(F.xxhash64(w)))).otherwise(F.array().cast(NO_HASHES))
        return F.when(F.size(w) >= shingle_words, each).otherwise(whole)

    return let(words(text), of_words)


def _short(digest: Column) -> Column:
    return F.shiftrightunsigned(digest, 64 - HASH_BITS)


def bottom(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct hashes, ascending."""
    return F.slice(F.array_distinct(F.sort_array(hashes)), 1, k)


def sketch(text: Column, k: int = K, shingle_words: int = SHINGLE_WORDS) -> Column:
    return bottom(shingle_hashes(text, shingle_words), k)


# --- what sketches tell -------------------------------------------------------------------

def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return bottom(F.concat(a, b), k)


def merged_by(rows: DataFrame, *keys: str, sketch_column: str = "sketch", k: int = K) -> DataFrame:
    """``(*keys, sketch)``: the sketch of the union of each group of ``rows``. A group
    without any hash gets an empty sketch."""
    hashes = rows.select(*keys, F.explode_outer(sketch_column).alias("__hash")).groupBy(*keys, "__hash").agg(F.lit(1).alias("__seen"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("__hash")))
    least = hashes.withColumn("__place", place).filter(F.col("__place") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias("sketch"))  # at most k each


def _known(a: Column, b: Column, k: int) -> Column:
    """The hash up to which both sketches are complete."""
    most = F.lit(1 << HASH_BITS)
    last = lambda s: F.when(F.size(s) >= k, F.element_at(s, -1)).otherwise(most)
    return F.least(last(a), last(b))


def _upto(hashes: Column, limit: Column) -> Column:
    return F.size(F.filter(hashes, lambda x: x <= limit))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the two texts' distinct shingles that both hold; null for null."""
    union = _upto(F.array_union(a, b), _known(a, b, k))
    both = _upto(F.array_intersect(a, b), _known(a, b, k))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(union == 0, 1.0).otherwise(both / union)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s distinct shingles that ``b`` holds; 1 for none."""
    mine = _upto(a, _known(a, b, k))
    both = _upto(F.array_intersect(a, b), _known(a, b, k))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) == 0, 1.0).when(mine == 0, 0.0).otherwise(both / mine)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    full = (k - 1) * float(1 << HASH_BITS) / (F.element_at(s, -1) + 1)
    return F.when(F.size(s) >= k, full).otherwise(F.size(s).cast("double"))


def text_of(s: Column) -> Column:
    """The sketch as text: base64 of six bytes per hash, on one line."""
    digits = F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), HASH_BITS // 4, "0")), "")
    return F.replace(F.base64(F.unhex(digits)), F.lit("\r\n"), F.lit(""))


def from_text(text: Column) -> Column:
    """The sketch that ``text_of`` wrote."""
    digits = F.hex(F.unbase64(text))
    size = F.length(digits) / (HASH_BITS // 4)
    at = F.sequence(F.lit(0), F.greatest(size.cast("int") - 1, F.lit(0)))
    each = F.transform(at, lambda i: F.conv(F.substring(digits, i * (HASH_BITS // 4) + 1, F.lit(HASH_BITS // 4)), 16, 10).cast("long"))
    return F.when(digits == "", F.array().cast(NO_HASHES)).otherwise(each)


# --- documents ------------------------------------------------------------------------------

def rows_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` without nulls in ``text``. A doc_id that is a long already gets no
    alias: joins of the rows with themselves then recognise, and reuse, their shuffle."""
    doc_id = docs["doc_id"] if docs.schema["doc_id"].dataType == LongType() else docs["doc_id"].cast("long").alias("doc_id")
    return docs.select(doc_id, F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """``(doc_id, n_chars, sketch)`` of every row."""
    return rows_of(docs).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), sketch(F.col("text"), k).alias("sketch"))


def predecessors(rows: DataFrame) -> DataFrame:
    """``(id, before, half, chosen, n)`` for each distinct doc_id: the doc_id before it
    (before the smallest: the greatest), half the characters of that one's longest text,
    the hash of the id's chosen text, and its number of rows.

    Ids are sorted by range partitions, stored with their partition; the first id of a
    partition meets the last of an earlier one through a table of one row per partition."""
    half = F.floor(F.char_length("text") / 2).cast("long")
    ids = rows.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(half).alias("half"), F.min(F.xxhash64("text")).alias("chosen"), F.count(F.lit(1)).alias("n")
    )
    placed = materialize(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "fingerprint-ids")
    ends = placed.groupBy("part").agg(F.max("id").alias("last_id"), F.max_by("half", "id").alias("last_half"))  # a row per partition
    by_part, all_parts = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = ends.select(
        "part",
        F.coalesce(F.lag("last_id").over(by_part), F.last("last_id").over(all_parts)).alias("border_id"),
        F.coalesce(F.lag("last_half").over(by_part), F.last("last_half").over(all_parts)).alias("border_half"),
    )
    within = Window.partitionBy("part").orderBy("id")
    before = placed.withColumns({"before": F.lag("id").over(within), "before_half": F.lag("half").over(within)}).join(F.broadcast(borders), "part")
    return before.select(
        "id", F.coalesce("before", "border_id").alias("before"),
        F.when(F.col("before").isNull(), F.col("border_half")).otherwise(F.col("before_half")).alias("half"), "chosen", "n",
    )


def next_heads(rows: DataFrame, k: int = K) -> DataFrame:
    """``(before, head, next_sketch)``: for each doc_id what the next document gives it,
    the head of its text and its sketch."""
    order = materialize(predecessors(rows), "fingerprint-order")
    # not an equality of both sides: the texts are dealt by doc_id alone, as they are for
    # the join that follows, so that both read one shuffle
    chosen = F.xxhash64("text").bitwiseXOR(F.col("chosen")) == 0
    found = rows.filter("doc_id is not null").join(order, (F.col("doc_id") == F.col("id")) & chosen)
    heads = found.select("before", F.substring("text", F.lit(1), F.col("half").cast("int")).alias("head"), sketch(F.col("text"), k).alias("next_sketch"), "n")
    if order.filter("n > 1").isEmpty():
        return heads.drop("n")
    once = heads.filter("n > 1").drop("n").dropDuplicates(["before"])  # equal rows: the chosen text's copies
    return heads.filter("n = 1").drop("n").unionByName(once)


def against_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch)`` of every row."""
    rows = rows_of(docs)
    followed = rows.filter("doc_id is not null").join(next_heads(rows, k), F.col("doc_id") == F.col("before"))
    alone = rows.filter("doc_id is null").withColumns({"head": F.lit(""), "next_sketch": F.lit(None).cast(NO_HASHES)})
    both = followed.select("doc_id", "text", "head", "next_sketch").unionByName(alone)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("head", F.lit(1), half))
    return (
        both.withColumn("n_chars", F.char_length("text"))
        .withColumn("edited", edited)
        .select(
            "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            sketch(F.col("text"), k).alias("sketch"), sketch(F.col("edited"), k).alias("edited_sketch"), "next_sketch",
        )
    )
