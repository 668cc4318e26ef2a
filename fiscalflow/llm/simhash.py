"""SimHash near-duplicates: 64-bit fingerprints compared as bit planes.

A fingerprint bit is the majority of that bit over the XXH64 values of the word
shingles. Pairs within the radius are found in buckets: the 64 bits are cut into
radius + 2 blocks, and for each choice of two blocks the fingerprints that agree on
both share a bucket; a pair that differs in at most ``radius`` bits leaves at least
two blocks untouched, so no link is missed. Within a bucket the fingerprints are
stored as vertical bit planes; one XOR per plane updates the distances of 64
fingerprints at once in carry-save counters, and a block of comparisons is abandoned
once every counter exceeds the radius.

Skew: equal fingerprints are one row (a minimum per fingerprint, combined before the
shuffle). A bucket of more than ``TILE`` fingerprints is dealt over tiles and
compared tile against tile, each pair of tiles a unit of work of its own; a unit
returns a spanning forest of its links, never all pairs.

Defined cases: null text is empty; a text without words has fingerprint zero; a row
without doc_id has a fingerprint, takes no part in links and has no component; rows
that repeat a doc_id each get a row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscalflow.llm.common import BROADCAST_IDS, batches, components, id_text, materialize, raw_texts

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BITS = 64
TILE = 2048
BLOCK_ROWS = 2048
QUERY_ROWS = 256
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [
            digest(line[a:b], SEED)
            for a, b in zip(starts[: len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist())
        ]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of ``hashes``."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):  # 4 MB of unpacked bits at a time
        part = np.ascontiguousarray(hashes[at : at + 65536]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""
    return fingerprints_with(id_text(docs).withColumn("digest", F.lit(0).cast("long")), shingle_words).select("doc_id", "fp")


def fingerprints_with(rows: DataFrame, shingle_words: int) -> DataFrame:
    """``(doc_id, fp, digest)`` of every row of ``(doc_id, text, digest)``."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_in, 512):
            fps = np.array([fingerprint(t, shingle_words) for t in raw_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "digest"])

    return rows.mapInArrow(run, "doc_id long, fp long, digest long")


def block_pairs(radius: int) -> list[tuple[int, int]]:
    """Bit masks of the tables: each choice of two of ``radius + 2`` blocks."""
    cuts = np.linspace(0, BITS, radius + 3).astype(int).tolist()
    masks = [((1 << hi) - (1 << lo)) for lo, hi in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(masks, 2)]


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 x W words: word w of plane b holds bit b of fingerprints 64w .. 64w + 63."""
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[: len(fps)] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within_radius(queries: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Bit matrix, one row per query: bit j says that ``fps[j]`` is within ``radius``."""
    planes = bit_planes(fps)
    words = planes.shape[1]
    valid = np.full(words, FULL)
    if len(fps) % 64:
        valid[-1] = np.uint64((1 << (len(fps) % 64)) - 1)
    width = radius.bit_length()
    found = np.zeros((len(queries), words), np.uint64)
    for at in range(0, len(queries), QUERY_ROWS):
        q = queries[at : at + QUERY_ROWS]
        row = np.arange(len(q))
        column = np.arange(words)
        counters = [np.zeros((len(q), words), np.uint64) for _ in range(width)]
        over = np.zeros((len(q), words), np.uint64)
        over |= ~valid
        for b in range(BITS):
            ask = np.uint64(0) - ((q[row] >> np.uint64(b)) & np.uint64(1))
            carry = planes[b, column][None, :] ^ ask[:, None]
            for counter in counters:
                up = counter & carry
                counter ^= carry
                carry = up
            over |= carry
            if b % 8 == 7 and b < BITS - 1:
                beyond = _beyond(counters, over, radius) == FULL
                rows_left, columns_left = ~beyond.all(axis=1), ~beyond.all(axis=0)
                if not rows_left.any():
                    row = row[:0]
                    break
                if rows_left.mean() < 0.7 or columns_left.mean() < 0.7:
                    keep = np.ix_(rows_left, columns_left)
                    counters, over = [c[keep] for c in counters], over[keep]
                    row, column = row[rows_left], column[columns_left]
        if len(row):
            found[np.ix_(at + row, column)] = ~_beyond(counters, over, radius)
    return found


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``, compared from the highest bit down."""
    more, same = over.copy(), np.full_like(over, FULL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def spanning_forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions ``(a, b)`` of edges that connect what the links of ``fps`` connect."""
    linked = within_radius(fps, fps, radius)
    several = np.flatnonzero(np.bitwise_count(linked).sum(axis=1) > 1)
    edges: list[tuple[int, int]] = []
    todo = np.zeros(linked.shape[1] * 64, np.uint8)
    todo[several] = 1
    todo = np.packbits(todo, bitorder="little").view("<u8")
    for first in several.tolist():
        if not int(todo[first >> 6]) >> (first & 63) & 1:
            continue
        front = [first]
        todo[first >> 6] &= ~np.uint64(1 << (first & 63))
        while front:
            at = front.pop()
            new = linked[at] & todo
            todo &= ~new
            reached = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little")).tolist()
            edges += [(at, x) for x in reached]
            front += reached
    return edges


def _links(rows: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted ``(unit, fp, node)`` rows. Whole units are compared together up
    to ``BLOCK_ROWS``: a link between units is a link too."""

    def compared(fps: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        edges = spanning_forest(fps, radius) if len(fps) > 1 else []
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in rows:
        held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
        unit = held[0]
        bounds = np.flatnonzero(np.diff(unit)) + 1  # the last unit may go on in the next batch
        at = 0
        while True:
            fits = bounds[(bounds > at) & (bounds <= at + BLOCK_ROWS)]
            later = bounds[bounds > at]
            if not len(later) or (len(later) == len(fits) and len(unit) - at < BLOCK_ROWS):
                break
            end = int(fits[-1]) if len(fits) else int(later[0])
            yield compared(held[1][at:end].view(np.uint64), held[2][at:end])
            at = end
        held = [h[at:] for h in held]
    if len(held[0]):
        yield compared(held[1].view(np.uint64), held[2])


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` that connect the rows of ``nodes(fp, node)`` (distinct ``fp``)
    within ``radius`` bits."""
    masks = block_pairs(radius)
    key = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]))
    keyed = nodes.select(key.alias("key"), "fp", "node")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles.cast("long")).cast("int")
    units = keyed.join(sizes, "key").withColumns({"tiles": tiles, "own": own}).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    )
    unit = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = units.select(unit.alias("unit"), "fp", "node")
    return (
        dealt.repartition("unit").sortWithinPartitions("unit")
        .mapInArrow(lambda rows: _links(rows, radius), "a long, b long")
    )


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row: the smallest doc_id that links of at
    most ``radius`` differing bits reach."""
    found = materialize(fingerprints(docs, shingle_words), "simhash-fps")
    return found.join(component_of(found, radius), F.col("fp") == F.col("of_fp"), "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def component_of(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(of_fp, root, component_id)`` for each fingerprint of ``found(doc_id, fp)`` that
    has a doc_id: the smallest fingerprint of its component (as a signed long) and the
    component's smallest doc_id. The nodes of the graph are fingerprints, which are unlike
    doc_ids never shared by two texts that nothing links."""
    nodes = materialize(
        found.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes"
    )
    reached = components(links(nodes.select("fp", F.col("fp").alias("node")), radius), "simhash-components")
    rooted = materialize(
        nodes.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "simhash-roots"
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select(F.col("fp").alias("of_fp"), "root").join(least, "root").select("of_fp", "root", "component_id")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, all columns as they were: the row of its
    smallest doc_id, of rows that share it the one with the smallest fingerprint (as a
    signed long), then XXH64 of its text. Rows without doc_id stay.

    Rows that leave are named by (doc_id, hash of the text). Where ids do not repeat, the
    doc_id alone tells; rows that repeat both are equal texts, of which one stays."""
    digest = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    hashed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], digest.alias("digest"))
    found = materialize(fingerprints_with(hashed, shingle_words), "simhash-found")
    roots = component_of(found, radius)
    rows = found.filter("doc_id is not null").join(roots, F.col("fp") == F.col("of_fp"))
    texts = materialize(rows.groupBy("root", "doc_id", "fp", "digest").agg(F.count(F.lit(1)).alias("n")), "simhash-texts")
    first = texts.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "digest")).alias("first"))
    states = materialize(
        texts.join(first, "root").select(
            F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "n",
            (F.struct("doc_id", "fp", "digest") == F.col("first")).alias("stays"),
        ),
        "simhash-states",
    )
    dropped, repeated = states.filter("not stays").select("__id", "__digest"), states.filter("stays and n > 1").select("__id", "__digest")
    if dropped.count() <= BROADCAST_IDS:  # a checked size; beyond it the planner shuffles
        dropped = F.broadcast(dropped)
    same = (docs["doc_id"].cast("long") == F.col("__id")) & (digest == F.col("__digest"))
    kept = docs.join(dropped, same, "left_anti")  # rows without doc_id match none
    if repeated.isEmpty():
        return kept
    once = docs.join(repeated, same, "left_semi")
    columns = docs.columns
    order = F.row_number().over(Window.partitionBy("doc_id", "__text").orderBy(F.xxhash64(*[docs[c] for c in columns])))
    once = once.withColumn("__text", digest).withColumn("__place", order).filter("__place = 1").select(*columns)
    return kept.join(repeated, same, "left_anti").unionByName(once)
