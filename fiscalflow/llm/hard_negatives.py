"""Hard-negative mining with segment summaries.

A vector is cut into segments; of each segment its mean and its deviation (the length of
what is left when the mean is taken off) are stored. For two vectors the inner product of
a segment is length x mean x mean plus the product of the two rests, and that one lies
between minus and plus the product of the deviations. The sums over the segments bound
the score from both sides. ``LEVELS`` cuts a vector finer and finer: a pair that the
bounds of one level cannot rule out is bounded again with shorter segments, and only what
the finest level leaves is scored exactly.

Two searches use the bounds. Positives: the ``k`` best rows of the anchor's label; a row
whose upper bound is below the k-th largest lower bound is out. Negatives: the best rows
of other labels in a window of scores below each positive; a row is out for a positive if
its bounds miss the window, or if enough rows that surely are in the window surely score
higher.

Work is dealt in units of one block of anchors and one block of rows, by hashes of the
ids, so that a hot label or many equal vectors spread over all units, and a unit's memory
is bounded. Anchors are a stated query set met against all rows in blocks. A unit returns
only its top rows per anchor (or anchor and positive), and those are merged.

Scores are exact integers: with squared lengths below 2^53 every partial sum of a product
is an integer that a double holds; longer vectors are multiplied in 64-bit integers.

Defined cases: rows with null id, null label, a null or empty vector, null or non-finite
components, a length that differs from the most common one, or a squared length (before
rounding down) of 2^62 or more (scores that no long holds) take no part; ties go to the smaller id; of rows that
repeat an anchor's id the least (label, vector) is the anchor, none of them is its
positive or negative, and each is a row of its own for other anchors; anchors without
positives or positives without negatives give no row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalflow.llm.common import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOWER, UPPER = 30, 90  # percent of the positive's score
LEVELS = (2, 8, 32)  # segments per vector
BLOCK_ROWS = 8192
BLOCK_ANCHORS = 4096
TOGETHER = 32  # anchors bounded at a time
DENSE = 0.3  # share of pairs left from which bounds are computed for all pairs
PAIRS = 1 << 17  # pairs bounded or scored at a time, of single pairs

ROWS = "id long, label long, vec binary"
WORK = ["kind", "id", "label", "vec", "floors", "ceilings"]
FOUND = "anchor_id long, place int, id long, score long"


# --- one unit of work -------------------------------------------------------------------

class Block:
    """Integer vectors with their segment summaries, level by level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def summary(self, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Per segment the mean times the root of its length, and the deviation: products
        of the first add up to length x mean x mean. A last deviation, a millionth of
        the vector's length, widens the bounds beyond what rounding can take off."""
        if segments not in self.levels:
            dims = self.vectors.shape[1]
            cuts = np.unique(np.linspace(0, dims, min(segments, dims) + 1).astype(int))
            sizes = np.diff(cuts).astype(float)
            rows = self.vectors.astype(float)
            means = np.add.reduceat(rows, cuts[:-1], axis=1) / sizes
            rest = rows - np.repeat(means, np.diff(cuts), axis=1)
            deviations = np.sqrt(np.add.reduceat(rest * rest, cuts[:-1], axis=1))
            lengths = 1e-6 * np.sqrt((rows * rows).sum(axis=1, keepdims=True))
            self.levels[segments] = means * np.sqrt(sizes), np.hstack([deviations, lengths])
        return self.levels[segments]


def bounds(anchors: Block, rows: Block, segments: int, a: np.ndarray, r: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of anchors ``a`` with all rows (a matrix), or
    of the pairs ``(a[i], r[i])``."""
    am, ad = (x[a] for x in anchors.summary(segments))
    rm, rd = rows.summary(segments)
    if r is None:
        middle, spread = am @ rm.T, ad @ rd.T
    else:
        middle, spread = np.einsum("ij,ij->i", am, rm[r]), np.einsum("ij,ij->i", ad, rd[r])
    return middle - spread, middle + spread


def exact(anchors: Block, rows: Block, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Scores of the pairs, as integers."""
    left, right = anchors.vectors, rows.vectors
    if left.dtype != right.dtype:
        left, right = left.astype(np.int64), right.astype(np.int64)
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), PAIRS):
        some = slice(at, at + PAIRS)
        out[some] = np.einsum("ij,ij->i", left[a[some]], right[r[some]])
    return out


def refined(anchors: Block, rows: Block, chosen: np.ndarray, alive: np.ndarray, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``(position in chosen, row, score)`` left by all levels, scored exactly.
    ``alive`` is the matrix of pairs to look at; ``keep(lower, upper, alive)`` says which
    go on, from matrices that hold -inf and inf where a pair is out."""
    for segments in LEVELS:
        left = int(alive.sum())
        if not left:
            break
        if left >= DENSE * alive.size:
            low, high = bounds(anchors, rows, segments, chosen, None)
        else:
            low, high = np.zeros(alive.shape), np.zeros(alive.shape)
            a, r = np.nonzero(alive)
            for at in range(0, left, PAIRS):
                some = slice(at, at + PAIRS)
                low[a[some], r[some]], high[a[some], r[some]] = bounds(anchors, rows, segments, chosen[a[some]], r[some])
        alive &= keep(low, high, alive)
        if segments >= rows.vectors.shape[1]:
            break
    a, r = np.nonzero(alive)
    return a, r, exact(anchors, rows, chosen[a], r)


def kth_largest(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Per line the k-th largest value of those that count, -inf if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(np.where(counts, values, -np.inf), values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def positives_of(anchors: Block, rows: Block, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(anchor position, 0, row positions, scores)``: each anchor's best rows of its label."""
    for at in range(0, len(anchors.ids), TOGETHER):
        chosen = np.arange(at, min(at + TOGETHER, len(anchors.ids)))
        alive = (anchors.labels[chosen, None] == rows.labels) & (anchors.ids[chosen, None] != rows.ids)

        def keep(low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
            return high >= kth_largest(low, alive, k)[:, None]

        a, r, scores = refined(anchors, rows, chosen, alive, keep)
        cuts = np.searchsorted(a, np.arange(len(chosen) + 1))
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            best = first(rows.ids[r[x:y]], scores[x:y], k)
            yield int(chosen[i]), 0, r[x:y][best], scores[x:y][best]


def negatives_of(anchors: Block, windows: list[tuple[list[int], list[int]]], rows: Block, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(anchor position, positive's place, row positions, scores)``: the best rows of
    other labels in the window ``floors[place] .. ceilings[place]`` of each positive."""
    most = max((len(f) for f, _ in windows), default=0)
    floors, ceilings = np.full((len(windows), most), np.inf), np.full((len(windows), most), -np.inf)
    for i, (low, high) in enumerate(windows):
        floors[i, : len(low)], ceilings[i, : len(high)] = low, high
    for at in range(0, len(anchors.ids), TOGETHER):
        chosen = np.arange(at, min(at + TOGETHER, len(anchors.ids)))
        alive = (anchors.labels[chosen, None] != rows.labels) & (anchors.ids[chosen, None] != rows.ids)

        def keep(low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
            wanted = np.zeros(alive.shape, bool)
            for p in range(most):
                floor, ceiling = floors[chosen, p, None], ceilings[chosen, p, None]
                surely = alive & (low >= floor) & (high <= ceiling)
                wanted |= (low <= ceiling) & (high >= np.maximum(floor, kth_largest(low, surely, k)[:, None]))
            return wanted

        a, r, scores = refined(anchors, rows, chosen, alive, keep)
        cuts = np.searchsorted(a, np.arange(len(chosen) + 1))
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            for place, (floor, ceiling) in enumerate(zip(*windows[chosen[i]])):
                inside = x + np.flatnonzero((scores[x:y] >= floor) & (scores[x:y] <= ceiling))
                best = inside[first(rows.ids[r[inside]], scores[inside], k)]
                yield int(chosen[i]), place, r[best], scores[best]


def window_of(score: Column) -> tuple[Column, Column]:
    """The least and the greatest integer score of a negative for a positive's score:
    ``LOWER * score <= 100 * s <= UPPER * score``, in exact arithmetic."""
    exactly = score.cast("decimal(20,0)")
    return F.ceil(exactly * LOWER / 100).cast("long"), F.floor(exactly * UPPER / 100).cast("long")


# --- on Spark ---------------------------------------------------------------------------

def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """``(id, label, vec)`` of the rows that take part, components as scaled integers
    (64-bit, little-endian)."""
    fine = F.forall("cells", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("id"), label.cast("long").alias("label"), vectors["embedding"].alias("cells"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("cells") > 0) & fine)
    rows = rows.withColumn("cells", F.transform(F.col("cells"), lambda x: x.cast("double") * SCALE))
    squares = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.filter(squares < float(1 << 62))
    sizes = rows.groupBy(F.size("cells").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = rows.filter(F.size("cells") == (sizes[0]["n"] if sizes else 0))

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            if batch.num_rows:
                cells = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False)).astype("<i8").reshape(batch.num_rows, -1)
                packed = pa.array([row.tobytes() for row in np.ascontiguousarray(cells)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["id", "label", "vec"])

    return rows.mapInArrow(run, ROWS)


def block_of(batch: pa.RecordBatch) -> Block:
    vectors = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<i8").reshape(batch.num_rows, -1)
    if float((vectors.astype(float) ** 2).sum(axis=1).max()) < float(1 << 53):
        vectors = vectors.astype(float)
    return Block(batch.column("id").to_numpy(), batch.column("label").to_numpy(), vectors)


def in_units(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, search: Callable) -> DataFrame:
    """``search`` on every unit (block of anchors, block of rows): ``FOUND`` rows."""
    row_blocks, anchor_blocks = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_anchors // BLOCK_ANCHORS))
    # the row's place takes part, so that repeated rows spread too
    mine = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(row_blocks))
    theirs = F.pmod(F.xxhash64("id"), F.lit(anchor_blocks))
    nothing = F.lit(None).cast("array<long>")
    dealt = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("b"), mine.alias("r"), F.lit(1).alias("kind"), "id", "label", "vec",
        nothing.alias("floors"), nothing.alias("ceilings"),
    ).unionByName(
        anchors.select(
            theirs.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("r"), F.lit(0).alias("kind"), "id", "label", "vec",
            "floors", "ceilings",
        )
    )
    units = dealt.select((F.col("b") * row_blocks + F.col("r")).cast("long").alias("unit"), *WORK)

    def answer(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> Iterator[pa.RecordBatch]:
            unit = pa.Table.from_batches(held).combine_chunks()
            kinds = unit.column("kind").to_numpy()
            asked, others = (unit.filter(pa.array(kinds == k)).combine_chunks() for k in (0, 1))
            held.clear()
            if asked.num_rows and others.num_rows:
                yield from search(asked.to_batches()[0], others.to_batches()[0])

        for batch in batches_in:
            unit = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[0].column(0)[0].as_py() != unit[a]:
                    yield from found()
                held.append(batch.slice(a, b - a))
        if held:
            yield from found()

    return units.repartition("unit").sortWithinPartitions("unit", "kind", "id").mapInArrow(answer, FOUND)


def _found(block: Block, rows: Block, hits: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    anchor, place, ids, scores = [], [], [], []
    for at, p, r, s in hits:
        anchor += [int(block.ids[at])] * len(r)
        place += [p] * len(r)
        ids += rows.ids[r].tolist()
        scores += s.tolist()
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor, pa.int64()), pa.array(place, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
        ["anchor_id", "place", "id", "score"],
    )


def best(found: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for
    the rows of ``vectors`` (``vec_id``, ``embedding``) for which ``is_anchor`` holds on
    ``vec_id``; ``label`` is the label as an expression of the columns."""
    rows = materialize(usable(vectors, label), "negatives-rows")
    nothing = F.lit(None).cast("array<long>")
    anchors = materialize(
        rows.withColumn("vec_id", F.col("id")).filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("v"))
        .select("id", "v.label", "v.vec", nothing.alias("floors"), nothing.alias("ceilings")),
        "negatives-anchors",
    )
    n_rows, n_anchors = rows.count(), anchors.count()

    def nearest_of_label(asked: pa.RecordBatch, others: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, r = block_of(asked), block_of(others)
        yield _found(a, r, positives_of(a, r, positives))

    chosen = best(in_units(rows, anchors, n_rows, n_anchors, nearest_of_label), positives)
    floor, ceiling = window_of(F.col("score"))
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), floor.alias("floor"), ceiling.alias("ceiling"))))
    lists = materialize(chosen.groupBy("anchor_id").agg(listed.alias("p")), "negatives-positives")  # at most ``positives`` each
    asked = anchors.drop("floors", "ceilings").join(lists, F.col("id") == F.col("anchor_id")).select(
        "id", "label", "vec", F.col("p.floor").alias("floors"), F.col("p.ceiling").alias("ceilings")
    )

    def in_windows(asked: pa.RecordBatch, others: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, r = block_of(asked), block_of(others)
        windows = list(zip(asked.column("floors").to_pylist(), asked.column("ceilings").to_pylist()))
        yield _found(a, r, negatives_of(a, windows, r, negatives))

    found = best(in_units(rows, asked, n_rows, n_anchors, in_windows), negatives)
    of_positive = lists.select("anchor_id", F.posexplode("p").alias("place", "p")).select("anchor_id", "place", "p.positive_id", "p.positive_score")
    return found.join(of_positive, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
