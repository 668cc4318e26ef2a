"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE_ROWS`` expected, chosen by hash of
the id) and every row is then put into a leaf, going down to the nearest centre. A
query walks the tree with a priority queue: the nearest waiting node is opened next,
and leaves are visited in the order in which they come up. How many leaves are visited
is calibrated: for at most ``CALIBRATION_QUERIES`` queries the true neighbours are
found by brute force over all rows, and a query visits the fewest leaves that hold the
share ``TARGET_RECALL`` of them; it goes on until its leaves hold enough rows for a full
answer. The target lies above the 0.9 that is asked for by a margin for other queries
than the calibrating ones. On vectors without any structure a tree can only leave out
few leaves at such a recall.

Skew: a leaf of more than ``BUCKET`` rows is dealt over buckets by hash of the id and
each bucket is searched by itself; within a task the rows of one bucket are held and
the queries that visit it stream past. Only top candidates leave a bucket. Nothing is
broadcast but the tree and the calibration queries, whose sizes the parameters bound.

Nearness is the Euclidean distance in double precision on the original vectors, ties
to the smaller id; the candidates come from a matrix product and are measured anew.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components
or differ in length from the most common length take no part, nor do rows without id;
a repeated id is one query (its least vector) but each of its rows a candidate of
others; no rows or no queries give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalflow.llm.common import id_sample, materialize, sample_rate

SAMPLE_ROWS = 20_000
BRANCHES = 8
LEAF_SAMPLE = 64  # sampled rows that a leaf holds at most
LLOYD_ROUNDS = 12
CALIBRATION_QUERIES = 200
TARGET_RECALL = 0.93
BUCKET = 4096
K = 10


@dataclass
class Tree:
    """Nodes as arrays; ``leaf[i]`` is the number of leaf i, or -1 for inner nodes."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def n_leaves(self) -> int:
        return 1 + max(self.leaf, default=-1)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child, level by level."""
        out = np.empty(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            near = nearest(vectors[rows], self.centres[kids])
            todo += [(int(kids[k]), rows[near == k]) for k in range(len(kids)) if (near == k).any()]
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            kids = self.children[node]
            gaps = ((self.centres[kids] - query) ** 2).sum(axis=1)
            for gap, kid in zip(gaps.tolist(), kids):
                heapq.heappush(queue, (gap, kid))


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


def fit_tree(sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_SAMPLE, seed: int = 42) -> Tree:
    """Lloyd's k-means on the sample, then again within each cluster, until a cluster
    is small or holds one point only."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((0, sample.shape[1])))
    centres = [sample.mean(axis=0)]
    tree.children.append([])
    tree.leaf.append(-1)
    todo, leaves = [(0, np.arange(len(sample)))], 0
    while todo:
        node, rows = todo.pop()
        points = sample[rows]
        means = None
        if len(rows) > leaf_rows:
            distinct = np.unique(points, axis=0)
            if len(distinct) > 1:
                means = distinct[rng.choice(len(distinct), min(branches, len(distinct)), replace=False)]
                for _ in range(LLOYD_ROUNDS):
                    near = nearest(points, means)
                    used = np.unique(near)
                    moved = np.stack([points[near == k].mean(axis=0) for k in used])
                    if moved.shape == means.shape and np.allclose(moved, means):
                        break
                    means = moved
                near = nearest(points, means)
                if len(np.unique(near)) < 2:
                    means = None
        if means is None:
            tree.leaf[node] = leaves
            leaves += 1
            continue
        for k in np.unique(near).tolist():
            tree.children[node].append(len(centres))
            todo.append((len(centres), rows[near == k]))
            centres.append(means[k])
            tree.children.append([])
            tree.leaf.append(-1)
    tree.centres = np.stack(centres)
    return tree


def usable(vectors: DataFrame) -> DataFrame:
    """``(id long, vec binary)`` of the rows that take part; components as doubles."""
    cells = F.transform(F.col("cells"), lambda x: x.cast("double"))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("id"), vectors["embedding"].alias("cells")).select("id", cells.alias("cells"))
    fine = F.forall("cells", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("cells").isNotNull() & fine & F.exists("cells", lambda x: x != 0.0))
    sizes = rows.groupBy(F.size("cells").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = rows.filter(F.size("cells") == (sizes[0]["n"] if sizes else 0))

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            if batch.num_rows:
                cells = batch.column(1)
                matrix = cells.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), packed(matrix)], ["id", "vec"])

    return rows.mapInArrow(run, "id long, vec binary")


def packed(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix, "<f8")], pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """Per query the positions of its ``k`` nearest rows that are not its own, by exact
    distance, then id. Yields (query position, positions, distances)."""
    gaps = (rows**2).sum(axis=1) - 2 * queries @ rows.T + (queries**2).sum(axis=1)[:, None]
    gaps[query_ids[:, None] == ids[None, :]] = np.inf
    slack = 1e-9 * (1 + (rows**2).sum(axis=1).max() + (queries**2).sum(axis=1).max())
    if len(rows) > k:
        limit = np.partition(gaps, k - 1, axis=1)[:, k - 1] + slack
    else:
        limit = np.full(len(queries), np.finfo(float).max)
    for q in range(len(queries)):
        at = np.flatnonzero((gaps[q] <= limit[q]) & np.isfinite(gaps[q]))
        exact = np.sqrt(((rows[at] - queries[q]) ** 2).sum(axis=1))
        order = np.lexsort((ids[at], exact))[:k]
        yield q, at[order], exact[order]


def best(found: DataFrame, k: int) -> DataFrame:
    """``k`` rows per query by (score, vec_id); the limit is applied before the shuffle
    too."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


HITS = "query_id long, vec_id long, score double, leaf long"


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["query_id", "vec_id", "score", "leaf"])


def brute_force(index: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a bounded number of queries among all rows of the index."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            for at in range(0, batch.num_rows, BUCKET):
                part = batch.slice(at, BUCKET)
                ids, leaf = part.column(1).to_numpy(), part.column(0).to_numpy()
                out = []
                for q, near, far in top(queries, query_ids, unpacked(part.column(2)), ids, k):
                    out += zip([int(query_ids[q])] * len(near), ids[near].tolist(), far.tolist(), leaf[near].tolist())
                yield _hits(out)

    return best(index.select("leaf", "id", "vec").mapInArrow(run, HITS), k)


def calibrated_visits(tree: Tree, index: DataFrame, queries: DataFrame, k: int, target: float) -> int:
    """The fewest leaf visits that reach the share ``target`` of the calibration queries'
    true neighbours."""
    sample = id_sample(queries, "id", sample_rate(queries.count(), CALIBRATION_QUERIES), "ann-calibration").collect()
    if not sample:
        return tree.n_leaves
    ids = np.array([r["id"] for r in sample], np.int64)
    vectors = np.stack([np.frombuffer(r["vec"], "<f8") for r in sample])
    truth: dict[int, list[int]] = {}
    for r in brute_force(index, ids, vectors, k).select("query_id", "leaf").collect():
        truth.setdefault(r["query_id"], []).append(r["leaf"])
    if not truth:
        return 1
    places = []
    for i, v in zip(ids.tolist(), vectors):
        place = {leaf: n for n, leaf in enumerate(tree.visits(v))}
        places += [place[leaf] for leaf in truth.get(i, [])]
    places.sort()
    return places[max(0, math.ceil(target * len(places)) - 1)] + 1


def search(
    vectors: DataFrame, is_query: Column, k: int = K, target: float = TARGET_RECALL, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``vectors`` (``vec_id``,
    ``embedding``) for which ``is_query`` holds on ``vec_id``, its ``k`` nearest found."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    # equal rows are one point: however often an id is repeated, the sample stays bounded
    points = rows.withColumn("point", F.xxhash64("id", "vec"))
    n_points = points.agg(F.approx_count_distinct("point")).first()[0]
    chosen = id_sample(points, "point", sample_rate(n_points, sample_rows), "ann-sample").select("id", "vec").distinct()
    sample = chosen.orderBy("id", "vec").collect() or rows.orderBy("id", "vec").limit(1).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit_tree(np.stack([np.frombuffer(r["vec"], "<f8") for r in sample]))

    def assign(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            if batch.num_rows:
                leaf = tree.assign(unpacked(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column(0), batch.column(1)], ["leaf", "id", "vec"])

    index = materialize(rows.mapInArrow(assign, "leaf long, id long, vec binary"), "ann-index")
    queries = index.withColumn("vec_id", F.col("id")).filter(is_query).groupBy("id").agg(F.min("vec").alias("vec"))
    visits = calibrated_visits(tree, index, queries, k, target)
    held = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # one number per leaf
    buckets = [-(-held.get(i, 0) // BUCKET) for i in range(tree.n_leaves)]

    def visit(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            leaf, bucket, row = [], [], []
            for q, vector in enumerate(unpacked(batch.column(1)) if batch.num_rows else []):
                seen = candidates = 0
                for at in tree.visits(vector):
                    seen, candidates = seen + 1, candidates + held.get(at, 0)
                    for b in range(buckets[at]):
                        leaf.append(at)
                        bucket.append(b)
                        row.append(q)
                    if seen >= visits and candidates > k:
                        break
            took = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int64()), pa.array(bucket, pa.int64()), batch.column(0).take(took), batch.column(1).take(took)],
                ["leaf", "bucket", "id", "vec"],
            )

    asked = queries.mapInArrow(visit, "leaf long, bucket long, id long, vec binary").withColumn("asks", F.lit(1))
    share = F.get(F.lit([max(1, b) for b in buckets]).cast("array<long>"), F.col("leaf").cast("int"))
    dealt = index.select("leaf", F.pmod(F.xxhash64("id", "vec"), share).alias("bucket"), "id", "vec", F.lit(0).alias("asks"))

    def answer(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, leaf_of = [], [], None
        for batch in batches_in:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).to_numpy()], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                leaf, bucket, asks = keys[a].tolist()
                part = batch.slice(a, b - a)
                if leaf_of != (leaf, bucket):
                    ids, vecs, leaf_of = [], [], (leaf, bucket)
                if not asks:
                    ids.append(part.column(2).to_numpy())
                    vecs.append(unpacked(part.column(3)))
                elif ids:
                    ids, vecs = [np.concatenate(ids)], [np.concatenate(vecs)]
                    for at in range(0, part.num_rows, 256):
                        some = part.slice(at, 256)
                        mine = some.column(2).to_numpy()
                        out = []
                        for q, near, far in top(unpacked(some.column(3)), mine, vecs[0], ids[0], k):
                            out += zip([int(mine[q])] * len(near), ids[0][near].tolist(), far.tolist(), [leaf] * len(near))
                        yield _hits(out)

    work = dealt.unionByName(asked).repartition("leaf", "bucket").sortWithinPartitions("leaf", "bucket", "asks")
    return best(work.select("leaf", "bucket", "id", "vec", "asks").mapInArrow(answer, HITS), k).select("query_id", "rank", "vec_id", "score")
