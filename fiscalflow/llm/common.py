"""Helpers shared by the operators: materialised tables, bounded driver facts,
ragged gathers and connected components."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalflow.session import shared_dir


# Ids (longs) that a broadcast may hold; they are counted first, and beyond this number
# the join is left to the planner, which shuffles.
BROADCAST_IDS = 2_000_000


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared folder (``spark.checkpoint.dir``)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is
    cut at files that outlive any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(df: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text``, whatever other columns ``df`` carries."""
    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"))


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a string column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` of every i, in a row."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def partition_bases(totals: DataFrame) -> dict[int, int]:
    """Exclusive prefix sums of ``(part, total)`` in order of ``part``. One row per
    partition comes to the driver, never anything that grows with the rows."""
    base, running = {}, 0
    for part, total in sorted((r["part"], r["total"]) for r in totals.collect()):
        base[part] = running
        running += total
    return base


RANGE_BYTES = 128 * 1024 * 1024
MOST_RANGES = 2_000_000  # a plan of unknown size counts as endless


def range_partitions(df: DataFrame) -> int:
    """Partitions for a range shuffle of ``df``: about ``RANGE_BYTES`` of the size that the
    planner knows (file sizes) each, the session's shuffle partitions at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size // RANGE_BYTES), MOST_RANGES))


def task_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def in_fold(column: str, divisor: int, remainders: Iterable[int]):
    """Rows whose crc32 of the id as text leaves one of ``remainders``."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % divisor).isin(list(remainders))


def sample_rate(rows: int, bound: int) -> float:
    return 1.0 if rows <= bound else bound / rows


def id_sample(df: DataFrame, column: str, rate: float, salt: str) -> DataFrame:
    """Rows whose id falls, by hash, below ``rate``: the same rows on every run."""
    if rate >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(1_000_000)) < int(rate * 1_000_000))


def batches(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size`` rows (slices, no copies)."""
    for batch in rows:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, component)`` with the
    smallest reachable node, for every node of an edge between different nodes.

    Alternating large-star and small-star rounds until the edges no longer change.
    A hub's neighbours are never gathered: the smallest neighbour is an aggregate
    (combined before the shuffle) and is joined back, so that a hot hub is a skewed
    join, which the adaptive planner splits. Each round is written to the shared
    folder. Null ends and loops are ignored.
    """
    current = materialize(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        name,
    )
    state = _state(current)
    while state[0]:
        current = materialize(_small_star(_large_star(current)), name)
        before, state = state, _state(current)
        if state == before:
            break
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    both = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(both)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour v of u moves to the smallest m of u and its neighbours."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    return (
        both.filter("v > u").join(least, "u")
        .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of u, and u itself, moves to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
