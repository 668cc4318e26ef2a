"""Key audits kept up to date by batches of changes.

``audit_pk`` and ``audit_fk`` read every table. Here the verified keys are stored, and a
batch of added and removed rows is checked against those of them it touches:

* the count of a primary key changes only for keys the batch holds;
* a reference is violated if its parent key has no row, so its state changes only if the
  batch holds the reference or its parent. The references of a parent are looked up only
  where its last row goes: a parent that a third of all rows name costs nothing as long as
  it stays.

Both stores are logs of changes, partitioned by a hash of the key: a batch appends its
changes and reads the buckets its keys fall into. The violations are a table of their own,
written anew for each batch. A batch counts once its marker is written, after everything
else; what a failed one left is never read, and it may be applied again.

A batch's rows are staged once, as their keys alone, so that joins and aggregates they come
from run once. The logs are written from there without a shuffle, and changes that cancel
each other are left to the sums of those who read them. One aggregate by key then takes
all that decides about it: the batch's changes and references, the committed changes and
the violations so far. Tables and constraints are numbers within a batch, names in the
stores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fiscalflow import schemas
from fiscalflow.operators.audit import ForeignKey, constraint_name
from fiscalflow.sources.model import conform

Tables = Mapping[str, DataFrame]

PAIR = ["parent", "fk_value"]  # a table and one of its keys
REFERENCE = [*PAIR, "constraint", "child_id"]
STORES = {
    "keys": "parent string, fk_value long, change long",
    "refs": "parent string, fk_value long, constraint string, child_id long, change long",
    "pk": "parent string, fk_value long, rows long",
    "fk": "parent string, fk_value long, constraint string, child_id long, rows long",
}
LOGS = ("keys", "refs")
MARKERS = "committed"
MARKER = "batch int, version string, buckets int"
STAGED = "table int, id long, change long, fks array<bigint>"
KEPT = "table int, fk_value long, rows long, absent boolean, gone boolean"
MET = "table int, fk_value long, constraint int, child_id long, rows long"
TOUCHED, BROKEN = 1, 2  # flags of a key: the batch holds it, references to it are violated so far

# Keys are small as files and large in a hash table (some 40 times), so a task gets less
# of them than Spark's 64 MB of shuffle: of stored bytes, and of a shuffle's.
TASK_STORED_BYTES = 4 * 1024 * 1024
TASK_SHUFFLE_BYTES = 12 * 1024 * 1024
TASK_READ_BYTES = 32 * 1024 * 1024  # a task sorts what it stages or reads of it, some 30 times that in memory
MOST_TASKS = 20_000
ROUND_BYTES = 64 * 1024 * 1024  # of a batch's references that are asked for their parents at once, if there are
MOST_ROUNDS = 8  # no more rounds than this to ask in
FEW_KEYS = 10_000  # that a table lacks and every task may hold
# Keys are stored as differences: sorted ones take a byte or two, and no dictionary is tried.
STORED = {"compression": "zstd", "parquet.writer.version": "v2"} | {
    f"parquet.enable.dictionary#{c}": "false" for c in ("fk_value", "child_id", "id")
}
FEW_ROWS = 200_000  # of a batch whose keys are looked up in the log, instead of the log's keys being summed up with them


def _same_pair(a: DataFrame, b: DataFrame) -> Column:
    return (a["parent"] == b["parent"]) & a["fk_value"].eqNullSafe(b["fk_value"])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _net(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Changes summed up; what comes and goes within them is none."""
    return rows.groupBy(*columns).agg(F.sum("change").alias("change")).filter("change != 0")


def _nothing(spark: SparkSession, schema: str) -> DataFrame:
    columns = [c.split() for c in schema.split(", ")]
    return spark.range(0, 0, 1, 1).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns])


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files below ``df``. What is no file (its size is unknown) counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 2**62)


def _bytes(spark: SparkSession, text: str) -> int:
    """A size as Spark's settings give it, such as 16m."""
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


@contextmanager
def small_tasks(spark: SparkSession, size: int, writers: int) -> Iterator[None]:
    """Within it, shuffles of ``size`` stored bytes give tasks of bounded size, and their
    files go when the query that made them has ended."""
    advisory, partitions = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    splits, cleanup = "spark.sql.files.maxPartitionBytes", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    at_once, skewed = "spark.sql.maxConcurrentOutputFileWriters", "spark.sql.adaptive.forceOptimizeSkewedJoin"
    held = {name: spark.conf.get(name, None) for name in (advisory, partitions, splits, cleanup, at_once, skewed)}
    least = int(spark.conf.get(partitions))
    spark.conf.set(advisory, str(TASK_SHUFFLE_BYTES))
    spark.conf.set(partitions, str(max(least, min(-(-size // TASK_STORED_BYTES), MOST_TASKS))))
    spark.conf.set(splits, str(min(_bytes(spark, spark.conf.get(splits)), TASK_READ_BYTES)))
    spark.conf.set(cleanup, "true")
    spark.conf.set(at_once, str(writers))  # what is sorted by bucket is not sorted again
    spark.conf.set(skewed, "true")  # a missing parent that a third of all rows name
    try:
        yield
    finally:
        for name, value in held.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _read(spark: SparkSession, schema: str, base: str, *paths: str) -> DataFrame:
    """The files under ``paths``, some of which may be missing."""
    found = []
    for path in paths:
        try:
            found.append(spark.read.schema(schema).option("basePath", base).parquet(path))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return _union(found) if found else _nothing(spark, schema)


class _Names:
    """Numbers of tables and constraints within a batch, and their names."""

    def __init__(self, fks: Sequence[ForeignKey]):
        self.tables = list(dict.fromkeys([*schemas.SCHEMAS, *(fk[2] for fk in fks)]))
        self.fks = [fk for name in self.tables for fk in fks if fk[0] == name]

    def of(self, table: str) -> list[ForeignKey]:
        return [fk for fk in self.fks if fk[0] == table]

    @staticmethod
    def _at(values: Sequence, number: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), number)

    def table(self) -> Column:
        return self._at(self.tables, F.col("table"))

    def constraint(self) -> Column:
        return self._at([constraint_name(*fk) for fk in self.fks] or [""], F.col("constraint"))

    def code(self, name: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, self.tables)), name).cast("int") - 1

    def constraint_code(self, name: Column) -> Column:
        return F.array_position(F.array(*[F.lit(constraint_name(*fk)) for fk in self.fks] or [F.lit("")]), name).cast("int") - 1

    def touched(self, tables: Iterable[str]) -> list[str]:
        """The tables whose keys rows of ``tables`` are or name."""
        return sorted({*tables} | {fk[2] for fk in self.fks if fk[0] in tables})

    def references(self, staged: DataFrame) -> DataFrame:
        """``(table, fk_value, constraint, child_id, change)``: the table that is referred to."""
        children = [fk[0] for fk in self.fks]
        first = self._at([children.index(t) if t in children else 0 for t in self.tables], F.col("table"))
        each = staged.select(first.alias("first"), "id", "change", F.posexplode("fks").alias("place", "fk_value"))
        each = each.filter("fk_value is not null").select("fk_value", (F.col("first") + F.col("place")).alias("constraint"), F.col("id").alias("child_id"), "change")
        return each.withColumn("table", self._at([self.tables.index(fk[2]) for fk in self.fks] or [0], F.col("constraint")))


@dataclass(frozen=True)
class DeltaAudit:
    """The audits' state after the batches ``versions`` under the folder ``root``."""

    spark: SparkSession
    root: str
    versions: tuple[str, ...]
    buckets: int

    @classmethod
    def start(cls, spark: SparkSession, root: str, tables: Tables, buckets: int = 64) -> DeltaAudit:
        """The state of a first load of ``tables``, in a folder without state. A batch reads
        whole buckets: give enough of them that each holds some hundred MB of the logs."""
        if cls._markers(spark, root):
            raise ValueError(f"{root} holds the state of an audit")
        return cls(spark, root, (), buckets).apply(tables)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> DeltaAudit:
        """The state after the last batch that was committed."""
        marks = cls._markers(spark, root)
        if not marks:
            raise ValueError(f"{root} holds no state of an audit")
        return cls(spark, root, tuple(m["version"] for m in marks), marks[0]["buckets"])

    @staticmethod
    def _markers(spark: SparkSession, root: str):
        return _read(spark, MARKER, f"{root}/{MARKERS}", f"{root}/{MARKERS}").orderBy("batch").collect()

    # --- stores ---------------------------------------------------------------------

    def _bucket(self, parent: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col("parent") if parent is None else parent, F.col("fk_value")), F.lit(self.buckets)).cast("int")

    def _append(self, name: str, rows: DataFrame, version: str) -> None:
        """Add ``rows`` to a log, a bucket's together."""
        placed = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        self._write(name, placed.sortWithinPartitions("bucket", *PAIR), version)

    def _append_numbered(self, name: str, rows: DataFrame, names: _Names, version: str) -> None:
        """Add a batch's ``rows`` to a log without a shuffle: each task writes its part of
        every bucket. They are sorted while they are narrow, by one number, which is a radix
        sort: by bucket, table and the key's lower bits (larger keys only lie less close)."""
        bits = lambda c, n: F.shiftleft(F.col(c).cast("long"), n)
        place = bits("bucket", 50) + bits("table", 44) + F.col("fk_value").bitwiseAND(2**44 - 1)
        placed = rows.withColumn("bucket", self._bucket(names.table())).sortWithinPartitions(place)
        held = [c for c in rows.columns if c != "table"]
        named = placed.select(names.table().alias("parent"), *[names.constraint().alias(c) if c == "constraint" else F.col(c) for c in held], "bucket")
        self._write(name, named, version)

    def _write(self, name: str, placed: DataFrame, version: str) -> None:
        (
            placed.withColumn("version", F.lit(version))
            .write.mode("append").options(**STORED).partitionBy("bucket", "version").parquet(f"{self.root}/{name}")
        )

    def _log(self, name: str, *paths: str) -> DataFrame:
        return _read(self.spark, f"{STORES[name]}, bucket int, version string", f"{self.root}/{name}", *paths)

    def _touched(self, name: str, pairs: DataFrame) -> DataFrame:
        """The committed changes in a log to the keys ``pairs``. Only the buckets they fall
        into are listed and read; at most one number per bucket comes to the driver."""
        met = [r[0] for r in pairs.select(self._bucket().alias("b")).distinct().collect()] if self.versions else []
        if not met:
            return _nothing(self.spark, STORES[name])
        if len(met) == self.buckets:
            log = self._log(name, f"{self.root}/{name}")
        else:
            log = self._log(name, f"{self.root}/{name}/bucket={{{','.join(map(str, sorted(met)))}}}")
        held = log.filter(F.col("version").isin(*self.versions)).drop("bucket", "version")
        return held.join(pairs, _same_pair(held, pairs), "left_semi")

    def _committed(self, name: str) -> DataFrame:
        """All committed changes in a log."""
        if not self.versions:
            return _nothing(self.spark, STORES[name])
        return self._log(name, f"{self.root}/{name}").filter(F.col("version").isin(*self.versions)).drop("bucket", "version")

    def _violations(self, name: str) -> DataFrame:
        if not self.versions:
            return _nothing(self.spark, STORES[name])
        path = f"{self.root}/{name}/{self.versions[-1]}"
        return _read(self.spark, STORES[name], path, path)

    def _commit(self, version: str, pk: DataFrame, fk: DataFrame) -> DeltaAudit:
        pk.write.options(**STORED).parquet(f"{self.root}/pk/{version}")
        fk.write.options(**STORED).parquet(f"{self.root}/fk/{version}")
        batch = len(self.versions)
        marker = self.spark.createDataFrame([(batch, version, self.buckets)], MARKER)
        marker.coalesce(1).write.mode("append").parquet(f"{self.root}/{MARKERS}")
        return DeltaAudit(self.spark, self.root, (*self.versions, version), self.buckets)

    # --- batches --------------------------------------------------------------------

    def _staged(self, added: Tables, removed: Tables, names: _Names, path: str) -> DataFrame:
        """The batch's rows as stored keys: table, id, change, and the foreign keys in the
        order of the table's constraints."""
        parts = [_nothing(self.spark, STAGED)]
        for tables, sign in ((added, 1), (removed, -1)):
            if unknown := {*tables} - {*schemas.SCHEMAS}:
                raise ValueError(f"no such tables: {', '.join(sorted(unknown))}")
            for name, rows in tables.items():
                fks = names.of(name)
                held = conform(rows, name) if any(map(names.of, tables)) else rows
                parts.append(held.select(
                    F.lit(names.tables.index(name)).alias("table"), F.col(schemas.PRIMARY_KEYS[name]).cast("long").alias("id"),
                    F.lit(sign).cast("long").alias("change"),
                    F.array(*[F.col(fk[1]).cast("long") for fk in fks]).cast("array<bigint>").alias("fks"),
                ))
        _union(parts).write.options(**STORED).parquet(path)
        return self.spark.read.schema(STAGED).parquet(path)

    def apply(self, added: Tables, removed: Tables | None = None, foreign_keys: Iterable[ForeignKey] | None = None) -> DeltaAudit:
        """The state after a batch of rows ``added`` to and ``removed`` from tables, by
        name; tables without changes are left out. A changed row is removed as it was and
        added as it is, as change feeds give it. Batches are applied one at a time."""
        fks = list(foreign_keys if foreign_keys is not None else schemas.FOREIGN_KEYS)
        size = sum(stored_bytes(rows) for tables in (added, removed or {}) for rows in tables.values())
        logs = sum(stored_bytes(self._log(name, f"{self.root}/{name}")) for name in LOGS) if self.versions else 0
        with small_tasks(self.spark, size + logs, self.buckets):
            return self._applied(added, removed or {}, fks)

    def _applied(self, added: Tables, removed: Tables, fks: Sequence[ForeignKey]) -> DeltaAudit:
        version, names = uuid.uuid4().hex, _Names(fks)
        aside = f"{self.root}/staged/{version}"
        staged = self._staged(added, removed, names, f"{aside}/rows")
        keys = staged.select("table", F.col("id").alias("fk_value"), "change")
        refs = names.references(staged)
        self._append_numbered("keys", keys, names, version)
        self._append_numbered("refs", refs, names, version)

        old_pk, old_fk = self._violations("pk"), self._violations("fk")
        parents = names.touched([*added, *removed])
        kept = self._kept(staged, keys, refs, old_pk, old_fk, names, parents, f"{aside}/keys")
        self._delete(f"{aside}/rows")
        pk = kept.filter("rows is not null").select(names.table().alias("parent"), "fk_value", "rows")

        named = lambda chosen: kept.filter(chosen).select(names.table().alias("parent"), "fk_value")
        absent = kept.filter("absent").select("table", "fk_value")
        met = self._without_parent(version, absent, names, f"{aside}/refs")
        fk = met.select(names.table().alias("parent"), "fk_value", names.constraint().alias("constraint"), "child_id", "rows")
        if self.versions:
            concerned = old_fk.unionByName(self._touched("refs", named("gone")).select(*REFERENCE, F.col("change").alias("rows")))
            absent = named("absent")
            fk = _union([fk, concerned.join(absent, PAIR, "left_semi"), old_fk.filter(~F.col("parent").isin(names.tables))])
            fk = fk.groupBy(*REFERENCE).agg(F.sum("rows").alias("rows"))
        after = self._commit(version, pk, fk.filter("rows > 0"))
        self._delete(aside)
        return after

    def _without_parent(self, version: str, absent: DataFrame, names: _Names, path: str) -> DataFrame:
        """The references of the batch, numbered, to the keys ``absent``. Those to tables
        that lack few keys meet them where they are stored, so that a key that many name
        is in all tasks; the others are shuffled, a part of the buckets after the other."""
        lacking = {r["table"]: r["count"] for r in absent.groupBy("table").count().collect()}
        few, many = ([t for t, n in lacking.items() if (n <= FEW_KEYS) == x] for x in (True, False))
        of = lambda tables: F.col("parent").isin([names.tables[t] for t in tables])
        stored = self._log("refs", f"{self.root}/refs/bucket=*/version={version}").filter(of(lacking))
        # what a batch stores is a row more or a row less
        kind = names.constraint_code(F.col("constraint")) * 2 + (F.col("change") < 0).cast("int")
        numbered = [names.code(F.col("parent")).alias("table"), "fk_value", kind.alias("kind"), "child_id"]
        absent = absent.withColumn("bucket", self._bucket(names.table()))
        rounds = max(1, min(-(-stored_bytes(stored) // ROUND_BYTES), MOST_ROUNDS, self.buckets))

        def met(round_: int, tables: list[int], how: str) -> DataFrame:
            now = F.col("bucket") % rounds == round_
            keys = absent.filter(now & F.col("table").isin(tables)).drop("bucket")
            refs = stored.filter(now & of(tables)).select(*numbered)
            left = refs.join(keys.hint(how), ["table", "fk_value"], "left_semi")
            change = F.when(F.col("kind") % 2 == 1, -1).otherwise(1).cast("long")
            left = left.select("table", "fk_value", F.shiftright("kind", 1).alias("constraint"), "child_id", change.alias("change"))
            return left.groupBy("table", "fk_value", "constraint", "child_id").agg(F.sum("change").alias("rows"))

        # far fewer keys than references: they are the hash table of a task
        parts = [_union([met(i, few, "broadcast"), met(i, many, "shuffle_hash")]) for i in range(rounds)]
        if rounds == 1:
            return parts[0]
        for part in parts:
            part.write.mode("append").options(**STORED).parquet(path)
        return self.spark.read.schema(MET).parquet(path)

    def _kept(
        self, staged: DataFrame, keys: DataFrame, refs: DataFrame, old_pk: DataFrame, old_fk: DataFrame, names: _Names, parents: list[str], path: str
    ) -> DataFrame:
        """Of the keys that the batch holds or that were violated, those that are violated
        now (with their ``rows``) and those that no row has: ``absent``, and ``gone`` if one
        had before."""
        if staged.count() <= FEW_ROWS:
            pairs = keys.select("table", "fk_value").unionByName(refs.select("table", "fk_value")).distinct()
            committed = self._touched("keys", pairs.select(names.table().alias("parent"), "fk_value"))
        else:
            committed = self._committed("keys").filter(F.col("parent").isin(parents))
        none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")

        def part(rows: DataFrame, table: Column, was=zero, change=zero, old=none, flags: int = 0) -> DataFrame:
            return rows.select(
                table.alias("table"), "fk_value", was.alias("was"), change.alias("change"), old.alias("old"), F.lit(flags).alias("flags")
            )

        coded = names.code(F.col("parent"))
        counted = _union([
            part(keys, F.col("table"), change=F.col("change"), flags=TOUCHED),
            part(refs, F.col("table"), flags=TOUCHED),
            part(committed, coded, was=F.col("change")),
            part(old_pk, coded, old=F.col("rows")),
            part(old_fk.filter(F.col("parent").isin(names.tables)), coded, flags=BROKEN),
        ])
        state = counted.groupBy("table", "fk_value").agg(
            F.sum("was").alias("was"), F.sum("change").alias("change"), F.max("old").alias("old"), F.bit_or("flags").alias("flags")
        )
        now, touched = F.col("was") + F.col("change"), F.col("flags").bitwiseAND(TOUCHED) > 0
        wrong = (now > 1) | (F.col("fk_value").isNull() & (now > 0))
        kept = state.select(
            "table", "fk_value", F.when(touched, F.when(wrong, now)).otherwise(F.col("old")).alias("rows"),
            F.when(touched, now <= 0).otherwise(F.col("flags") > 0).alias("absent"),
            (touched & (F.col("was") > 0) & (now <= 0)).alias("gone"),
        ).filter("rows is not null or absent")
        kept.write.options(**STORED).parquet(path)
        return self.spark.read.schema(KEPT).parquet(path)

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)

    def compact(self, root: str) -> DeltaAudit:
        """The same state in another folder, its logs summed up to one batch."""
        version = uuid.uuid4().hex
        other = DeltaAudit(self.spark, root, (), self.buckets)
        for name, columns in (("keys", PAIR), ("refs", REFERENCE)):
            other._append(name, _net(self._committed(name), columns), version)
        return other._commit(version, self._violations("pk"), self._violations("fk"))

    # --- results --------------------------------------------------------------------

    def audit_pk(self) -> DataFrame:
        """As ``audit.audit_pk`` of the tables as they are now."""
        return self._violations("pk").select(F.col("parent").alias("table_name"), F.col("fk_value").alias("key_value"), "rows")

    def audit_fk(self) -> DataFrame:
        """As ``audit.audit_fk`` of the tables as they are now (rows that repeat a child
        id and its reference repeat here too)."""
        each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
        return self._violations("fk").select("constraint", "child_id", "fk_value", each).drop("col")
