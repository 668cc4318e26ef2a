"""Integrity rules of the source database, run as data audits.

A relational database enforces primary and foreign keys on write; files in a lake
do not, so a Spark user checks them. Each audit returns the violating rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalflow import schemas
from fiscalflow.sources.model import Model


def duplicate_or_null_keys(df: DataFrame, key: str = "id") -> DataFrame:
    """Key values that occur more than once, or are null, with their row count."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter((F.col("rows") > 1) | F.col(key).isNull())
    )


def audit_pk(model: Model, tables: Iterable[str] | None = None) -> DataFrame:
    """(table_name, key_value, rows) for every primary-key violation."""
    names = list(tables) if tables is not None else model.names()
    parts = [
        duplicate_or_null_keys(model.table(n), schemas.PRIMARY_KEYS[n]).select(
            F.lit(n).alias("table_name"),
            F.col(schemas.PRIMARY_KEYS[n]).cast("long").alias("key_value"),
            "rows",
        )
        for n in names
    ]
    return reduce(DataFrame.unionByName, parts)


def orphans(child: DataFrame, fk: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose non-null ``fk`` has no parent (left anti join; the parent
    side is broadcast by the planner when it is a small dimension)."""
    keys = parent.select(F.col(parent_key).alias(fk))
    return child.filter(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def constraint_name(child: str, column: str, parent: str) -> str:
    return f"{child}.{column} -> {parent}"


ForeignKey = tuple[str, str, str]


def references(model: Model, foreign_keys: Iterable[ForeignKey]) -> DataFrame:
    """``(constraint, parent, child_id, fk_value)``: every non-null foreign key. Each child
    table is read once, its keys exploded."""
    by_child: dict[str, list[ForeignKey]] = {}
    for fk in foreign_keys:
        by_child.setdefault(fk[0], []).append(fk)
    parts = []
    for child, fks in by_child.items():
        keys = F.array(
            *[
                F.struct(F.lit(constraint_name(*fk)).alias("constraint"), F.lit(fk[2]).alias("parent"), F.col(fk[1]).cast("long").alias("fk_value"))
                for fk in fks
            ]
        )
        rows = model.table(child).select(F.col("id").cast("long").alias("child_id"), F.explode(keys).alias("r"))
        parts.append(rows.select("r.constraint", "r.parent", "child_id", "r.fk_value").filter("fk_value is not null"))
    return reduce(DataFrame.unionByName, parts)


def parent_keys(model: Model, foreign_keys: Iterable[ForeignKey]) -> DataFrame:
    """``(parent, fk_value)``: the keys of every referenced table, each table once."""
    parents = dict.fromkeys(fk[2] for fk in foreign_keys)
    return reduce(
        DataFrame.unionByName,
        [model.table(p).select(F.lit(p).alias("parent"), F.col(schemas.PRIMARY_KEYS[p]).cast("long").alias("fk_value")) for p in parents],
    )


def audit_fk(model: Model, foreign_keys: Iterable[ForeignKey] | None = None) -> DataFrame:
    """(constraint, child_id, fk_value) for every foreign-key violation; a null foreign
    key is allowed.

    All constraints are one anti join on (parent table, key), which the optimizer runs
    once per child table: each child is read once and its keys cross one exchange, however
    many constraints it has, and the parents' keys are one exchange that all of them read.
    A key that holds a third of the references is a skewed partition of the child side,
    which AQE splits."""
    fks = list(foreign_keys if foreign_keys is not None else schemas.FOREIGN_KEYS)
    return (
        references(model, fks).join(parent_keys(model, fks), ["parent", "fk_value"], "left_anti")
        .select("constraint", "child_id", "fk_value")
    )


def audit_status_pairs(model: Model, spark: SparkSession | None = None) -> DataFrame:
    """Tasks whose (definition, status) pair is not allowed by the workflow.

    A task with a null definition or status is not reported here (the foreign-key
    audit and the null checks cover it).
    """
    spark = spark or model.tasks.sparkSession
    pairs = schemas.valid_pairs_df(spark)
    return (
        model.tasks.filter(
            F.col("task_definition_id").isNotNull() & F.col("status_id").isNotNull()
        )
        .join(pairs, ["task_definition_id", "status_id"], "left_anti")
        .select("id", "task_definition_id", "status_id")
    )
