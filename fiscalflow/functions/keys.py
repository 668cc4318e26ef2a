"""Key construction and code lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefixed_key(prefix: str, number) -> Column:
    """``prefix`` followed by the number's digits, e.g. 'PO-' + 17 = 'PO-17'."""
    return F.concat(F.lit(prefix), _col(number).cast("string"))


def composite_key(parent, position, factor: int = 10) -> Column:
    """A child key derived from its parent: ``parent * factor + position``."""
    return _col(parent) * factor + _col(position)


def lookup_with_default(
    df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default, alias: str
) -> DataFrame:
    """Left-join a code table and fall back to ``default`` when the key is missing
    or null (a dictionary ``get(key, default)``). The planner broadcasts the code table
    when its measured size allows."""
    codes = table.select(F.col(table_key).alias("_lk"), F.col(value).alias("_lv"))
    return (
        df.join(codes, F.col(key) == F.col("_lk"), "left")
        .withColumn(alias, F.coalesce(F.col("_lv"), F.lit(default)))
        .drop("_lk", "_lv")
    )
