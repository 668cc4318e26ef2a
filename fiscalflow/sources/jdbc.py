"""Parallel JDBC reads of the operational database.

A JDBC read without a partition column runs in a single task; reading the model splits
the key range of every large table into ``num_partitions`` range predicates on ``id``
and refuses to read one unsplit.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from fiscalflow import schemas
from fiscalflow.sources.model import Model, conform, model_from_tables


def jdbc_options(
    url: str,
    table: str,
    user: str | None = None,
    password: str | None = None,
    partition_column: str | None = "id",
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
    driver: str = "org.postgresql.Driver",
) -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")``.

    Range partitioning is used when bounds and a partition count are given.
    """
    opts = {
        "url": url,
        "dbtable": table,
        "driver": driver,
        "fetchsize": str(fetch_size),
        "preferTimestampNTZ": "true",
    }
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if partition_column and None not in (lower_bound, upper_bound, num_partitions):
        opts.update(
            partitionColumn=partition_column,
            lowerBound=str(lower_bound),
            upperBound=str(upper_bound),
            numPartitions=str(num_partitions),
        )
    return opts


def read_jdbc_table(spark: SparkSession, name: str, **options) -> DataFrame:
    """Read one model table over JDBC, conformed to the model schema."""
    df = spark.read.format("jdbc").options(**jdbc_options(table=name, **options)).load()
    return conform(df, name)


# Tables that grow with the business; the others are read in one task.
LARGE_TABLES = ("process_instances", "billing_reports", "tax_documents", "items", "tasks")

# Environment variables of the connection (fixed names) and their defaults.
ENVIRONMENT = {
    "DB_HOST": "localhost", "DB_PORT": "5432", "DB_NAME": None, "DB_USER": None, "DB_PASSWORD": None,
}


def connection_from_env(env: Mapping[str, str]) -> dict[str, str | None]:
    """``url``, ``user`` and ``password`` from environment variables; a missing database
    name, user or password is an error."""
    given = {k: env.get(k) or default for k, default in ENVIRONMENT.items()}
    if missing := [k for k, v in given.items() if v is None]:
        raise ValueError(f"set {', '.join(missing)}")
    return {
        "url": f"jdbc:postgresql://{given['DB_HOST']}:{given['DB_PORT']}/{given['DB_NAME']}",
        "user": given["DB_USER"],
        "password": given["DB_PASSWORD"],
    }


def parse_key_range(text: str) -> tuple[str, tuple[int, int, int]]:
    """``table=lower:upper:partitions``."""
    name, _, numbers = text.partition("=")
    lower, upper, partitions = (int(x) for x in numbers.split(":"))
    if name not in schemas.SCHEMAS or lower > upper or partitions < 1:
        raise ValueError(f"not a key range: {text}")
    return name, (lower, upper, partitions)


def read_jdbc_model(
    spark: SparkSession,
    url: str,
    key_ranges: dict[str, tuple[int, int, int]] | None = None,
    **options,
) -> Model:
    """Read the whole model over JDBC.

    ``key_ranges`` maps a table name to ``(lower, upper, num_partitions)`` for its
    ``id`` column. Every large table must have one: without it the whole table would be
    read by a single task, which is refused.
    """
    key_ranges = key_ranges or {}
    if unsplit := [n for n in LARGE_TABLES if n not in key_ranges]:
        raise ValueError(f"give key ranges for {', '.join(unsplit)}: each would be read by one task")
    tables = {}
    for name in schemas.SCHEMAS:
        lo, hi, n = key_ranges.get(name, (None, None, None))
        tables[name] = read_jdbc_table(
            spark, name, url=url, lower_bound=lo, upper_bound=hi, num_partitions=n, **options
        )
    return model_from_tables(spark, tables)
