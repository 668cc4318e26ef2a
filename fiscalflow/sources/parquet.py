"""Parquet readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalflow import schemas
from fiscalflow.sources.model import COMPLETION_DAY, Model, conform, model_from_tables


def read_table(spark: SparkSession, base: str, name: str, schema: str | None = None) -> DataFrame:
    """Read ``{base}/{name}.parquet`` (a file or a folder of parquet files). With a
    ``schema`` no job reads the files' footers first."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{base.rstrip('/')}/{name}.parquet")


def read_model(spark: SparkSession, base: str, names: list[str] | None = None) -> Model:
    """Read a model stored as one parquet dataset per table under ``base``.

    Tables that a given ``names`` leaves out (default: none) come back empty or, for the
    code tables, as their fixed values; a listed table that does not exist is an error.
    """
    wanted = names if names is not None else list(schemas.SCHEMAS)
    left_out = [n for n in schemas.SCHEMAS if n not in wanted]
    tables = {n: read_table(spark, base, n) for n in wanted}
    model = model_from_tables(spark, tables, left_out)
    if "tasks" in tables and COMPLETION_DAY in tables["tasks"].columns:
        model = Model(conform(tables["tasks"], "tasks", keep=[COMPLETION_DAY]), **{n: model.table(n) for n in model.names()})
    return model


def write_model(model: Model, base: str, mode: str = "errorifexists") -> None:
    """Write every table of ``model`` as ``{base}/{name}.parquet``.

    The large tables are sorted within files by the column their selective
    predicates use, so parquet min/max statistics skip row groups: tasks by
    completion, items by document (the report's semi join), documents by id. Parquet
    compares dates with its statistics, but no zone-less timestamps: tasks carry their
    completion day as a column more, which ``Model.tasks_between`` asks too.
    """
    sort_keys = {
        "tax_documents": ["id"],
        "tasks": ["completed_at"],
        "items": ["tax_document_id"],
    }
    for name in model.names():
        df = model.table(name)
        if name == "tasks":
            df = df.withColumn(COMPLETION_DAY, F.to_date("completed_at"))
        if name in sort_keys:
            df = df.sortWithinPartitions(*sort_keys[name])
        df.write.mode(mode).parquet(f"{base.rstrip('/')}/{name}.parquet")
