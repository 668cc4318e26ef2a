"""The dashboard fact: one row per (document, task) pair of the same process.

Grain: documents x tasks is M:N over ``process_instance_id``; a document is counted
once per task of its process (the source dashboard's behaviour, kept on purpose).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalflow.functions.cnpj import mask_cnpj
from fiscalflow.functions.dates import lead_time_hours, posting_day
from fiscalflow.sources.model import Model

FACT_COLUMNS = [
    "id",
    "total_value",
    "document_type",
    "task_name",
    "task_status",
    "supplier_cnpj",
    "supplier_city",
    "supplier_state",
    "created_at",
    "completed_at",
    "lead_time_hours",
    "posted_on",
    "supplier_cnpj_masked",
]


def supplier_geography(model: Model) -> DataFrame:
    """city id -> (city name, state name); a city without a known state keeps a null
    state. The planner broadcasts it by its measured size; a geography too large for
    that is a shuffle join on the city, whose hot cities AQE splits."""
    states = model.states.select(
        F.col("id").alias("state_id"), F.col("name").alias("supplier_state")
    )
    return model.cities.select(
        F.col("id").alias("city_id"), F.col("name").alias("supplier_city"), "state_id"
    ).join(states, "state_id", "left").drop("state_id")


def docs_tasks_join(model: Model, docs: DataFrame | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """Inner equi-join of documents and tasks on ``process_instance_id`` (M:N).

    A shuffle join on the process id; a null id never matches. A hot process id is
    split by AQE's skew-join handling (the other side's partition is replicated).
    """
    docs = model.tax_documents if docs is None else docs
    tasks = model.tasks if tasks is None else tasks
    return docs.join(tasks, "process_instance_id", "inner")


def build_fact(model: Model, with_process: bool = False) -> DataFrame:
    """The 13-column fact (10 queried + lead time, posting day, masked CNPJ); with the
    process id as a last column if ``with_process``."""
    docs = model.tax_documents.select(
        "process_instance_id",
        "id",
        "total_value",
        F.col("type").alias("document_type"),
        F.col("supplier_identification_number").alias("supplier_cnpj"),
        "supplier_city_id",
    )
    tasks = model.tasks.select(
        "process_instance_id", "created_at", "completed_at", "task_definition_id", "status_id"
    )
    task_names = model.task_definitions.select(
        F.col("id").alias("task_definition_id"), F.col("name").alias("task_name")
    )
    status_names = model.status.select(
        F.col("id").alias("status_id"), F.col("name").alias("task_status")
    )
    geo = supplier_geography(model)
    joined = (
        docs_tasks_join(model, docs, tasks)
        .join(task_names, "task_definition_id", "inner")
        .join(status_names, "status_id", "inner")
        .join(geo, F.col("supplier_city_id") == F.col("city_id"), "left")
    )
    return joined.select(
        "id",
        "total_value",
        "document_type",
        "task_name",
        "task_status",
        "supplier_cnpj",
        "supplier_city",
        "supplier_state",
        "created_at",
        "completed_at",
        lead_time_hours("created_at", "completed_at").alias("lead_time_hours"),
        posting_day("completed_at").alias("posted_on"),
        mask_cnpj("supplier_cnpj").alias("supplier_cnpj_masked"),
        *(["process_instance_id"] if with_process else []),
    )


def display_order(fact: DataFrame) -> DataFrame:
    """The fact in display order: completion ascending with unknown completions
    last (as a database sorts them), ties by id. A global sort - apply it only to
    what is shown or exported, never to the stored fact."""
    return fact.orderBy(F.col("completed_at").asc_nulls_last(), F.col("id").asc())
