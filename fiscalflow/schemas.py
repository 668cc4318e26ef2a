"""Schemas of the invoice model, its fixed code tables and integrity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


STATES = _schema(("id", LongType()), ("name", StringType()))
CITIES = _schema(("id", LongType()), ("name", StringType()), ("state_id", LongType()))
USERS = _schema(("id", LongType()), ("name", StringType()), ("email", StringType()))
TASK_DEFINITIONS = _schema(("id", LongType()), ("name", StringType()))
STATUS = _schema(("id", LongType()), ("name", StringType()))
BILLING_REPORTS = _schema(
    ("id", LongType()),
    ("total_value", DoubleType()),
    ("supplier_identification_number", StringType()),
    ("customer_identification_number", StringType()),
)
PROCESS_INSTANCES = _schema(("id", LongType()), ("type", StringType()))
TAX_DOCUMENTS = _schema(
    ("id", LongType()),
    ("number", LongType()),
    ("type", StringType()),
    ("total_value", DoubleType()),
    ("supplier_identification_number", StringType()),
    ("customer_identification_number", StringType()),
    ("supplier_state_id", LongType()),
    ("customer_state_id", LongType()),
    ("supplier_city_id", LongType()),
    ("customer_city_id", LongType()),
    ("process_instance_id", LongType()),
)
ITEMS = _schema(
    ("id", LongType()),
    ("description", StringType()),
    ("unit_price", DoubleType()),
    ("total_value", DoubleType()),
    ("purchase_order", StringType()),
    ("tax_document_id", LongType()),
)
TASKS = _schema(
    ("id", LongType()),
    ("created_at", TimestampNTZType()),
    ("completed_at", TimestampNTZType()),
    ("task_definition_id", LongType()),
    ("status_id", LongType()),
    ("assing_to_id", LongType()),  # column name as in the source model (sic)
    ("completed_by_id", LongType()),
    ("process_instance_id", LongType()),
)

SCHEMAS: dict[str, StructType] = {
    "states": STATES,
    "cities": CITIES,
    "users": USERS,
    "task_definitions": TASK_DEFINITIONS,
    "status": STATUS,
    "billing_reports": BILLING_REPORTS,
    "process_instances": PROCESS_INSTANCES,
    "tax_documents": TAX_DOCUMENTS,
    "items": ITEMS,
    "tasks": TASKS,
}

# ---------------------------------------------------------------------------
# Fixed values. These must equal the source system's code tables and rules
# for results to match; they are stated here as plain data.
# ---------------------------------------------------------------------------

# Task definitions: (id, name).
TASK_DEFINITION_ROWS = [
    (10, "Verificação de Nota Duplicada"),
    (11, "Verificação de Divergências na Nota"),
    (12, "Escrituração da Nota"),
    (13, "Pagamento da Nota"),
]

# Task status codes: (id, name).
STATUS_ROWS = [
    (100, "Nota Duplicada"),
    (101, "Nota não é Duplicada"),
    (110, "Nota com Divergência"),
    (111, "Nota sem Divergência"),
    (120, "Nota Escriturada com Sucesso"),
    (121, "Nota não Escriturada"),
    (130, "Nota Paga"),
    (131, "Nota não Paga"),
]

# Valid (task definition -> statuses) pairs of the workflow.
VALID_STATUS_BY_TASK = {
    10: [100, 101],
    11: [110, 111],
    12: [120, 121],
    13: [130, 131],
}

# Document types.
DOCUMENT_TYPES = ["MaterialInvoice", "ServiceInvoice", "TransportationInvoice"]

# The posting report's business rule: material invoices whose posting task
# (definition 12) finished successfully (status 120).
REPORT_DOCUMENT_TYPE = "MaterialInvoice"
POSTING_TASK_ID = 12
POSTING_SUCCESS_STATUS_ID = 120

# Default state for a city missing from the lookup.
DEFAULT_STATE_ID = 1

# Primary keys (all tables use ``id``) and foreign keys:
# (child table, child column, parent table).
PRIMARY_KEYS = {name: "id" for name in SCHEMAS}
FOREIGN_KEYS = [
    ("cities", "state_id", "states"),
    ("tax_documents", "supplier_state_id", "states"),
    ("tax_documents", "customer_state_id", "states"),
    ("tax_documents", "supplier_city_id", "cities"),
    ("tax_documents", "customer_city_id", "cities"),
    ("tax_documents", "process_instance_id", "process_instances"),
    ("items", "tax_document_id", "tax_documents"),
    ("tasks", "task_definition_id", "task_definitions"),
    ("tasks", "status_id", "status"),
    ("tasks", "assing_to_id", "users"),
    ("tasks", "completed_by_id", "users"),
    ("tasks", "process_instance_id", "process_instances"),
]


def _sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"CAST({v} AS BIGINT)"


def inline_table(spark: SparkSession, rows, columns: list[str]) -> DataFrame:
    """A fixed table as an inline VALUES relation: planned as a local relation with
    exact size statistics, so joins against it are broadcast from the first plan."""
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def task_definitions_df(spark: SparkSession) -> DataFrame:
    """The four task definitions."""
    return inline_table(spark, TASK_DEFINITION_ROWS, ["id", "name"])


def status_df(spark: SparkSession) -> DataFrame:
    """The eight status codes."""
    return inline_table(spark, STATUS_ROWS, ["id", "name"])


def valid_pairs_df(spark: SparkSession) -> DataFrame:
    """(task_definition_id, status_id) pairs allowed by the workflow (8 rows)."""
    rows = [(t, s) for t, statuses in VALID_STATUS_BY_TASK.items() for s in statuses]
    return inline_table(spark, rows, ["task_definition_id", "status_id"])
