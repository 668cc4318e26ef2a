"""The posting report in Spark SQL with named parameters.

The same plan as ``report.report_last_month`` for users who work in SQL: the model
tables are passed as DataFrame arguments (``{tax_documents}``) and the business
values as parameter markers (``:as_of``), so nothing is formatted into the text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from fiscalflow import schemas
from fiscalflow.sources.model import Model

REPORT_SQL = """
WITH posted AS (
  SELECT process_instance_id, completed_at
  FROM {tasks}
  WHERE completed_at >= CAST(trunc(add_months(:as_of, -1), 'MM') AS TIMESTAMP_NTZ)
    AND completed_at < CAST(trunc(:as_of, 'MM') AS TIMESTAMP_NTZ)
    AND status_id = :status_id AND task_definition_id = :task_id
), invoices AS (
  SELECT id, number, completed_at,
         supplier_identification_number AS supplier_id, supplier_city_id,
         customer_identification_number AS customer_id, customer_city_id
  FROM posted JOIN {tax_documents} USING (process_instance_id)
  WHERE type = :document_type
), places AS (
  SELECT id AS place_id, name AS place FROM {cities}
), from_place AS (
  SELECT invoices.*, place AS supplier_city
  FROM invoices JOIN places ON place_id = supplier_city_id
), report_rows AS (
  SELECT DISTINCT id, number, supplier_id, supplier_city, customer_id, place AS customer_city, completed_at
  FROM from_place JOIN places ON place_id = customer_city_id
), ordered_pairs AS (
  SELECT DISTINCT tax_document_id AS id, purchase_order
  FROM {items}
  WHERE tax_document_id IN (SELECT id FROM report_rows)
), order_lists AS (
  SELECT id, array_join(array_sort(collect_list(purchase_order)), ', ') AS purchase_orders
  FROM ordered_pairs
  WHERE purchase_order IS NOT NULL
  GROUP BY id
)
SELECT id, number, purchase_orders, supplier_id, supplier_city, customer_id, customer_city,
       concat_ws('/', lpad(day(completed_at), 2, '0'), lpad(month(completed_at), 2, '0'),
                 lpad(year(completed_at), 4, '0')) AS posted_on
FROM report_rows LEFT JOIN order_lists USING (id)
ORDER BY completed_at DESC, id
"""


def report_last_month_sql(spark: SparkSession, model: Model, as_of: dt.date | str) -> DataFrame:
    """``REPORT_SQL`` bound to the model tables and ``as_of``."""
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return spark.sql(
        REPORT_SQL,
        args={
            "as_of": as_of,
            "document_type": schemas.REPORT_DOCUMENT_TYPE,
            "task_id": schemas.POSTING_TASK_ID,
            "status_id": schemas.POSTING_SUCCESS_STATUS_ID,
        },
        tax_documents=model.tax_documents,
        tasks=model.tasks,
        cities=model.cities,
        items=model.items,
    )
