"""File exports of the report and of the filtered fact."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalflow.operators.store import materialize

# ---------------------------------------------------------------------------
# File-name prefixes and the column titles of the original files,
# in output order (used when ``titles=True``).
# ---------------------------------------------------------------------------
REPORT_PREFIX = "relatorio_notas_"
FILTERED_PREFIX = "relatorio_fiscal_"
REPORT_TITLES = {
    "id": "ID Nota Fiscal",
    "number": "Número da Nota",
    "purchase_orders": "Pedidos de Compra",
    "supplier_id": "CNPJ Fornecedor",
    "supplier_city": "Cidade Fornecedor",
    "customer_id": "CNPJ Tomador",
    "customer_city": "Cidade Tomador",
    "posted_on": "Data Escrituração",
}
FACT_TITLES = {
    "id": "id",
    "total_value": "total_value",
    "document_type": "tipo_nota",
    "task_name": "nome_tarefa",
    "task_status": "status_tarefa",
    "supplier_cnpj": "cnpj_fornecedor",
    "supplier_city": "cidade_fornecedor",
    "supplier_state": "estado_fornecedor",
    "created_at": "created_at",
    "completed_at": "completed_at",
    "lead_time_hours": "lead_time_horas",
    "posted_on": "data_escrituracao",
    "supplier_cnpj_masked": "cnpj_formatado",
}


def with_titles(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    """Rename the columns to display titles (columns without a title are kept)."""
    return df.select(*[F.col(c).alias(titles.get(c, c)) for c in df.columns])


def report_path(base_dir: str, as_of: dt.date) -> str:
    """``{base}/relatorio_notas_YYYY-MM-DD`` - a rerun on the same day overwrites."""
    return f"{base_dir.rstrip('/')}/{REPORT_PREFIX}{as_of:%Y-%m-%d}"


def filtered_path(base_dir: str, at: dt.datetime) -> str:
    """``{base}/relatorio_fiscal_YYYYMMDD_HHMM``."""
    return f"{base_dir.rstrip('/')}/{FILTERED_PREFIX}{at:%Y%m%d_%H%M}"


def export_report(
    report: DataFrame, base_dir: str, as_of: dt.date, fmt: str = "csv", titles: bool = False
) -> str | None:
    """Write the report with a header row; write nothing when it is empty.

    Returns the path written, or None for an empty report. The report is written to the
    shared folder first, so it is computed once and survives lost executors; files keep
    the report's order. ``titles`` writes the original display titles as the header.
    """
    if titles:
        report = with_titles(report, REPORT_TITLES)
    stored = materialize(report, "report_export")
    if stored.isEmpty():
        return None
    path = report_path(base_dir, as_of)
    writer = stored.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path


def export_filtered(
    fact: DataFrame,
    base_dir: str,
    at: dt.datetime,
    fmt: str = "parquet",
    partition_by_month: bool = True,
    titles: bool = False,
) -> str | None:
    """Write the filtered fact (all 13 columns), partitioned by posting month
    (``posted_month=yyyy-MM``, rows without a day under the null partition).
    Returns the path, or None when there is nothing to export.

    The selection is written once to the shared folder and everything after - the
    emptiness test, the sampling of the ranges, the export - reads that table."""
    fact = materialize(fact, "filtered_export")
    if fact.isEmpty():
        return None
    path = filtered_path(base_dir, at)
    out = fact
    writer_cols = []
    if partition_by_month:
        out = fact.withColumn("posted_month", F.date_format("posted_on", "yyyy-MM"))
        writer_cols = ["posted_month"]
    # Range-partition on (month, completion) so each task covers a contiguous time
    # range: files ~ tasks + months rather than tasks x months, and a busy month is
    # split over several tasks. Inside files rows are in display order (completion
    # ascending, unknown last).
    order = [F.col("completed_at").asc_nulls_last(), F.col("id").asc()]
    out = out.repartitionByRange(*writer_cols, *order).sortWithinPartitions(*writer_cols, *order)
    if titles:
        out = with_titles(out, FACT_TITLES)
    writer = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if writer_cols:
        writer = writer.partitionBy(*writer_cols)
    writer.save(path)
    return path
