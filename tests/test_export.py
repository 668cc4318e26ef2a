"""Exports: header, naming, nothing written when empty."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from conftest import AS_OF

from fiscalflow.operators.export import export_filtered, export_report
from fiscalflow.operators.fact import build_fact
from fiscalflow.operators.filters import FilterSpec, apply_filters
from fiscalflow.operators.report import report_last_month


def test_export_report_csv(spark, seed):
    base = tempfile.mkdtemp(prefix="ff-export-")
    path = export_report(report_last_month(seed, AS_OF), base, AS_OF)
    assert path.endswith("relatorio_notas_2024-03-15")
    back = spark.read.option("header", True).csv(path)
    assert back.columns[:3] == ["id", "number", "purchase_orders"]
    assert back.count() == 2
    # same-day rerun overwrites
    assert export_report(report_last_month(seed, AS_OF), base, AS_OF) == path
    assert spark.read.option("header", True).csv(path).count() == 2


def test_export_nothing_when_empty(spark, seed):
    base = tempfile.mkdtemp(prefix="ff-export-")
    empty = report_last_month(seed, dt.date(2030, 1, 1))
    assert export_report(empty, base, dt.date(2030, 1, 1)) is None
    assert os.listdir(base) == []
    nothing = apply_filters(build_fact(seed), FilterSpec(types=[]))
    assert export_filtered(nothing, base, dt.datetime(2024, 3, 15, 9, 5)) is None


def test_export_filtered_partitioned(spark, seed):
    base = tempfile.mkdtemp(prefix="ff-export-")
    fact = apply_filters(build_fact(seed), FilterSpec())
    path = export_filtered(fact, base, dt.datetime(2024, 3, 15, 9, 5))
    assert path.endswith("relatorio_fiscal_20240315_0905")
    assert sorted(os.listdir(path))[0] == "_SUCCESS" or "posted_month=2024-02" in os.listdir(path)
    assert "posted_month=2024-02" in os.listdir(path)
    assert spark.read.parquet(path).count() == 2


def test_export_with_original_titles(spark, seed):
    base = tempfile.mkdtemp(prefix="ff-export-")
    path = export_report(report_last_month(seed, AS_OF), base, AS_OF, titles=True)
    header = spark.read.option("header", True).csv(path).columns
    assert header == ["ID Nota Fiscal", "Número da Nota", "Pedidos de Compra", "CNPJ Fornecedor",
                      "Cidade Fornecedor", "CNPJ Tomador", "Cidade Tomador", "Data Escrituração"]
    fact = apply_filters(build_fact(seed), FilterSpec())
    path = export_filtered(fact, base, dt.datetime(2024, 3, 15, 9, 5), titles=True)
    cols = spark.read.parquet(path).columns
    assert "tipo_nota" in cols and "lead_time_horas" in cols and "posted_month" in cols
