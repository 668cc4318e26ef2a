"""Readers and the mapping of the driver's tables onto the invoice model."""

from fiscalflow.sources.model import Model, model_from_tables
from fiscalflow.sources.parquet import read_model, read_table
from fiscalflow.sources.tpch import model_from_tpch

__all__ = ["Model", "model_from_tables", "model_from_tpch", "read_model", "read_table"]
