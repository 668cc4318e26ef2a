"""KPI display labels (``R$ 1,234.50``, ``3.2 h``), built from Spark's own expressions.

``format_number`` rounds the binary value correctly, ties to even, as the display
format does (``format_string`` would round 3.25 to 3.3). Hours carry no separators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def brl_label(value) -> Column:
    return F.concat(F.lit("R$ "), F.format_number(value, 2))


def hours_label(value) -> Column:
    return F.concat(F.translate(F.format_number(value, 1), ",", ""), F.lit(" h"))


def kpi_labels(kpi_row: DataFrame) -> DataFrame:
    """Spend and mean lead time as display text, next to the numbers."""
    return kpi_row.select(
        "spend",
        "mean_lead_time_hours",
        brl_label("spend").alias("spend_label"),
        hours_label("mean_lead_time_hours").alias("lead_time_label"),
    )
