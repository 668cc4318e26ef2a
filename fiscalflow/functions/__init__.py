"""Column-expression helpers, all of built-in Spark expressions (no UDF)."""

from fiscalflow.functions.cnpj import mask_cnpj, unmask_cnpj, zfill
from fiscalflow.functions.dates import (
    format_ddmmyyyy,
    lead_time_hours,
    month_offset,
    posting_day,
    previous_month_bounds,
    previous_month_window,
    shift_time,
)
from fiscalflow.functions.membership import isin_null_safe
from fiscalflow.functions.money import (
    even_split,
    as_money,
    money_sum,
    round_money,
    to_cents,
)

__all__ = [
    "even_split",
    "format_ddmmyyyy",
    "isin_null_safe",
    "lead_time_hours",
    "mask_cnpj",
    "as_money",
    "money_sum",
    "month_offset",
    "posting_day",
    "previous_month_bounds",
    "previous_month_window",
    "round_money",
    "shift_time",
    "to_cents",
    "unmask_cnpj",
    "zfill",
]
