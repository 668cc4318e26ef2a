"""Null-safe list membership (the dashboard's multi-select semantics)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def isin_filter(c, values: Iterable) -> Column:
    """True when the value is in ``values``; a None in ``values`` matches null cells.

    SQL ``x IN (...)`` is null for a null ``x`` and an empty list matches nothing;
    this gives the multi-select behaviour: an empty selection keeps no row. For use in
    a filter: a null result drops the row like false, and the plain ``IN`` reaches the
    scan.
    """
    col = F.col(c) if isinstance(c, str) else c
    values = list(values)
    non_null = [v for v in values if v is not None]
    has_null = len(non_null) != len(values)
    pred = col.isin(non_null) if non_null else F.lit(False)
    return pred | col.isNull() if has_null else pred


def isin_null_safe(c, values: Iterable) -> Column:
    """``isin_filter`` as a boolean column that is never null."""
    return F.coalesce(isin_filter(c, values), F.lit(False))
