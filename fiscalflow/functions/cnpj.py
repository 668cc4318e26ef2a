"""CNPJ (14-digit Brazilian company id) formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CNPJ_DIGITS = 14


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zfill(c, width: int = CNPJ_DIGITS) -> Column:
    """Left-pad with '0' to ``width``; never truncates (plain ``lpad`` would)."""
    v = _col(c)
    return F.when(F.length(v) >= width, v).otherwise(F.lpad(v, width, "0"))


def mask_cnpj(c) -> Column:
    """``AA.AAA.AAA/AAAA-AA``; the tail keeps every character from position 13.

    Null gives '' (the display value of a missing supplier).
    """
    v = zfill(_col(c))
    masked = F.concat(
        F.substring(v, 1, 2),
        F.lit("."),
        F.substring(v, 3, 3),
        F.lit("."),
        F.substring(v, 6, 3),
        F.lit("/"),
        F.substring(v, 9, 4),
        F.lit("-"),
        v.substr(F.lit(13), F.length(v)),
    )
    return F.when(_col(c).isNull(), F.lit("")).otherwise(masked)


def unmask_cnpj(c) -> Column:
    """Remove the mask punctuation ('.', '/', '-')."""
    return F.regexp_replace(_col(c), r"[./-]", "")
