"""Money arithmetic. Amounts are stored as doubles; sums and rounding go through
exact decimals so every engine agrees to the last digit. Sums keep six decimals, so
that amounts below a cent are not rounded away one by one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
SUMMAND = "decimal(24,6)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_money(c) -> Column:
    """The amount as DECIMAL(18,2)."""
    return _col(c).cast(MONEY)


def money_sum(c) -> Column:
    """Exact sum of an amount column as a double; 0.0 when every value is null or
    there are no rows (aggregate expression)."""
    return F.coalesce(F.sum(_col(c).cast(SUMMAND)), F.lit(0).cast(SUMMAND)).cast("double")


def round_money(c, scale: int = 2) -> Column:
    """Round half-up to ``scale`` decimals. Pass a decimal expression (e.g. built
    from ``as_money``) so the rounding is exact rather than on a binary double."""
    return F.round(_col(c), scale)


def to_cents(c) -> Column:
    """Integer cents of an amount."""
    return (as_money(c) * 100).cast("long")


def even_split(total, parts) -> Column:
    """Each part of ``total`` split evenly over ``parts`` lines, rounded half-up to
    the cent, computed in integer cents: ``(2 * cents + n) div (2 * n)``."""
    n = _col(parts).cast("long")
    num = to_cents(total) * 2 + n
    # floor division in longs: ``div`` truncates, and the remainder is taken off first
    share_cents = F.call_function("div", num - F.pmod(num, n * 2), n * 2)
    return F.when(n > 0, (share_cents.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("double"))
