"""Numeric expressions: half-even rounding, safe ratios, amount parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dbl(col: str | Column) -> Column:
    return _c(col).cast("double")


def round_even(col: str | Column, scale: int) -> Column:
    """Half-even rounding of a double (numpy/pandas ``round`` semantics)."""
    return F.bround(dbl(col), scale)


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double, NULL when den is 0 or NULL (never raises)."""
    return F.try_divide(dbl(num), F.nullif(dbl(den), F.lit(0.0)))


def pct_change(cur: str | Column, prev: str | Column) -> Column:
    """cur / prev - 1, times 100; NULL when prev is 0 or missing."""
    return (ratio(cur, prev) - F.lit(1.0)) * F.lit(100.0)


def share_pct(part: str | Column, total: str | Column) -> Column:
    """part / total * 100; NULL when total is 0 or missing."""
    return ratio(part, total) * F.lit(100.0)


def growth_pct(cur: str | Column, prev: str | Column) -> Column:
    """(cur - prev) / prev * 100, rounded to 2, 0 when prev is 0 or missing."""
    g = ratio(dbl(cur) - dbl(prev), prev) * F.lit(100.0)
    return F.when(_c(prev).isNull() | (dbl(prev) == 0), F.lit(0.0)).otherwise(F.bround(g, 2))


# Accepted amount shape after commas and blanks are removed: an optional
# prefix without digits (currency symbol, code, sign or opening bracket), one
# decimal number with optional exponent, and an optional suffix without digits.
AMOUNT_PATTERN = r"^([^0-9.]*)([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?|[0-9]+\.)[^0-9.]*$"


def parse_amount(col: str | Column, parity: bool = False) -> Column:
    """Money text -> double (NULL when it does not parse).

    Default: thousands separators and blanks removed, the whole value must
    match ``AMOUNT_PATTERN``; a ``-`` or ``(`` in the prefix makes it negative.
    ``parity=True``: delete every character except digits and ``.`` and cast,
    which loses signs and exponents (``-5`` -> 5, ``1e-05`` -> 105).
    """
    s = _c(col).cast("string")
    if parity:
        digits = F.regexp_replace(s, r"[^0-9.]", "")
        return _try_double(F.nullif(digits, F.lit("")))
    compact = F.regexp_replace(s, r"[,\s]", "")
    ok = compact.rlike(AMOUNT_PATTERN)
    prefix = F.regexp_extract(compact, AMOUNT_PATTERN, 1)
    number = _try_double(F.regexp_extract(compact, AMOUNT_PATTERN, 2))
    sign = F.when(prefix.contains("-") | prefix.contains("("), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(ok, number * sign)


def _try_double(col: Column) -> Column:
    return col.try_cast("double")


def sig_round(col: str | Column, digits: int = 12) -> Column:
    """Round a double to ``digits`` significant digits.

    Used on floating aggregates (averages / sums of doubles) whose last bits
    depend on the order in which partitions are combined, so that results are
    reproducible across runs and engines."""
    c = _c(col)
    return F.when(c.isNotNull(), F.format_string(f"%.{digits - 1}e", c).cast("double"))
