"""Scalar column functions.

All of these build Catalyst expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_", "half_even", "pct_text", "zip_zone", "currency_code", "unit_price",
    "cents", "quarter_bin", "equal_width_bin", "norm_pdf", "fixed_decimals",
]


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: str | Column, digits: int = 0) -> Column:
    """Round half to even on the scaled double, like NumPy's ``round(x, d)``:
    ``rint(x * 10**d) / 10**d``.  (``F.round`` rounds half up: 2.25 -> 2.3,
    while this gives 2.2.)"""
    c = col_(c)
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def pct_text(c: str | Column) -> Column:
    """Text of a rounded share as Python prints a float (``25.0``, ``7.6``)."""
    return col_(c).cast("string")


def zip_zone(c: str | Column) -> Column:
    """First digit of an all-digit zip, else ``'can'`` (ZIP+4, Canadian,
    empty and null all become ``'can'``)."""
    c = col_(c)
    return F.when(c.rlike("^[0-9]+$"), F.substring(c, 1, 1)).otherwise(F.lit("can"))


def currency_code(c: str | Column) -> Column:
    """Currency id 1 is USD; anything else, null included, is CAD."""
    return F.when(col_(c) == 1, F.lit("USD")).otherwise(F.lit("CAD"))


def unit_price(dollars: str | Column, units: str | Column) -> Column:
    """``round(dollars / units, 2)`` half-even; null where units is 0 (no error)."""
    return F.rint(F.try_divide(col_(dollars), col_(units)) * F.lit(100.0)) / F.lit(100.0)


def cents(price: str | Column) -> Column:
    """Integer cents of a two-decimal price."""
    return F.rint(col_(price) * F.lit(100.0)).cast("long")


def quarter_bin(price_cents: str | Column, low_dollars: str | Column) -> Column:
    """Quarter-dollar bin of a price: ``e[i-1] < x <= e[i]`` for edges
    ``e[i] = low + 0.25*i``; at or below the first edge is bin 0.
    Integer cents, so no price sits on the wrong side of an edge."""
    over = col_(price_cents) - col_(low_dollars).cast("long") * 100
    return F.greatest(F.ceil(over / F.lit(25)), F.lit(0)).cast("int")


def equal_width_bin(x: str | Column, lo: str | Column, hi: str | Column, n: int) -> Column:
    """Bin ``0..n-1`` of ``n`` equal-width bins over ``[lo, hi]``, left-closed,
    last bin closed on both sides."""
    x, lo, hi = col_(x), col_(lo), col_(hi)
    return F.least(F.floor((x - lo) * F.lit(n) / (hi - lo)), F.lit(n - 1)).cast("int")


def norm_pdf(x: str | Column, mean: str | Column, std: str | Column) -> Column:
    """Normal density; null when the scale is 0."""
    x, mean, std = col_(x), col_(mean), col_(std)
    z = (x - mean) / std
    return F.when(std > 0, F.exp(-(z * z) / 2) / (std * F.lit(math.sqrt(2 * math.pi))))


def fixed_decimals(c: str | Column, decimals: int) -> Column:
    """Python ``'{:.Nf}'`` text: round half-even first so ties print like Python."""
    return F.format_string(f"%.{decimals}f", half_even(c, decimals))
