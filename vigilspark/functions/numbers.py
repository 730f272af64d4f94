"""Decimal rounding and texts of doubles as Python gives them, as Column expressions.

Spark rounds the shortest decimal of a double half up, and prints doubles in Java's form. Identities
and canonical geometry need the correctly rounded value (ties to even) and the shortest text that
reads back as the same double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 2**27 + 1 halves a double's digits, so that products of halves are exact.
_SPLIT = 134217729.0


def _product_error(x: Column, m: float, product: Column) -> Column:
    """Exact x * m minus its rounded product."""
    high_m = _SPLIT * m - (_SPLIT * m - m)
    low_m = m - high_m
    high = F.lit(_SPLIT) * x - (F.lit(_SPLIT) * x - x)
    low = x - high
    return ((high * high_m - product) + high * low_m + low * high_m) + low * low_m


def round_half_even(x: Column, places: int) -> Column:
    """x to so many decimal places (0 to 15), correctly rounded from its exact value, ties to the even digit. Values from 2**52 / 10**places on (4.5e9 at six places) stay as they are."""
    if not 0 <= places <= 15:
        raise ValueError("places are 0 to 15")
    twice = 2.0 * 10.0**places
    x = x.cast("double")
    product = x * F.lit(twice)
    error = _product_error(x, twice, product)
    near = F.rint(product / 2)
    off = (product - near * 2) + error  # twice the distance to near, within 1 unless near is wrong by one
    whole = F.when((off > 1) | ((product - near * 2 == 1) & (error > 0)), near + 1).when((off < -1) | ((product - near * 2 == -1) & (error < 0)), near - 1).otherwise(near)
    out = whole / F.lit(10.0**places)
    return F.when(F.isnan(x) | (F.abs(product) >= float(1 << 53)), x).otherwise(F.when(out == 0, x * 0.0).otherwise(out))


def shortest(x: Column) -> Column:
    """The text that Python's repr() gives of a double: shortest digits, a point always, powers of ten below 1e-4 and from 1e16.

    Python itself writes it, in Arrow batches: Java has no such form, and trying formats of all lengths costs a hundred times as much.
    """
    x = x.cast("double")
    text = F.udf(lambda v: None if v is None else repr(float(v)), T.StringType(), useArrow=True)
    return F.when(x.isNotNull(), text(x))
