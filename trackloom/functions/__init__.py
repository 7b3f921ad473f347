"""Column functions: missing values, half precision, box geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column | str) -> Column:
    """Neither null nor NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def nan_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), None).otherwise(c)


def to_half(x: Column) -> Column:
    """``x`` rounded to half precision (ties to even), as a float."""
    x = x.cast("double")
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    near = F.when(size >= 65520, F.when(x > 0, float("inf")).otherwise(float("-inf"))).otherwise(F.rint(x / step) * step)
    return F.when(x.isNull() | F.isnan(x) | (x == 0), x).otherwise(near).cast("float")


def from_half(b: Column) -> Column:
    """The value of two little-endian bytes of half precision."""
    byte = lambda i: F.conv(F.hex(F.substring(b, i, 1)), 16, 10).cast("int")
    bits = byte(2) * 256 + byte(1)
    sign = F.when(bits >= 32768, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.floor(bits / 1024) % 32, (bits % 1024).cast("double")
    value = F.when(exponent == 31, F.when(fraction == 0, float("inf")).otherwise(float("nan"))).when(exponent == 0, fraction * 2.0**-24).otherwise((1 + fraction / 1024) * F.pow(F.lit(2.0), exponent - 15))
    return (sign * value).cast("float")


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)
