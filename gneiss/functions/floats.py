"""Narrow floating-point formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

E4M3_MAX = 448.0


def e4m3(value: Column) -> Column:
    """The value rounded to the nearest 8-bit float with four exponent and three mantissa bits, ties to even, clamped to
    448. A magnitude that rounds up to the least normal from below stays at seven units of 2**-9; NaN becomes 448."""
    m = F.least(F.abs(value), F.lit(E4M3_MAX))
    m = F.when(F.isnan(value), F.lit(E4M3_MAX)).otherwise(m)
    e = F.greatest(F.floor(F.log2(F.when(m > 0, m).otherwise(F.lit(1.0)))), F.lit(-6))
    step = F.pow(F.lit(2.0), e - 3)
    rounded = F.rint(m / step) * step
    small = F.least(F.rint(m * 512.0), F.lit(7.0)) / 512.0
    out = F.when(m == 0, F.lit(0.0)).when(m < 0.015625, small).otherwise(F.least(rounded, F.lit(E4M3_MAX)))
    return F.when(value < 0, -out).otherwise(out)


def rowwise_scale(row: Column) -> Column:
    """The scale of one output row: its greatest magnitude over 448, at least 1e-12. NaN is passed over."""
    amax = F.array_max(F.transform(row, lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(F.abs(x.cast("double")))))
    return F.greatest(amax / E4M3_MAX, F.lit(1e-12))


def f16(value: Column) -> Column:
    """The value rounded to a half-precision float, ties to even, subnormal below 2**-14; beyond 65520 it is infinite."""
    v = value.cast("double")
    e = F.greatest(F.floor(F.log2(F.when(v != 0, F.abs(v)).otherwise(F.lit(1.0)))), F.lit(-14))
    step = F.pow(F.lit(2.0), e - 10)
    out = F.rint(v / step) * step
    return F.when((v == 0) | F.isnan(v), v).when(F.abs(out) > 65504.0, F.signum(v) * F.lit(float("inf"))).otherwise(out)


def bf16(value: Column) -> Column:
    """The value rounded to 8 bits of mantissa, ties to even, by arithmetic."""
    v = value.cast("double")
    e = F.floor(F.log2(F.when(v != 0, F.abs(v)).otherwise(F.lit(1.0))))
    step = F.pow(F.lit(2.0), e - 7)
    return F.when(v == 0, v).otherwise(F.rint(v / step) * step)
