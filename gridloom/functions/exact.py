"""Column expressions with single-precision results, as a fixed order of roundings defines them.

NULL is an invalid cell and stays invalid; NaN is an ordinary value. Literals are FLOAT, or
Spark would widen the arithmetic to DOUBLE.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_f(value: float) -> Column:
    """A FLOAT literal, rounded once."""
    f = float(np.float32(value))
    if math.isnan(f) or math.isinf(f):
        return F.lit(str(f).replace("inf", "Infinity").replace("nan", "NaN")).cast("float")
    return F.lit(f).cast("float")


def nan_f() -> Column:
    """A FLOAT NaN."""
    return lit_f(float("nan"))


def _negative_zero(a: Column) -> Column:
    return (a == 0) & a.cast("string").startswith("-")


def go_min(a: Column, b: Column) -> Column:
    """Minimum that absorbs NaN and orders -0 below +0; NULL if either is."""
    # zeros come from the operands: the optimizer takes the literals 0.0 and -0.0 for equal and folds them
    m = F.when((a == 0) & (b == 0), F.when(_negative_zero(a), a).otherwise(b)).otherwise(F.least(a, b))
    return F.when(a.isNull() | b.isNull(), None).when(F.isnan(a) | F.isnan(b), nan_f()).otherwise(m)


def go_max(a: Column, b: Column) -> Column:
    """Maximum that absorbs NaN and orders -0 below +0; NULL if either is."""
    m = F.when((a == 0) & (b == 0), F.when(_negative_zero(a), b).otherwise(a)).otherwise(F.greatest(a, b))
    return F.when(a.isNull() | b.isNull(), None).when(F.isnan(a) | F.isnan(b), nan_f()).otherwise(m)


def ieee_div(a: Column, b: Column) -> Column:
    """FLOAT quotient that is NaN or infinite where IEEE says so, never NULL or an error."""
    q = (a.cast("double") / F.when(b != 0, b.cast("double"))).cast("float")
    away = F.when((a > 0) == ~_negative_zero(b), lit_f(math.inf)).otherwise(lit_f(-math.inf))
    return F.when(a.isNull() | b.isNull(), None).when(b != 0, q).when((a == 0) | F.isnan(a), nan_f()).otherwise(away)


def sqrt_f(a: Column) -> Column:
    """FLOAT square root."""
    return F.when(a < 0, nan_f()).otherwise(F.sqrt(a).cast("float"))


def abs_f(a: Column) -> Column:
    """Magnitude."""
    return F.abs(a)


def clamp(a: Column, lo: float, hi: float) -> Column:
    """min(max(a, lo), hi), so hi wins if lo is above it; NaN stays."""
    return go_min(go_max(a, lit_f(lo)), lit_f(hi))


def rescale(a: Column, scale: float, offset: float) -> Column:
    """scale * a + offset, rounded twice."""
    return a * lit_f(scale) + lit_f(offset)


def reclass(a: Column, breaks: list[float], values: list[float]) -> Column:
    """values[number of breaks <= a]; NaN stays."""
    out = F.when(F.isnan(a), a)
    for b, v in zip(breaks, values):
        out = out.when(a < lit_f(b), lit_f(v))
    return F.when(a.isNotNull(), out.otherwise(lit_f(values[-1])))


def lookup(a: Column, xs: list[float], ys: list[float]) -> Column:
    """Bounded piecewise-linear curve through (xs, ys); exact at the knots; NaN stays."""
    out = F.when(F.isnan(a), a).when(a <= lit_f(xs[0]), lit_f(ys[0]))
    f = np.float32
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(a == lit_f(x1), lit_f(y1))
        t = ((a - lit_f(x0)).cast("double") / F.lit(float(f(x1) - f(x0)))).cast("float")
        out = out.when(a < lit_f(x1), lit_f(y0) + t * lit_f(f(y1) - f(y0)))
    return F.when(a.isNotNull(), out.otherwise(lit_f(ys[-1])))


def wrapped(a: Column, bits: int, signed: bool = True) -> Column:
    """An integer expression in LONG (or DECIMAL) reduced to ``bits`` bits, as machine integers wrap."""
    full = F.lit(Decimal(1 << bits)).cast("decimal(38,0)")
    wide = a.cast("decimal(38,0)")
    if not signed:
        return F.pmod(wide, full)
    half = F.lit(Decimal(1 << (bits - 1))).cast("decimal(38,0)")
    return F.pmod(wide + half, full) - half
