"""Pointwise algebra: FLOAT arithmetic, valid where all inputs are."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import exact
from gridloom.raster import Raster
from gridloom.operators.reduce import min_max


def add(a: Raster, b: Raster) -> Raster:
    return a.combined(b, lambda x, y: x + y)


def sub(a: Raster, b: Raster) -> Raster:
    return a.combined(b, lambda x, y: x - y)


def mul(a: Raster, b: Raster) -> Raster:
    return a.combined(b, lambda x, y: x * y)


def div(a: Raster, b: Raster) -> Raster:
    return a.combined(b, exact.ieee_div)


def minimum(a: Raster, b: Raster) -> Raster:
    return a.combined(b, exact.go_min)


def maximum(a: Raster, b: Raster) -> Raster:
    return a.combined(b, exact.go_max)


def clamp(a: Raster, lo: float, hi: float) -> Raster:
    """Between lo and hi; hi if lo is above it."""
    return a.mapped(lambda v: exact.clamp(v, lo, hi))


def add_scalar(a: Raster, c: float) -> Raster:
    return a.mapped(lambda v: v + exact.lit_f(c))


def mul_scalar(a: Raster, c: float) -> Raster:
    return a.mapped(lambda v: v * exact.lit_f(c))


def absolute(a: Raster) -> Raster:
    return a.mapped(exact.abs_f)


def square_root(a: Raster) -> Raster:
    return a.mapped(exact.sqrt_f)


def mask(a: Raster, by: Raster) -> Raster:
    """a where ``by`` is valid; the values of ``by`` don't matter."""
    return a.combined(by, lambda v, m: F.when(m.isNotNull(), v))


def normalize(a: Raster) -> Raster:
    """(v - lo) / (hi - lo) by the raster's own extremes, in a second pass over the cells.

    A constant raster gives NaN, and so does one NaN anywhere. The extremes are one row, joined by broadcast.
    """
    range_ = min_max(a).select(F.col("min").alias("lo"), F.col("max").alias("hi"))
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    df = a.df.join(F.broadcast(range_)).select("y", "x", exact.ieee_div(v - lo, hi - lo).alias("v"))
    return Raster(df, a.width, a.height, a.grid)


def rescale_like(a: Raster, scale: float = -1.0, offset: float = 500_000.0) -> Raster:
    """scale * v + offset: a mirrored raster for comparisons."""
    return a.mapped(lambda v: exact.rescale(v, scale, offset))
