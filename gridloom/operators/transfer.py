"""Transfer functions: classes, curves and linear maps of single cells. Options are checked at once."""

from __future__ import annotations

import math

from gridloom.functions import exact
from gridloom.raster import Raster


def _increasing(values: list[float], what: str) -> None:
    if any(math.isnan(v) for v in values) or any(b <= a for a, b in zip(values, values[1:])):
        raise ValueError(f"{what} must increase strictly, without NaN")


def reclass(a: Raster, breaks: list[float], values: list[float]) -> Raster:
    """values[k] with k breaks at or below the cell: half-open classes; NaN stays."""
    if len(values) != len(breaks) + 1:
        raise ValueError("one value more than breaks is needed")
    _increasing(breaks, "breaks")
    return a.mapped(lambda v: exact.reclass(v, breaks, values))


def lookup(a: Raster, xs: list[float], ys: list[float]) -> Raster:
    """The curve through (xs, ys), constant beyond its ends; NaN stays."""
    if not xs or len(xs) != len(ys):
        raise ValueError("xs and ys must be of one length, at least 1")
    if not all(map(math.isfinite, xs)):
        raise ValueError("xs must be finite")
    _increasing(xs, "xs")
    return a.mapped(lambda v: exact.lookup(v, xs, ys))


def rescale(a: Raster, scale: float, offset: float) -> Raster:
    """scale * v + offset."""
    return a.mapped(lambda v: exact.rescale(v, scale, offset))


def range_coefficients(in_lo: float, in_hi: float, out_lo: float, out_hi: float) -> tuple[float, float]:
    """Scale and offset of a linear map of intervals, in double precision."""
    if not all(map(math.isfinite, (in_lo, in_hi, out_lo, out_hi))) or in_lo == in_hi:
        raise ValueError("intervals must be finite and the first not empty")
    scale = (out_hi - out_lo) / (in_hi - in_lo)
    return scale, out_lo - scale * in_lo


def rescale_range(a: Raster, in_lo: float, in_hi: float, out_lo: float, out_hi: float) -> Raster:
    """Maps one interval to another, without clamping."""
    return rescale(a, *range_coefficients(in_lo, in_hi, out_lo, out_hi))
