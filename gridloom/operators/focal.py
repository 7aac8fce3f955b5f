"""Focal operations over squares of radius 1 to 8; invalid near the edge and near invalid cells."""

from __future__ import annotations

import math

import numpy as np

from gridloom.functions import kernels as k
from gridloom.raster import Raster, stencil_raster


def _radius(r: int) -> int:
    if not 1 <= r <= 8:
        raise ValueError("a radius is 1 to 8")
    return r


def _weights(weights) -> np.ndarray:
    w = np.asarray(weights, np.float32)
    if w.ndim == 1:
        w = w.reshape(int(math.isqrt(w.size)), -1)
    if w.shape[0] != w.shape[1] or w.shape[0] % 2 == 0:
        raise ValueError("weights form a square of odd size")
    _radius(w.shape[0] // 2)
    return w


def correlate(a: Raster, weights) -> Raster:
    """Weighted sums, row by row from the first product; zero weights take part."""
    w = _weights(weights)
    return stencil_raster(a, w.shape[0] // 2, lambda z: k.correlate(z, w))


def convolve(a: Raster, weights) -> Raster:
    """Correlation with the weights turned by 180 degrees."""
    return correlate(a, _weights(weights)[::-1, ::-1].copy())


def correlate_separable(a: Raster, down, along) -> Raster:
    """Columns first, then rows."""
    d, r = np.asarray(down, np.float32), np.asarray(along, np.float32)
    if len(d) != len(r) or len(d) % 2 == 0:
        raise ValueError("taps have one odd length")
    return stencil_raster(a, _radius(len(d) // 2), lambda z: k.separable(z, d, r))


def gaussian(radius: int, sigma: float) -> np.ndarray:
    """Normalised taps of a Gaussian."""
    if not (sigma > 0 and math.isfinite(sigma)):
        raise ValueError("sigma must be positive and finite")
    w = [math.exp(-(x * x) / (2 * sigma * sigma)) for x in range(-_radius(radius), radius + 1)]
    total = sum(w)
    return np.array([x / total for x in w]).astype(np.float32)


def mean(a: Raster, radius: int) -> Raster:
    """Column sums, then row sums, divided by the number of cells."""
    r = _radius(radius)
    return stencil_raster(a, r, lambda z: k.box_mean(z, r))


def minimum(a: Raster, radius: int) -> Raster:
    r = _radius(radius)
    return stencil_raster(a, r, lambda z: k.box_min(z, r))


def maximum(a: Raster, radius: int) -> Raster:
    r = _radius(radius)
    return stencil_raster(a, r, lambda z: k.box_max(z, r))
