"""Synthetic rasters by formula."""

import numpy as np


def ridges(w=67, h=53):
    """Crossing waves over a slanted ridge."""
    y, x = np.indices((h, w))
    return (180 * np.sin(x / 6.5) * np.cos(y / 4.5) + 2.5 * np.abs(x - 1.3 * y) + 400).astype(np.float32)


def ramp(w=40, h=30):
    """Rises to the east by 1/2 and to the south by 5/4 a cell."""
    y, x = np.indices((h, w))
    return (x / 2 + 5 * y / 4 - 12).astype(np.float32)


def ragged(w=67, h=53):
    """Ridges with noise; single holes, a diagonal gap and a block without data."""
    rng = np.random.default_rng(w * 1000 + h)
    z = (ridges(w, h) + rng.normal(0, 15, (h, w))).astype(np.float32)
    y, x = np.indices((h, w))
    ok = (rng.random((h, w)) > 0.01) & (np.abs(x - y - w // 3) > 1)
    ok[h // 2 : h // 2 + 6, 2:9] = False
    ok[: min(h, 5), : min(w, 5)] = True
    return z, ok


SPECIAL = np.array([0.0, -0.0, 1.5, -1.5, np.nan, np.inf, -np.inf, 3e38, 1e-45, -7.25], np.float32)


def same(a, b):
    """Equal bits but for NaN payloads."""
    a, b = np.asarray(a, np.float32), np.asarray(b, np.float32)
    return ((a.view(np.uint32) == b.view(np.uint32)) | (np.isnan(a) & np.isnan(b))).all()
