"""Single-precision numpy kernels on tiles with their surroundings.

Every product, sum and root is rounded to float32 on its own and in the written order, as numpy
does for float32 arrays; where a formula is evaluated in double precision it says so.
"""

from __future__ import annotations

import math

import numpy as np

f4, f8 = np.float32, np.float64


def around(z: np.ndarray, r: int = 1) -> dict[tuple[int, int], np.ndarray]:
    """Views of the neighbours: (dy, dx) -> the tile's cells moved by that much."""
    h, w = z.shape[0] - 2 * r, z.shape[1] - 2 * r
    return {(j, i): z[r + j : r + j + h, r + i : r + i + w] for j in range(-r, r + 1) for i in range(-r, r + 1)}


def nine(z):
    """z1..z9, row by row."""
    n = around(z)
    return [n[j, i] for j in (-1, 0, 1) for i in (-1, 0, 1)]


def atan32(x):
    """Arc tangent of x >= 0 in float32: reduction at tan(pi/8) and tan(3 pi/8), then a polynomial in t^2."""
    big, mid = x > f4(2.414213562373095), x > f4(0.4142135623730950)
    num = np.where(big, f4(-1), np.where(mid, x - f4(1), x))
    den = np.where(big, x, np.where(mid, x + f4(1), f4(1)))
    y0 = np.where(big, f4(math.pi / 2), np.where(mid, f4(math.pi / 4), f4(0)))
    t = num / den
    z = t * t
    p = f4(8.05374449538e-2) * z - f4(1.38776856032e-1)
    p = p * z + f4(1.99777106478e-1)
    p = p * z - f4(3.33329491539e-1)
    return y0 + (p * z * t + t)


def atan2_32(y, x):
    """Angle of (x, y) in float32 from ``atan32`` of the ratio of magnitudes."""
    ay, ax = np.abs(y), np.abs(x)
    a = atan32(ay / ax)
    a = np.where((ay == 0) & (ax == 0), f4(0), a)
    a = np.where(np.isinf(ay) & np.isinf(ax), f4(math.pi / 4), a)
    a = np.where(np.signbit(x), f4(math.pi) - a, a)
    return np.copysign(a, y).astype(f4)


DEGREES = f4(180 / math.pi)


class Scale:
    """Cell sizes and vertical factor, checked."""

    def __init__(self, cell: float, cell_y: float = 0.0, z: float = 0.0):
        self.x, self.y, self.z = cell, cell_y or cell, z or 1.0
        if not (self.x > 0 and self.y > 0) or not all(map(math.isfinite, (self.x, self.y, self.z))):
            raise ValueError("cell sizes must be positive and finite, the vertical factor finite")
        for k in (self.z / (8 * self.x), self.z / (8 * self.y)):
            if not np.isfinite(f4(k)) or f4(k) == 0:
                raise ValueError("a scale factor is 0 or infinite in single precision")


def horn(z, s: Scale):
    """Horn's gradient (gx, gy)."""
    z1, z2, z3, z4, _, z6, z7, z8, z9 = nine(z)
    dx, dy = z6 - z4, z8 - z2
    gx = (((z3 - z1) + (z9 - z7)) + (dx + dx)) * f4(s.z / (8 * s.x))
    gy = (((z7 - z1) + (z9 - z3)) + (dy + dy)) * f4(s.z / (8 * s.y))
    return gx, gy


def zevenbergen(z, s: Scale):
    """Derivatives p, q, r, t, s over a 3x3 neighbourhood."""
    z1, z2, z3, z4, z5, z6, z7, z8, z9 = nine(z)
    p, q = (z6 - z4) * f4(s.z / (2 * s.x)), (z8 - z2) * f4(s.z / (2 * s.y))
    r = ((z4 + z6) - (z5 + z5)) * f4(s.z / s.x**2)
    t = ((z2 + z8) - (z5 + z5)) * f4(s.z / s.y**2)
    return p, q, r, t, ((z1 + z9) - (z3 + z7)) * f4(s.z / (4 * s.x * s.y))


def wood(z, s: Scale, radius: int):
    """Derivatives p, q, r, t, s of the least-squares quadratic over (2 radius + 1)^2 cells."""
    k = 2 * radius + 1
    step = range(-radius, radius + 1)
    big_s = radius * (radius + 1) * (2 * radius + 1) / 3
    t2 = [3 * i * i - radius * (radius + 1) for i in step]
    big_q = sum(x * x for x in t2)
    kp, kq = f4(s.z / (k * big_s * s.x)), f4(s.z / (k * big_s * s.y))
    kr, kt = f4(6 * s.z / (k * big_q * s.x**2)), f4(6 * s.z / (k * big_q * s.y**2))
    ks = f4(s.z / (big_s**2 * s.x * s.y))
    h, w = z.shape[0] - 2 * radius, z.shape[1] - 2 * radius
    rows = [z[radius + j : radius + j + h] for j in step]

    def down(taps):
        acc = rows[0] * f4(taps[0])
        for tap, row in zip(taps[1:], rows[1:]):
            acc = acc + row * f4(tap)
        return acc

    def along(col, taps):
        acc = col[:, 0:w] * f4(taps[0])
        for i, tap in enumerate(taps[1:], 1):
            acc = acc + col[:, i : i + w] * f4(tap)
        return acc

    one, lin = [1] * k, list(step)
    cs, cj, ct = down(one), down(lin), down(t2)
    return along(cs, lin) * kp, along(cj, one) * kq, along(cs, t2) * kr, along(ct, one) * kt, along(cj, lin) * ks


def slope(gx, gy, unit: str):
    m = np.sqrt(gx * gx + gy * gy)
    if unit == "percent":
        return m * f4(100)
    a = atan32(m)
    return a * DEGREES if unit == "degrees" else a


def aspect(gx, gy, trigonometric: bool, flat: float):
    west = f4(0) - gx
    d = (atan2_32(gy, west) if trigonometric else atan2_32(west, gy)) * DEGREES
    d = np.where(d < 0, d + f4(360), d + f4(0))
    d = np.where(d >= 360, f4(0), d)
    return np.where((gx == 0) & (gy == 0), f4(flat), d)


def hillshade(gx, gy, azimuth: float, altitude: float):
    az, alt = math.radians(math.fmod(azimuth, 360)), math.radians(altitude)
    c, bx, by = f4(255 * math.sin(alt)), f4(-255 * math.cos(alt) * math.sin(az)), f4(255 * math.cos(alt) * math.cos(az))
    v = (c + (bx * gx + by * gy)) / np.sqrt(f4(1) + (gx * gx + gy * gy))
    return np.minimum(np.maximum(v, f4(0)), f4(255))


def curvature(p, q, r, t, s, kind: str):
    p2, q2, pq = p * p, q * q, p * q
    if kind == "mean":
        w = f4(1) + (p2 + q2)
        num = ((f4(1) + q2) * r - (pq + pq) * s) + (f4(1) + p2) * t
        d = w * np.sqrt(w)
        return f4(0) - num / (d + d)
    g = p2 + q2
    w = f4(1) + g
    if kind == "profile":
        num = (p2 * r + (pq + pq) * s) + q2 * t
        out = f4(0) - num / g / (w * np.sqrt(w))
    else:
        num = (q2 * r - (pq + pq) * s) + p2 * t
        out = f4(0) - num / g / np.sqrt(g)
    return np.where(g == 0, num + f4(0), out)


def _max2(a, b):
    m = np.maximum(a, b)
    zero = (a == 0) & (b == 0)
    return np.where(zero, np.where(np.signbit(a) & np.signbit(b), f4(-0.0), f4(0)), m) if zero.any() else m


def _min2(a, b):
    m = np.minimum(a, b)
    zero = (a == 0) & (b == 0)
    return np.where(zero, np.where(np.signbit(a) | np.signbit(b), f4(-0.0), f4(0)), m) if zero.any() else m


def ruggedness(z, radius: int, kind: str):
    n = around(z, radius)
    centre = n[0, 0]
    if kind == "roughness":
        return separable_extreme(z, radius, _max2) - separable_extreme(z, radius, _min2)
    others = [v for k, v in n.items() if k != (0, 0)]
    if kind == "tri_riley":  # double precision, rounded once
        acc = np.zeros(centre.shape, f8)
        for v in others:
            acc = acc + (v.astype(f8) - centre.astype(f8)) ** 2
        return np.sqrt(acc).astype(f4)
    terms = [np.abs(v - centre) for v in others] if kind == "tri_wilson" else others
    acc = terms[0]
    for v in terms[1:]:
        acc = acc + v
    mean = acc * f4(0.125) if radius == 1 else acc / f4(len(others))
    return mean if kind == "tri_wilson" else centre - mean


#: Fixed values of the heat load equations: (k0, k1, k2, k3, k4, k5).
HEAT_LOAD = {1: (-1.467, 1.582, -1.500, -0.262, 0.607, 0.0), 2: (-1.236, 1.350, -1.376, -0.331, 0.375, 0.0), 3: (0.339, 0.808, 0.0, -0.196, 0.0, -0.482)}


def heat_load(gx, gy, latitude: float, equation: int, radiation: bool, linear: bool):
    """McCune's equations by slope and folded aspect, in double precision, rounded once."""
    k0, k1, k2, k3, k4, k5 = HEAT_LOAD[equation]
    lat = math.radians(abs(latitude))
    coolest = math.radians((0 if latitude >= 0 else 180) if radiation else (45 if latitude >= 0 else 135))
    kc = k2 * math.sin(lat) + k5
    a, bx, by = k1 * math.cos(lat), -kc * math.sin(coolest), kc * math.cos(coolest)
    e, f, cx, cy = k3 * math.sin(lat), k4, math.cos(coolest), math.sin(coolest)
    x, y = gx.astype(f8), gy.astype(f8)
    g2 = x * x + y * y
    w = 1 / np.sqrt(1 + g2)
    v = k0 + w * (a + bx * x + by * y + e * np.sqrt(g2) + f * np.abs(cx * x + cy * y))
    return (np.exp(v) if linear and equation != 3 else v).astype(f4)


def orientation(gx, gy, east: bool, weighted: bool):
    x, y = gx.astype(f8), gy.astype(f8)
    c, g2 = (0 - x if east else y), x * x + y * y
    if weighted:
        return (c / np.sqrt(1 + g2)).astype(f4)
    return np.where(g2 == 0, f4(0), (c / np.sqrt(g2)).astype(f4))


def correlate(z, weights: np.ndarray):
    r = weights.shape[0] // 2
    n = around(z, r)
    acc = None
    for (j, i), v in n.items():
        term = v * f4(weights[j + r, i + r])
        acc = term if acc is None else acc + term
    return acc


def separable(z, down: np.ndarray, along: np.ndarray):
    r = len(down) // 2
    h, w = z.shape[0] - 2 * r, z.shape[1] - 2 * r
    col = z[0:h] * f4(down[0])
    for j in range(1, 2 * r + 1):
        col = col + z[j : j + h] * f4(down[j])
    out = col[:, 0:w] * f4(along[0])
    for i in range(1, 2 * r + 1):
        out = out + col[:, i : i + w] * f4(along[i])
    return out


def box_mean(z, r: int):
    h, w = z.shape[0] - 2 * r, z.shape[1] - 2 * r
    col = z[0:h]
    for j in range(1, 2 * r + 1):
        col = col + z[j : j + h]
    out = col[:, 0:w]
    for i in range(1, 2 * r + 1):
        out = out + col[:, i : i + w]
    return out / f4((2 * r + 1) ** 2)


def separable_extreme(z, r: int, pick):
    h, w = z.shape[0] - 2 * r, z.shape[1] - 2 * r
    col = z[0:h]
    for j in range(1, 2 * r + 1):
        col = pick(col, z[j : j + h])
    out = col[:, 0:w]
    for i in range(1, 2 * r + 1):
        out = pick(out, col[:, i : i + w])
    return out


def box_min(z, r: int):
    return separable_extreme(z, r, _min2)


def box_max(z, r: int):
    return separable_extreme(z, r, _max2)
