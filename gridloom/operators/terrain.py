"""Terrain derivatives. Cells whose neighbourhood leaves the raster or has an invalid cell are invalid.

``features`` makes any mix of outputs, each with its own neighbourhood, from one reading of the
elevations; the single operations are features of one. Options are checked when the operation is built.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gridloom.functions import kernels as k
from gridloom.operators import algebra
from gridloom.raster import TILE, Raster, stencil


@dataclass(frozen=True)
class Feature:
    """An output: its name, how far it reaches, which derivatives it needs, and the kernel on them."""

    name: str
    reach: int
    base: tuple
    kernel: Callable


def _fit(radius: int) -> int:
    if not 0 <= radius <= 8:
        raise ValueError("a fit has radius 1 to 8, or 0 for the 3x3 formulas")
    return radius


def _gradient(name, scale, fit, kernel) -> Feature:
    r = _fit(fit)
    return Feature(name, max(r, 1), ("gradient", scale.x, scale.y, scale.z, r), kernel)


def f_gradient(axis: str, cell: float, cell_y: float = 0.0, z: float = 0.0, fit: int = 0, name: str = "") -> Feature:
    """dx or dy."""
    return _gradient(name or f"d{axis}", k.Scale(cell, cell_y, z), fit, (lambda d: d[0]) if axis == "x" else (lambda d: d[1]))


def f_slope(cell: float, cell_y: float = 0.0, z: float = 0.0, unit: str = "degrees", fit: int = 0, name: str = "slope") -> Feature:
    """Slope in degrees, radians or percent."""
    if unit not in ("degrees", "radians", "percent"):
        raise ValueError(f"no slope unit {unit}")
    return _gradient(name, k.Scale(cell, cell_y, z), fit, lambda d: k.slope(d[0], d[1], unit))


def f_aspect(cell: float, cell_y: float = 0.0, z: float = 0.0, trigonometric: bool = False, zero_flat: bool = False, fit: int = 0, name: str = "aspect") -> Feature:
    """Direction of descent in degrees, clockwise from north or counter-clockwise from east; flat is -1 or 0."""
    return _gradient(name, k.Scale(cell, cell_y, z), fit, lambda d: k.aspect(d[0], d[1], trigonometric, 0.0 if zero_flat else -1.0))


def f_hillshade(cell: float, cell_y: float = 0.0, z: float = 0.0, azimuth: float = 0.0, altitude: float = 0.0, fit: int = 0, name: str = "hillshade") -> Feature:
    """Illumination from 0 to 255; azimuth and altitude 0 stand for 315 and 45 degrees."""
    az, alt = azimuth or 315.0, altitude or 45.0
    if not math.isfinite(az) or not math.isfinite(alt):
        raise ValueError("the light's direction must be finite")
    return _gradient(name, k.Scale(cell, cell_y, z), fit, lambda d: k.hillshade(d[0], d[1], az, alt))


def f_heat_load(cell: float, latitude: float, cell_y: float = 0.0, z: float = 0.0, equation: int = 1, radiation: bool = False, linear: bool = False, fit: int = 0, name: str = "heat_load") -> Feature:
    """Heat load, or potential radiation, by one of three equations; logarithmic unless ``linear``."""
    if equation not in k.HEAT_LOAD or not -90 <= latitude <= 90:
        raise ValueError("equations are 1 to 3, latitudes -90 to 90")
    return _gradient(name, k.Scale(cell, cell_y, z), fit, lambda d: k.heat_load(d[0], d[1], latitude, equation, radiation, linear))


def f_orientation(cell: float, cell_y: float = 0.0, z: float = 0.0, east: bool = False, weighted: bool = False, fit: int = 0, name: str = "") -> Feature:
    """Northness or eastness, weighted by the sine of slope or not."""
    return _gradient(name or ("eastness" if east else "northness"), k.Scale(cell, cell_y, z), fit, lambda d: k.orientation(d[0], d[1], east, weighted))


def f_curvature(cell: float, cell_y: float = 0.0, z: float = 0.0, kind: str = "profile", fit: int = 0, name: str = "curvature") -> Feature:
    """Profile, plan or mean curvature."""
    if kind not in ("profile", "plan", "mean"):
        raise ValueError(f"no curvature {kind}")
    s, r = k.Scale(cell, cell_y, z), _fit(fit)
    return Feature(name, max(r, 1), ("second", s.x, s.y, s.z, r), lambda d: k.curvature(*d, kind))


def f_ruggedness(kind: str = "tri_riley", radius: int = 1, name: str = "") -> Feature:
    """tri_riley, tri_wilson, tpi or roughness over a radius of 1 to 8."""
    if kind not in ("tri_riley", "tri_wilson", "tpi", "roughness") or not 1 <= radius <= 8:
        raise ValueError("no such ruggedness")
    return Feature(name or kind, radius, ("window", radius), lambda z: k.ruggedness(z, radius, kind))


def features(dem: Raster, wanted: list[Feature], tile: int = TILE) -> DataFrame:
    """Cells (y, x, a column for each feature) from one pass; equal derivatives are computed once for a tile."""
    if not wanted or len({f.name for f in wanted}) != len(wanted):
        raise ValueError("features need different names, at least one")
    far = max(f.reach for f in wanted)

    def kernel(z):
        shared: dict = {}

        def base(f: Feature):
            if f.base not in shared:
                cut = far - f.reach
                part = z[cut : z.shape[0] - cut, cut : z.shape[1] - cut]
                if f.base[0] == "window":
                    shared[f.base] = part
                else:
                    kind, x, y, zf, fit = f.base
                    s = k.Scale(x, y, zf)
                    if kind == "gradient":
                        shared[f.base] = k.wood(part, s, fit)[:2] if fit else k.horn(part, s)
                    else:
                        shared[f.base] = k.wood(part, s, fit) if fit else k.zevenbergen(part, s)
            return shared[f.base]

        return [f.kernel(base(f)) for f in wanted]

    return stencil(dem, [f.name for f in wanted], [f.reach for f in wanted], kernel, tile)


def _one(dem: Raster, f: Feature) -> Raster:
    return Raster(features(dem, [f]).withColumnRenamed(f.name, "v"), dem.width, dem.height, dem.grid)


def gradient(dem: Raster, cell: float, **options) -> tuple[Raster, Raster]:
    """dx and dy."""
    df = features(dem, [f_gradient("x", cell, name="dx", **options), f_gradient("y", cell, name="dy", **options)])
    return tuple(Raster(df.select("y", "x", df[n].alias("v")), dem.width, dem.height, dem.grid) for n in ("dx", "dy"))


def slope(dem: Raster, cell: float, **options) -> Raster:
    return _one(dem, f_slope(cell, **options))


def aspect(dem: Raster, cell: float, **options) -> Raster:
    return _one(dem, f_aspect(cell, **options))


def hillshade(dem: Raster, cell: float, **options) -> Raster:
    return _one(dem, f_hillshade(cell, **options))


def curvature(dem: Raster, cell: float, **options) -> Raster:
    return _one(dem, f_curvature(cell, **options))


def ruggedness(dem: Raster, kind: str = "tri_riley", radius: int = 1) -> Raster:
    return _one(dem, f_ruggedness(kind, radius))


def heat_load(dem: Raster, cell: float, latitude: float, **options) -> Raster:
    return _one(dem, f_heat_load(cell, latitude, **options))


def orientation(dem: Raster, cell: float, **options) -> Raster:
    return _one(dem, f_orientation(cell, **options))


def weighted_slope(dem: Raster, weight: Raster, cell: float, **options) -> Raster:
    """Slope times weight; only the elevations' validity is eroded."""
    return algebra.mul(slope(dem, cell, **options), weight)


def surface(dem: Raster, cell: float, outputs: tuple[str, ...] = ("dx", "dy", "slope", "aspect", "hillshade"), **options) -> DataFrame:
    """Any of dx, dy, slope, aspect and hillshade over one gradient."""
    make = {"dx": lambda: f_gradient("x", cell, **options), "dy": lambda: f_gradient("y", cell, **options), "slope": lambda: f_slope(cell, **options), "aspect": lambda: f_aspect(cell, **options), "hillshade": lambda: f_hillshade(cell, **options)}
    return features(dem, [make[o]() for o in outputs])


def slope_percent_sql(dem: Raster, cell: float) -> Raster:
    """Percent slope by window functions alone: columns first, then rows; the same bits as ``slope``.

    Two shuffles of the cells instead of one, and no Python; for rasters that are cells anyway.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from gridloom.functions.exact import lit_f, sqrt_f

    along, down = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    row = dem.df.select("y", "x", F.lag("v").over(along).alias("l"), F.col("v").alias("c"), F.lead("v").over(along).alias("r"))
    n = row.select("y", "x", F.col("c").alias("z5"), *(f(c).over(down).alias(f"z{i}") for f, at in ((F.lag, (1, 2, 3)), (F.lead, (7, 8, 9))) for c, i in zip("lcr", at)), F.col("l").alias("z4"), F.col("r").alias("z6"))
    z = {i: F.col(f"z{i}") for i in range(1, 10)}
    s = k.Scale(cell)
    dx, dy = z[6] - z[4], z[8] - z[2]
    gx = (((z[3] - z[1]) + (z[9] - z[7])) + (dx + dx)) * lit_f(s.z / (8 * s.x))
    gy = (((z[7] - z[1]) + (z[9] - z[3])) + (dy + dy)) * lit_f(s.z / (8 * s.y))
    m = n.select("y", "x", "z5", gx.alias("gx"), gy.alias("gy"))
    v = F.when(F.col("z5").isNotNull(), sqrt_f(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) * lit_f(100))
    return Raster(m.select("y", "x", v.alias("v")), dem.width, dem.height, dem.grid)
