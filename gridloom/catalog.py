"""The registered raster and array queries with their DuckDB counterparts.

Rasters are made of tables with dense keys: the orders' prices on rows of 125 cells, the same with
invalid cells, the events' values on rows of 100, and a stack of the events by day, hour and type.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import CRS, Grid
from gridloom.operators import algebra, focal, reduce, resample, terrain, transfer
from gridloom.operators.ndarray import NdArray
from gridloom.plans import sqltext as q
from gridloom.plans.workflow import Workflow
from gridloom.raster import Raster

CELL = 30.0
#: Event types that the registered SQL has room for.
TYPES = 5
BREAKS, CLASSES = [50_000.0, 100_000.0, 250_000.0, 400_000.0], [1.0, 2.0, 3.0, 4.0, 5.0]
XS, YS = [0.0, 40_000.0, 90_000.0, 180_000.0, 320_000.0, 420_000.0], [0.75, 0.9, 1.4, 2.2, 3.25, 5.0]
W3 = [[1, 2, 1], [0, 4, -2], [0.5, 1, 3]]
CONV5 = [[(3 * j - 2 * c + 4) / 32 for c in range(5)] for j in range(5)]
GAUSS5 = [1 / 8, 2 / 8, 2 / 8, 2 / 8, 1 / 8]


def _cells(spark: SparkSession, sf_dir: str, table: str, key: str, width: int, value: str) -> Raster:
    t = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = t.select(F.expr(f"cast({key} div {width} as int)").alias("y"), F.expr(f"cast({key} % {width} as int)").alias("x"), F.expr(value).alias("v"))
    height = (t.agg(F.max(key)).first()[0] or 0) // width + 1  # from the file's statistics or one column
    return Raster(df, width, height, Grid(width, height, CELL, -CELL, 1000.0, 2000.0, CRS("EPSG:32633")))


def dem(spark, sf_dir) -> Raster:
    return _cells(spark, sf_dir, "orders", "o_orderkey", 125, "cast(o_totalprice as float)")


def masked(spark, sf_dir) -> Raster:
    return _cells(spark, sf_dir, "orders", "o_orderkey", 125, "case when o_orderkey % 97 <> 0 then cast(o_totalprice as float) end")


def weight(spark, sf_dir) -> Raster:
    return _cells(spark, sf_dir, "events", "event_id", 100, "case when event_type <> 'error' then cast(value as float) end")


def stack(spark, sf_dir) -> NdArray:
    """[day, hour, type] of the events' largest values; absent combinations are invalid, and there is room for TYPES types at least."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = e.select("event_type").where("event_type is not null").distinct()
    shape = (31, 24, max(TYPES, kinds.count()))
    kinds = kinds.select("event_type", (F.expr("row_number() over (order by event_type)") - 1).cast("int").alias("i2"))
    top = e.join(F.broadcast(kinds), "event_type").groupBy(F.dayofmonth("ts").alias("d"), F.hour("ts").alias("i1"), "i2").agg(F.max("value").cast("float").alias("v"))
    own = top.select((F.col("d") - 1).alias("i0"), "i1", "i2", "v")
    every = NdArray.filled(spark, shape, valid=False).df.drop("v")
    return NdArray(every.join(own, ["i0", "i1", "i2"], "left"), shape)


def _reshaped(spark, sf_dir) -> NdArray:
    a = stack(spark, sf_dir)
    return a.reshape(62, 12 * a.shape[2])


def _broadcast(spark, sf_dir) -> NdArray:
    a = stack(spark, sf_dir)
    return a.select(0, 3).broadcast_to(2, *a.shape[1:])


def out(r: Raster) -> DataFrame:
    return r.df.select("y", "x", F.col("v").cast("double").alias("v"))


def out_array(a: NdArray) -> DataFrame:
    return a.df.select(*a.axes, F.col("v").cast("double").alias("v"))


STACK = """k AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS i2 FROM (SELECT DISTINCT event_type FROM events)),
  top AS (SELECT CAST(day(ts) - 1 AS INT) AS i0, CAST(hour(ts) AS INT) AS i1, i2, CAST(max(value) AS FLOAT) AS v FROM events JOIN k USING (event_type) GROUP BY 1, 2, 3),
  every AS (SELECT CAST(i // 120 AS INT) AS i0, CAST((i // 5) % 24 AS INT) AS i1, CAST(i % 5 AS INT) AS i2 FROM range(3720) t(i)),
  s AS (SELECT i0, i1, i2, v FROM every LEFT JOIN top USING (i0, i1, i2))"""
BOTH = f"WITH a AS ({q.DEM}), b AS ({q.MASKED}), j AS (SELECT a.y, a.x, a.v AS v, b.v AS w FROM a JOIN b ON a.y = b.y AND a.x = b.x)"


def _pair(sql: str) -> str:
    return f"{BOTH} SELECT y, x, CAST({sql} AS DOUBLE) AS v FROM j"


def _one(sql: str, source: str = q.MASKED) -> str:
    return f"WITH a AS ({source}) SELECT y, x, CAST({sql} AS DOUBLE) AS v FROM a"


def _case(breaks, values) -> str:
    return "CASE WHEN v IS NULL THEN NULL " + " ".join(f"WHEN v < {q.fl(b)} THEN {q.fl(c)}" for b, c in zip(breaks, values)) + f" ELSE {q.fl(values[-1])} END"


def _curve(xs, ys) -> str:
    f = np.float32
    parts = [f"WHEN v <= {q.fl(xs[0])} THEN {q.fl(ys[0])}"]
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        parts.append(f"WHEN v = {q.fl(x1)} THEN {q.fl(y1)} WHEN v < {q.fl(x1)} THEN {q.fl(y0)} + ((v - {q.fl(x0)}) / {q.fl(f(x1) - f(x0))}) * {q.fl(f(y1) - f(y0))}")
    return "CASE WHEN v IS NULL THEN NULL " + " ".join(parts) + f" ELSE {q.fl(ys[-1])} END"


def _wrap16(sql: str) -> str:
    return f"((({sql}) + 32768) % 65536 + 65536) % 65536 - 32768"


LABELS = "l AS (SELECT CAST(event_id // 100 AS INT) AS i0, CAST(event_id % 100 AS INT) AS i1, (event_id * 7919) % 65536 - 32768 AS v FROM events)"


def labels16(spark, sf_dir) -> NdArray:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = (e.agg(F.max("event_id")).first()[0] or 0) // 100 + 1
    return NdArray(e.select(F.expr("cast(event_id div 100 as int)").alias("i0"), F.expr("cast(event_id % 100 as int)").alias("i1"), F.expr("cast((event_id * 7919) % 65536 - 32768 as smallint)").alias("v")), (n, 100), "int16")


def offsets16(spark) -> NdArray:
    return NdArray(spark.range(100).select(F.col("id").cast("int").alias("i0"), F.expr("cast(pmod(id * 977 + 32768, 65536) - 32768 as smallint)").alias("v")), (100,), "int16")


OFFSETS = "o AS (SELECT CAST(i AS INT) AS i1, ((i * 977 + 32768) % 65536) - 32768 AS w FROM range(100) t(i))"


# Grids whose coordinates are exact in binary, so another engine's tables are the same. Ratios: output cell over source cell.
_RATIO = {"nearest": 1.375, "bilinear": 0.5, "cubic": 0.75, "lanczos": 2.0, "average": 2.75}


def _exact(r: Raster, x: int = 0, y: int = 0) -> Raster:
    """``r`` on cells of 32 units, its corner moved by whole cells."""
    return Raster(r.df, r.width, r.height, Grid(r.width, r.height, 32.0, -32.0, 32.0 * x, -32.0 * y))


def _onto(r: Raster, ratio: float) -> Grid:
    return Grid(int(r.width / ratio), int(r.height / ratio), 32.0 * ratio, -32.0 * ratio)


def _resampled(spark, sf_dir, method: str) -> Raster:
    r = _exact(dem(spark, sf_dir))
    return resample.resample(r, _onto(r, _RATIO[method]), method)


def _resample_sql(method: str, ratio: float | None = None) -> str:
    ratio = ratio or _RATIO[method]
    return q.resampled(q.DEM, method, ratio, str(int(125 / ratio)), f"CAST(floor({q.ROWS} / {ratio!r}) AS BIGINT)", "125", q.ROWS)


def _resampled_masked(spark, sf_dir, method: str) -> DataFrame:
    r = _exact(masked(spark, sf_dir))
    return out(resample.resample(r, _onto(r, _RATIO[method]), method))


def _resample_masked_sql(method: str) -> str:
    ratio = _RATIO[method]
    return q.resampled_masked(q.MASKED, method, ratio, str(int(125 / ratio)), f"CAST(floor({q.ROWS} / {ratio!r}) AS BIGINT)", "125", q.ROWS)


def _mosaic(spark, sf_dir):
    a, b = _exact(dem(spark, sf_dir)), _exact(masked(spark, sf_dir), 20, 2)
    return out(resample.mosaic([a, b], _onto(a, 0.5), "nearest"))


_MOSAIC_SQL = f"""WITH d AS ({q.DEM}), m AS ({q.MASKED}), e AS (SELECT CAST(i // 250 AS INT) AS y, CAST(i % 250 AS INT) AS x FROM range(500 * {q.ROWS}) t(i))
SELECT e.y, e.x, CAST(coalesce(m.v, d.v) AS DOUBLE) AS v FROM e JOIN d ON d.y = e.y // 2 AND d.x = e.x // 2 LEFT JOIN m ON m.y = e.y // 2 - 2 AND m.x = e.x // 2 - 20"""


def _covers(spark, sf_dir):
    g = _exact(dem(spark, sf_dir)).grid
    fine = Grid(2 * g.width, 2 * g.height, 16.0, -16.0)
    left, right = g.window(0, 0, 70, g.height), g.window(60, 0, 65, g.height)
    return spark.createDataFrame([(resample.mosaic_covers([left, right], fine), resample.mosaic_covers([left], fine))], "whole boolean, part boolean")


def _workflow_stack() -> Workflow:
    w = Workflow()
    d = w.input("dem")
    w.output("slope", w.apply("slope", d, CELL, unit="percent"))
    w.output("hillshade", w.apply("hillshade", d, CELL))
    w.output("tpi", w.apply("ruggedness", d, kind="tpi"))
    w.stats("slope", w.apply("slope", d, CELL, unit="percent"))
    return w


def _workflow_canopy() -> Workflow:
    w = Workflow()
    height = w.apply("sub", w.input("surface"), w.input("ground"))
    smooth = w.apply("focal_mean", height, 1)
    w.output("scaled", w.apply("normalize", smooth))
    w.stats("classes", w.apply("reclass", smooth, [-1000.0, 0.0, 1000.0], [0.0, 1.0, 2.0, 3.0]))
    return w


def _workflow_change(coarse: Grid, fine: Grid) -> Workflow:
    w = Workflow()
    old = w.input("old", coarse)
    new = w.input("new", fine)
    change = w.apply("sub", new, w.resample(old, fine, "nearest"))
    w.stats("change", change)
    w.output("scaled", w.apply("normalize", change))
    return w


def _wf_change(spark, sf_dir):
    old = _exact(dem(spark, sf_dir))
    fine = _onto(old, 0.5)
    run = _workflow_change(old.grid, fine).run({"old": old, "new": resample.resample(old, fine, "bilinear")})
    return _rounded_stats(run.stats["change"]).select("count", "min", "max")


def _wf_stack(spark, sf_dir):
    r = _workflow_stack().run({"dem": dem(spark, sf_dir)})
    a, b, c = (r.outputs[k].df.withColumnRenamed("v", k) for k in ("slope", "hillshade", "tpi"))
    return a.join(b, ["y", "x"]).join(c, ["y", "x"]).select("y", "x", *(F.col(k).cast("double").alias(k) for k in ("slope", "hillshade", "tpi")))


def _rounded_stats(df: DataFrame) -> DataFrame:
    return df.select("count", "sum", F.round("mean", 6).alias("mean"), F.round("stddev", 4).alias("stddev"), F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"))


def _raw_roundtrip(spark, sf_dir):
    from gridloom.sources import raw

    r = masked(spark, sf_dir)
    path = raw.scratch_path(spark, "raster.f32")
    raw.write_raw(r, path, fill=-9999.0)
    return out(raw.read_raw(spark, path, r.width, r.height, fill=-9999.0))


def _features(spark, sf_dir):
    df = terrain.features(dem(spark, sf_dir), [terrain.f_slope(CELL, unit="percent", name="slope"), terrain.f_ruggedness("tpi", 3, name="tpi3"), terrain.f_curvature(CELL, kind="mean", name="curv")])
    return df.select("y", "x", *(F.col(c).cast("double").alias(c) for c in ("slope", "tpi3", "curv")))


def _heat(lat, equation, radiation, ns):
    k0, k1, k2, k3, k4, k5 = {1: (-1.467, 1.582, -1.500, -0.262, 0.607, 0.0)}[equation]
    L, c = np.radians(abs(lat)), np.radians(ns)
    kc = k2 * np.sin(L) + k5
    v = lambda x: f"CAST({float(x)!r} AS DOUBLE)"
    e = f"({v(k0)} + (1 / sqrt(1 + g2)) * ({v(k1 * np.cos(L))} + {v(-kc * np.sin(c))} * gx + {v(kc * np.cos(c))} * gy + {v(k3 * np.sin(L))} * sqrt(g2) + {v(k4)} * abs({v(np.cos(c))} * gx + {v(np.sin(c))} * gy)))"
    return q.double_of_gradient(q.DEM, CELL, e)


def _joined(**parts: str) -> str:
    """Columns of several (y, x, v) statements side by side."""
    names = list(parts)
    froms = " JOIN ".join(f"({sql}) {n}" + ("" if i == 0 else f" ON {n}.y = {names[0]}.y AND {n}.x = {names[0]}.x") for i, (n, sql) in enumerate(parts.items()))
    return f"SELECT {names[0]}.y, {names[0]}.x, " + ", ".join(f"{n}.v AS {n}" for n in names) + f" FROM {froms}"


def _fit_sql(r: int) -> str:
    k = 2 * r + 1
    step = list(range(-r, r + 1))
    s = r * (r + 1) * (2 * r + 1) / 3
    factor = q.fl(1 / (k * s * CELL))
    cols = ", ".join(f"{q.lagged('v', j, 'y')} AS c{j + r}" for j in step)
    cs = " + ".join(f"c{j + r} * {q.fl(1)}" for j in step)
    cj = " + ".join(f"c{j + r} * {q.fl(j)}" for j in step)
    rows = ", ".join(f"{q.lagged('cs', i, 'x')} AS s{i + r}, {q.lagged('cj', i, 'x')} AS j{i + r}" for i in step)
    p = " + ".join(f"s{i + r} * {q.fl(i)}" for i in step)
    qq = " + ".join(f"j{i + r} * {q.fl(1)}" for i in step)
    return f"WITH d AS ({q.DEM}), c AS (SELECT y, x, {cols} FROM d), s AS (SELECT y, x, {cs} AS cs, {cj} AS cj FROM c), r AS (SELECT y, x, {rows} FROM s), g AS (SELECT y, x, ({p}) * {factor} AS gx, ({qq}) * {factor} AS gy FROM r) SELECT y, x, CAST({q.root('gx * gx + gy * gy')} * {q.fl(100)} AS DOUBLE) AS v FROM g"


def _weighted(spark, sf_dir):
    d, w = dem(spark, sf_dir), weight(spark, sf_dir)
    return out(terrain.weighted_slope(d, Raster(w.df, d.width, d.height).densified(), CELL, unit="percent"))


def _surface(spark, sf_dir):
    df = terrain.surface(dem(spark, sf_dir), CELL, ("dx", "dy", "hillshade"))
    return df.select("y", "x", *(F.col(c).cast("double").alias(c) for c in ("dx", "dy", "hillshade")))


_GAUSS = focal.gaussian(2, 1.2)
_ENTRIES = {
    "alg_add": (lambda s, d: out(algebra.add(dem(s, d), masked(s, d))), _pair("v + w")),
    "alg_sub": (lambda s, d: out(algebra.sub(dem(s, d), masked(s, d))), _pair("v - w")),
    "alg_mul": (lambda s, d: out(algebra.mul(dem(s, d), masked(s, d))), _pair("v * w")),
    "alg_div": (lambda s, d: out(algebra.div(masked(s, d), algebra.add_scalar(dem(s, d), 7))), _pair(f"w / (v + {q.fl(7)})")),
    "alg_min": (lambda s, d: out(algebra.minimum(algebra.rescale_like(dem(s, d)), masked(s, d))), _pair(f"CASE WHEN w IS NOT NULL THEN least(v * {q.fl(-1)} + {q.fl(500000)}, w) END")),
    "alg_max": (lambda s, d: out(algebra.maximum(algebra.rescale_like(dem(s, d)), masked(s, d))), _pair(f"CASE WHEN w IS NOT NULL THEN greatest(v * {q.fl(-1)} + {q.fl(500000)}, w) END")),
    "alg_clamp": (lambda s, d: out(algebra.clamp(masked(s, d), 100_000, 300_000)), _one(f"CASE WHEN v IS NOT NULL THEN least(greatest(v, {q.fl(100000)}), {q.fl(300000)}) END")),
    "alg_mask": (lambda s, d: out(algebra.mask(dem(s, d), masked(s, d))), _pair("CASE WHEN w IS NOT NULL THEN v END")),
    "alg_normalize": (lambda s, d: out(algebra.normalize(masked(s, d))), f"WITH a AS ({q.MASKED}), m AS (SELECT min(v) AS lo, max(v) AS hi FROM a) SELECT y, x, CAST((v - lo) / (hi - lo) AS DOUBLE) AS v FROM a, m"),
    "alg_sqrt_abs": (lambda s, d: out(algebra.square_root(algebra.absolute(algebra.mul_scalar(masked(s, d), -2)))), _one(q.root(f"abs(v * {q.fl(-2)})"))),
    "alg_window": (lambda s, d: out(dem(s, d).window(10, 3, 50, 6)), f"WITH a AS ({q.DEM}) SELECT CAST(y - 3 AS INT) AS y, CAST(x - 10 AS INT) AS x, CAST(v AS DOUBLE) AS v FROM a WHERE y BETWEEN 3 AND 8 AND x BETWEEN 10 AND 59"),
    "alg_set_valid": (lambda s, d: out(dem(s, d).set_valid((F.col("x") + F.col("y")) % 7 == 0, False)), _one("CASE WHEN (x + y) % 7 <> 0 THEN v END", q.DEM)),
    "xfer_reclass": (lambda s, d: out(transfer.reclass(masked(s, d), BREAKS, CLASSES)), _one(_case(BREAKS, CLASSES))),
    "xfer_lookup": (lambda s, d: out(transfer.lookup(masked(s, d), XS, YS)), _one(_curve(XS, YS))),
    "xfer_rescale": (lambda s, d: out(transfer.rescale(masked(s, d), 0.3048, -12.5)), _one(f"v * {q.fl(0.3048)} + {q.fl(-12.5)}")),
    "xfer_rescale_range": (lambda s, d: out(transfer.rescale_range(masked(s, d), 1000, 500_000, 0, 255)), _one("v * {} + {}".format(*map(q.fl, transfer.range_coefficients(1000, 500_000, 0, 255))))),
    "ter_gradient": (lambda s, d: terrain.surface(dem(s, d), CELL, ("dx", "dy")).select("y", "x", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy")), f"{q.gradient_ctes(q.DEM, CELL)} SELECT y, x, CAST(CASE WHEN whole THEN gx END AS DOUBLE) AS dx, CAST(CASE WHEN whole THEN gy END AS DOUBLE) AS dy FROM g"),
    "ter_slope_deg": (lambda s, d: out(terrain.slope(dem(s, d), CELL)), q.slope(q.DEM, CELL, "degrees")),
    "ter_slope_rad": (lambda s, d: out(terrain.slope(masked(s, d), CELL, unit="radians")), q.slope(q.MASKED, CELL, "radians")),
    "ter_slope_pct": (lambda s, d: out(terrain.slope(dem(s, d), CELL, unit="percent")), q.slope(q.DEM, CELL, "percent")),
    "ter_slope_pct_windows": (lambda s, d: out(terrain.slope_percent_sql(masked(s, d), CELL)), q.slope(q.MASKED, CELL, "percent")),
    "ter_aspect": (lambda s, d: out(terrain.aspect(dem(s, d), CELL)), q.aspect(q.DEM, CELL)),
    "ter_aspect_trig": (lambda s, d: out(terrain.aspect(dem(s, d), CELL, trigonometric=True)), q.aspect(q.DEM, CELL, True)),
    "ter_hillshade": (lambda s, d: out(terrain.hillshade(masked(s, d), CELL, azimuth=300, altitude=40)), q.hillshade(q.MASKED, CELL, 300, 40)),
    "ter_curv_profile": (lambda s, d: out(terrain.curvature(dem(s, d), CELL, kind="profile")), q.curvature(q.DEM, CELL, "profile")),
    "ter_curv_plan": (lambda s, d: out(terrain.curvature(dem(s, d), CELL, kind="plan")), q.curvature(q.DEM, CELL, "plan")),
    "ter_curv_mean": (lambda s, d: out(terrain.curvature(masked(s, d), CELL, kind="mean")), q.curvature(q.MASKED, CELL, "mean")),
    "ter_tri": (lambda s, d: out(terrain.ruggedness(dem(s, d))), q.ruggedness(q.DEM, "tri_riley")),
    "ter_tri_wilson": (lambda s, d: out(terrain.ruggedness(dem(s, d), "tri_wilson")), q.ruggedness(q.DEM, "tri_wilson")),
    "ter_tpi": (lambda s, d: out(terrain.ruggedness(masked(s, d), "tpi")), q.ruggedness(q.MASKED, "tpi")),
    "ter_roughness": (lambda s, d: out(terrain.ruggedness(dem(s, d), "roughness")), q.ruggedness(q.DEM, "roughness")),
    "ter_tpi_r3": (lambda s, d: out(terrain.ruggedness(dem(s, d), "tpi", 3)), q.ruggedness(q.DEM, "tpi", 3)),
    "ter_tri_r2": (lambda s, d: out(terrain.ruggedness(dem(s, d), "tri_riley", 2)), q.ruggedness(q.DEM, "tri_riley", 2)),
    "ter_tri_wilson_r2": (lambda s, d: out(terrain.ruggedness(dem(s, d), "tri_wilson", 2)), q.ruggedness(q.DEM, "tri_wilson", 2)),
    "ter_roughness_r4": (lambda s, d: out(terrain.ruggedness(dem(s, d), "roughness", 4)), q.ruggedness(q.DEM, "roughness", 4)),
    "ter_heatload": (lambda s, d: out(terrain.heat_load(dem(s, d), CELL, 46)), _heat(46, 1, False, 45)),
    "ter_radiation": (lambda s, d: out(terrain.heat_load(dem(s, d), CELL, -30, radiation=True)), _heat(-30, 1, True, 180)),
    "ter_northness": (lambda s, d: out(terrain.orientation(dem(s, d), CELL, weighted=True)), q.double_of_gradient(q.DEM, CELL, "gy / sqrt(1 + g2)")),
    "ter_eastness": (lambda s, d: out(terrain.orientation(dem(s, d), CELL, east=True)), q.double_of_gradient(q.DEM, CELL, "CASE WHEN g2 = 0 THEN 0 ELSE (0 - gx) / sqrt(g2) END")),
    "ter_fit_slope_r2": (lambda s, d: out(terrain.slope(dem(s, d), CELL, unit="percent", fit=2)), _fit_sql(2)),
    "ter_weighted_slope": (_weighted, f"WITH s AS ({q.slope(q.DEM, CELL, 'percent')}), w AS ({q.WEIGHT}) SELECT s.y, s.x, CAST(CAST(s.v AS FLOAT) * w.v AS DOUBLE) AS v FROM s LEFT JOIN w ON s.y = w.y AND s.x = w.x"),
    "ter_surface": (_surface, _joined(dx=q.gradient_ctes(q.DEM, CELL) + q.final("gx", "g").replace("SELECT", " SELECT", 1), dy=q.gradient_ctes(q.DEM, CELL) + q.final("gy", "g").replace("SELECT", " SELECT", 1), hillshade=q.hillshade(q.DEM, CELL, 315, 45))),
    "ter_features": (_features, _joined(slope=q.slope(q.DEM, CELL, "percent"), tpi3=q.ruggedness(q.DEM, "tpi", 3), curv=q.curvature(q.DEM, CELL, "mean"))),
    "foc_correlate": (lambda s, d: out(focal.correlate(masked(s, d), W3)), q.correlate(q.MASKED, W3)),
    "foc_convolve": (lambda s, d: out(focal.convolve(dem(s, d), CONV5)), q.correlate(q.DEM, np.asarray(CONV5)[::-1, ::-1])),
    "foc_separable": (lambda s, d: out(focal.correlate_separable(dem(s, d), GAUSS5, [0.1, -0.2, 0.5, 0.2, 0.4])), q.separable(q.DEM, GAUSS5, [0.1, -0.2, 0.5, 0.2, 0.4])),
    "foc_gauss": (lambda s, d: out(focal.correlate_separable(masked(s, d), _GAUSS, _GAUSS)), q.separable(q.MASKED, list(_GAUSS), list(_GAUSS))),
    "foc_mean": (lambda s, d: out(focal.mean(masked(s, d), 2)), q.separable(q.MASKED, [1] * 5, [1] * 5, f"/ {q.fl(25)}")),
    "foc_min": (lambda s, d: out(focal.minimum(masked(s, d), 2)), q.box_extreme(q.MASKED, 2, "least")),
    "foc_max": (lambda s, d: out(focal.maximum(dem(s, d), 2)), q.box_extreme(q.DEM, 2, "greatest")),
    **{f"rs_{m}": (lambda s, d, m=m: out(_resampled(s, d, m)), _resample_sql(m)) for m in resample.METHODS},
    **{f"rs_{m}_masked": (lambda s, d, m=m: _resampled_masked(s, d, m), _resample_masked_sql(m)) for m in ("nearest", "bilinear", "average")},
    "rs_mosaic": (_mosaic, _MOSAIC_SQL),
    "rs_mosaic_covers": (_covers, "SELECT true AS whole, false AS part"),
    "red_count": (lambda s, d: reduce.count(masked(s, d)), f"SELECT count(v) AS count FROM ({q.MASKED})"),
    "red_minmax": (lambda s, d: reduce.min_max(masked(s, d)).select(F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), "count"), f"SELECT CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max, count(v) AS count FROM ({q.MASKED})"),
    "red_sum": (lambda s, d: reduce.exact_sum(masked(s, d)), f"SELECT sum(CAST(v AS DOUBLE)) AS sum FROM ({q.MASKED})"),
    "red_stats": (lambda s, d: _rounded_stats(reduce.stats(masked(s, d))), f"SELECT count(v) AS count, sum(CAST(v AS DOUBLE)) AS sum, round(avg(CAST(v AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(v AS DOUBLE)), 4) AS stddev, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max FROM ({q.MASKED})"),
    "red_stats_fast": (lambda s, d: reduce.stats_fast(masked(s, d)).select("count", F.round("mean", 4).alias("mean")), f"SELECT count(v) AS count, round(avg(CAST(v AS DOUBLE)), 4) AS mean FROM ({q.MASKED})"),
    "arr_slice": (lambda s, d: out_array(stack(s, d).slice(0, 5, 10)), f"WITH {STACK} SELECT CAST(i0 - 5 AS INT) AS i0, i1, i2, CAST(v AS DOUBLE) AS v FROM s WHERE i0 BETWEEN 5 AND 9"),
    "arr_window": (lambda s, d: out_array(stack(s, d).window((1, 6, 0), (3, 12, 2))), f"WITH {STACK} SELECT CAST(i0 - 1 AS INT) AS i0, CAST(i1 - 6 AS INT) AS i1, i2, CAST(v AS DOUBLE) AS v FROM s WHERE i0 BETWEEN 1 AND 3 AND i1 BETWEEN 6 AND 17 AND i2 < 2"),
    "arr_select": (lambda s, d: out_array(stack(s, d).select(2, 1)), f"WITH {STACK} SELECT i0, i1, CAST(v AS DOUBLE) AS v FROM s WHERE i2 = 1"),
    "arr_transpose": (lambda s, d: out_array(stack(s, d).transpose(2, 0, 1)), f"WITH {STACK} SELECT i2 AS i0, i0 AS i1, i1 AS i2, CAST(v AS DOUBLE) AS v FROM s"),
    "arr_reshape": (lambda s, d: out_array(_reshaped(s, d)), f"WITH {STACK} SELECT CAST((i0 * 120 + i1 * 5 + i2) // 60 AS INT) AS i0, CAST((i0 * 120 + i1 * 5 + i2) % 60 AS INT) AS i1, CAST(v AS DOUBLE) AS v FROM s"),
    "arr_expand_dims": (lambda s, d: out_array(stack(s, d).select(2, 0).expand_dims(1)), f"WITH {STACK} SELECT i0, CAST(0 AS INT) AS i1, i1 AS i2, CAST(v AS DOUBLE) AS v FROM s WHERE i2 = 0"),
    "arr_broadcast_to": (lambda s, d: out_array(_broadcast(s, d)), f"WITH {STACK} SELECT CAST(t.i AS INT) AS i0, i1, i2, CAST(v AS DOUBLE) AS v FROM s, range(2) t(i) WHERE i0 = 3"),
    "arr_broadcast_add": (lambda s, d: out_array(stack(s, d).add(stack(s, d).select(0, 0))), f"WITH {STACK} SELECT a.i0, a.i1, a.i2, CAST(a.v + b.v AS DOUBLE) AS v FROM s a JOIN s b ON a.i1 = b.i1 AND a.i2 = b.i2 AND b.i0 = 0"),
    "arr_broadcast_mul": (lambda s, d: out_array(labels16(s, d).mul(offsets16(s))), f"WITH {LABELS}, {OFFSETS} SELECT i0, i1, CAST({_wrap16('v * w')} AS DOUBLE) AS v FROM l JOIN o USING (i1)"),
    "arr_sub": (lambda s, d: out_array(labels16(s, d).sub(offsets16(s))), f"WITH {LABELS}, {OFFSETS} SELECT i0, i1, CAST({_wrap16('v - w')} AS DOUBLE) AS v FROM l JOIN o USING (i1)"),
    "arr_min_max": (lambda s, d: out_array(labels16(s, d).minimum(offsets16(s)).maximum(NdArray.filled(s, (), -20000, "int16"))), f"WITH {LABELS}, {OFFSETS} SELECT i0, i1, CAST(greatest(least(v, w), -20000) AS DOUBLE) AS v FROM l JOIN o USING (i1)"),
    "arr_convert": (lambda s, d: out_array(labels16(s, d).convert("int8")), f"WITH {LABELS} SELECT i0, i1, CAST(((v + 128) % 256 + 256) % 256 - 128 AS DOUBLE) AS v FROM l"),
    "arr_convert_float": (lambda s, d: out_array(stack(s, d).convert("int32")), f"WITH {STACK} SELECT i0, i1, i2, CAST(trunc(v) AS DOUBLE) AS v FROM s"),
    "arr_fill": (lambda s, d: out_array(stack(s, d).fill(2.5)), f"WITH {STACK} SELECT i0, i1, i2, CAST(2.5 AS DOUBLE) AS v FROM s"),
    "arr_count_over": (lambda s, d: out_array(stack(s, d).count_over(0)), f"WITH {STACK} SELECT i1 AS i0, i2 AS i1, CAST(count(v) AS DOUBLE) AS v FROM s GROUP BY i1, i2"),
    "arr_sum_over": (lambda s, d: out_array(stack(s, d).sum_over(1, 2)).select("i0", F.round("v", 6).alias("v")), f"WITH {STACK} SELECT i0, round(coalesce(sum(CAST(v AS DOUBLE)), 0), 6) AS v FROM s GROUP BY i0"),
    "arr_mean_over": (lambda s, d: out_array(stack(s, d).mean_over(0, keepdims=True)).select("i0", "i1", "i2", F.round("v", 6).alias("v")), f"WITH {STACK} SELECT CAST(0 AS INT) AS i0, i1, i2, round(avg(CAST(v AS DOUBLE)), 6) AS v FROM s GROUP BY i1, i2"),
    "arr_min_over": (lambda s, d: out_array(stack(s, d).min_over(0, 1)), f"WITH {STACK} SELECT i2 AS i0, CAST(min(v) AS DOUBLE) AS v FROM s GROUP BY i2"),
    "arr_max_over": (lambda s, d: out_array(stack(s, d).max_over(1)), f"WITH {STACK} SELECT i0, i2 AS i1, CAST(max(v) AS DOUBLE) AS v FROM s GROUP BY i0, i2"),
    "wf_stack": (_wf_stack, _joined(slope=q.slope(q.DEM, CELL, "percent"), hillshade=q.hillshade(q.DEM, CELL, 315, 45), tpi=q.ruggedness(q.DEM, "tpi"))),
    "wf_canopy": (lambda s, d: out(_workflow_canopy().run({"surface": dem(s, d), "ground": algebra.rescale_like(dem(s, d))}).outputs["scaled"]), f"WITH f AS ({q.separable(f'SELECT y, x, v - (v * {q.fl(-1)} + {q.fl(500000)}) AS v FROM ({q.DEM})', [1] * 3, [1] * 3, f'/ {q.fl(9)}')}), m AS (SELECT min(v) AS lo, max(v) AS hi FROM f) SELECT y, x, CAST((CAST(v AS FLOAT) - CAST(lo AS FLOAT)) / (CAST(hi AS FLOAT) - CAST(lo AS FLOAT)) AS DOUBLE) AS v FROM f, m"),
    "wf_change": (_wf_change, f"WITH n AS ({_resample_sql('bilinear')}), o AS (SELECT CAST(n.v AS FLOAT) - d.v AS v FROM n JOIN ({q.DEM}) d ON d.y = n.y // 2 AND d.x = n.x // 2) SELECT count(v) AS count, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max FROM o"),
    "io_raw_roundtrip": (_raw_roundtrip, f"SELECT y, x, CAST(v AS DOUBLE) AS v FROM ({q.MASKED})"),
}


def queries():
    """Query name -> function of (spark, sf_dir)."""
    return {k: f for k, (f, _) in _ENTRIES.items()}


def oracle_sql():
    """Query name -> DuckDB SQL over the same tables."""
    return {k: sql for k, (_, sql) in _ENTRIES.items()}
