"""Rasters as DataFrames of cells.

``Raster.df`` has one row (y INT, x INT, v FLOAT) for every cell; v is NULL where the cell is
invalid. Position is data, so no order of rows or partitions matters. Stencils and resampling
deal the cells out to tiles, each with the cells around it that it needs, in one shuffle; a
numpy kernel then works on a tile at a time, so results don't depend on the tiling.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid

#: Cells along a tile's side.
TILE = 256


class Raster:
    """A grid of FLOAT cells with validity, and its georeferencing if it has one."""

    def __init__(self, df: DataFrame, width: int, height: int, grid: Grid | None = None):
        if grid is not None and (grid.width, grid.height) != (width, height):
            raise ValueError("grid and raster differ in size")
        self.df, self.width, self.height, self.grid = df, width, height, grid

    @classmethod
    def from_numpy(cls, spark: SparkSession, data: np.ndarray, valid: np.ndarray | None = None, grid: Grid | None = None) -> Raster:
        """A raster of an array (a small one: it passes through the driver)."""
        h, w = data.shape
        y, x = np.divmod(np.arange(h * w, dtype=np.int32), max(w, 1))
        mask = None if valid is None else ~np.asarray(valid, bool).ravel()
        v = pa.array(np.asarray(data, np.float32).ravel(), mask=mask)
        return cls(spark.createDataFrame(pa.table({"y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "v": v})), w, h, grid)

    def to_numpy(self) -> tuple[np.ndarray, np.ndarray]:
        """Data (NaN where invalid) and validity; for rasters that the driver can hold."""
        t = self.df.select("y", "x", "v").toArrow()
        out, ok = np.full((self.height, self.width), np.nan, np.float32), np.zeros((self.height, self.width), bool)
        y, x, v = (t.column(i) for i in range(3))
        at = (y.to_numpy(), x.to_numpy())
        ok[at] = v.is_valid().to_numpy()
        out[at] = v.to_numpy()
        out[~ok] = np.nan
        return out, ok

    def mapped(self, expr: Callable[[Column], Column]) -> Raster:
        """Each cell's value through a column expression; no shuffle."""
        return Raster(self.df.select("y", "x", expr(F.col("v")).alias("v")), self.width, self.height, self.grid)

    def combined(self, other: Raster, expr: Callable[[Column, Column], Column]) -> Raster:
        """Two rasters of one size, cell by cell: an equi-join on the position."""
        check_same(self, other)
        if other.df is self.df:
            return self.mapped(lambda v: expr(v, v))
        b = other.df.select("y", "x", F.col("v").alias("w"))
        out = self.df.join(b, ["y", "x"]).select("y", "x", expr(F.col("v"), F.col("w")).alias("v"))
        return Raster(out, self.width, self.height, self.grid or other.grid)

    def window(self, x: int, y: int, width: int, height: int) -> Raster:
        """A rectangle as a raster of its own; its edge is an edge for all that follows."""
        if x < 0 or y < 0 or width < 0 or height < 0 or x + width > self.width or y + height > self.height:
            raise ValueError("the window leaves the raster")
        inside = F.col("y").between(y, y + height - 1) & F.col("x").between(x, x + width - 1)
        df = self.df.where(inside).select((F.col("y") - y).cast("int").alias("y"), (F.col("x") - x).cast("int").alias("x"), "v")
        return Raster(df, width, height, self.grid and self.grid.window(x, y, width, height))

    def set_valid(self, where: Column, value: bool) -> Raster:
        """Clear validity where a condition on (y, x, v) holds, or set it (a cleared cell's value becomes 0)."""
        v = F.when(where, F.coalesce("v", F.lit(0).cast("float")) if value else F.lit(None).cast("float")).otherwise(F.col("v"))
        return Raster(self.df.withColumn("v", v), self.width, self.height, self.grid)

    def cell(self, x: int, y: int) -> DataFrame:
        """One cell: (v, valid)."""
        return self.df.where((F.col("y") == y) & (F.col("x") == x)).select("v", F.col("v").isNotNull().alias("valid"))

    def densified(self) -> Raster:
        """All cells present; missing ones invalid."""
        spark = self.df.sparkSession
        every = spark.range(self.height * self.width).select(F.expr(f"cast(id div {max(self.width, 1)} as int)").alias("y"), F.expr(f"cast(id % {max(self.width, 1)} as int)").alias("x"))
        return Raster(every.join(self.df, ["y", "x"], "left"), self.width, self.height, self.grid)

    def validate(self) -> None:
        """Raise unless every cell is there once."""
        n, distinct, inside = self.df.agg(F.count("*"), F.countDistinct("y", "x"), F.count(F.when(F.col("y").between(0, self.height - 1) & F.col("x").between(0, self.width - 1), 1))).first()
        if not n == distinct == inside == self.width * self.height:
            raise ValueError(f"{n} cells, {distinct} distinct, {inside} inside, for {self.width} x {self.height}")

    def nan_edges(self, radius: int) -> Raster:
        """Cells within ``radius`` of the edge as valid NaNs: what a neighbourhood operation gives where nothing is masked."""
        edge = (F.col("y") < radius) | (F.col("x") < radius) | (F.col("y") >= self.height - radius) | (F.col("x") >= self.width - radius)
        v = F.when(edge, F.lit("NaN").cast("float")).otherwise(F.col("v"))
        return Raster(self.df.withColumn("v", v), self.width, self.height, self.grid)

    def amplification(self, radius: int, tile: int = TILE) -> float:
        """Cells that a neighbourhood operation's shuffle moves for each cell of the raster."""

        def along(n: int) -> int:
            return sum(min(n, a + tile + radius) - max(0, a - radius) for a in range(0, n, tile))

        return along(self.height) * along(self.width) / (self.height * self.width) if self.height and self.width else 1.0

    def scanlines(self) -> DataFrame:
        """Rows (y, v ARRAY<FLOAT>); NULL elements are invalid."""
        cells = F.array_sort(F.collect_list(F.struct("x", "v")))
        return self.df.groupBy("y").agg(cells.alias("c")).select("y", F.transform("c", lambda c: c["v"]).alias("v"))

    @classmethod
    def from_scanlines(cls, lines: DataFrame, width: int, height: int, grid: Grid | None = None) -> Raster:
        """The inverse of ``scanlines``."""
        df = lines.select("y", F.posexplode("v").alias("x", "v"))
        return cls(df, width, height, grid)

    def tiles(self, radius: int = 0, tile: int = TILE) -> DataFrame:
        """Rows (ty, tx, data BINARY, valid BINARY): tiles with ``radius`` cells around them, float32 and uint8 row by row."""
        return self.tiled(radius, lambda z, ok, y, x: (z, ok), tile)

    def _dealt(self, radius: int, tile: int) -> DataFrame:
        top_y, top_x = max(self.height - 1, 0) // tile, max(self.width - 1, 0) // tile
        near = lambda c, top: F.sequence(F.greatest(F.lit(0), F.expr(f"cast(floor(({c} - {radius}) / {tile}) as int)")), F.least(F.lit(top), F.expr(f"cast(floor(({c} + {radius}) / {tile}) as int)")))
        if radius:
            df = self.df.select(F.explode(near("y", top_y)).alias("ty"), "y", "x", "v").select("ty", F.explode(near("x", top_x)).alias("tx"), "y", "x", "v")
        else:
            df = self.df.select(F.expr(f"y div {tile}").cast("int").alias("ty"), F.expr(f"x div {tile}").cast("int").alias("tx"), "y", "x", "v")
        return df.repartition("ty", "tx").sortWithinPartitions("ty", "tx")

    def tiled(self, radius: int, make, tile: int = TILE) -> DataFrame:
        """``make(z, ok, y0, x0)`` on each tile with its surroundings; returns (data, valid) arrays as BINARY."""
        height, width = self.height, self.width

        def run(batches):
            for ty, tx, z, ok in gathered(batches, radius, tile, height, width):
                data, valid = make(z, ok, ty * tile, tx * tile)
                yield pa.record_batch([pa.array([ty], pa.int32()), pa.array([tx], pa.int32()), pa.array([data.astype("<f4").tobytes()]), pa.array([valid.astype("u1").tobytes()])], ["ty", "tx", "data", "valid"])

        return self._dealt(radius, tile).mapInArrow(run, "ty int, tx int, data binary, valid binary")


def check_same(*rasters: Raster) -> None:
    """Raise unless sizes, and grids where given, agree."""
    first = rasters[0]
    for r in rasters[1:]:
        if (r.width, r.height) != (first.width, first.height):
            raise ValueError(f"{first.width} x {first.height} and {r.width} x {r.height}")
        if first.grid and r.grid:
            a, b = first.grid, r.grid
            if not a.crs.matches(b.crs):
                raise ValueError(f"{a.crs.describe()} and {b.crs.describe()}")
            if (a.res_x, a.res_y, a.origin_x, a.origin_y) != (b.res_x, b.res_y, b.origin_x, b.origin_y):
                raise ValueError("the grids differ")


def gathered(batches, radius: int, tile: int, height: int, width: int):
    """Tiles of rows (ty, tx, y, x, v) sorted by tile: (ty, tx, data, valid) with ``radius`` cells around; what is missing is invalid."""
    held, key = [], None

    def built(key, parts):
        ty, tx = key
        h, w = min(tile, height - ty * tile), min(tile, width - tx * tile)
        z, ok = np.zeros((h + 2 * radius, w + 2 * radius), np.float32), np.zeros((h + 2 * radius, w + 2 * radius), bool)
        for y, x, v, good in parts:
            at = (y - ty * tile + radius, x - tx * tile + radius)
            z[at], ok[at] = v, good
        return ty, tx, z, ok

    for b in batches:
        if not b.num_rows:
            continue
        ty, tx, y, x = (b.column(i).to_numpy() for i in range(4))
        good = b.column(4).is_valid().to_numpy(zero_copy_only=False)
        v = b.column(4).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ty)]):
            k = (int(ty[a]), int(tx[a]))
            if k != key and held:
                yield built(key, held)
                held = []
            key = k
            held.append((y[a:z], x[a:z], v[a:z], good[a:z]))
    if held:
        yield built(key, held)


def eroded(ok: np.ndarray, radius: int) -> np.ndarray:
    """Whether all cells within ``radius`` (a square) are valid; smaller by radius on each side."""
    n = 2 * radius + 1
    rows = ok[: ok.shape[0] - n + 1].copy()
    for k in range(1, n):
        rows &= ok[k : ok.shape[0] - n + 1 + k]
    out = rows[:, : ok.shape[1] - n + 1].copy()
    for k in range(1, n):
        out &= rows[:, k : ok.shape[1] - n + 1 + k]
    return out


def stencil(raster: Raster, names: list[str], reaches: list[int], kernel, tile: int = TILE) -> DataFrame:
    """Cells (y, x, names...) of a neighbourhood operation.

    ``kernel(z)`` gets a tile with max(reaches) cells around it and returns an array for each
    name, of the tile without its surroundings. An output is valid where all cells within its reach
    are, the raster's edge counting as invalid. One shuffle of the cells, and no other.
    """
    radius, height, width = max(reaches), raster.height, raster.width

    def run(batches):
        for ty, tx, z, ok in gathered(batches, radius, tile, height, width):
            h, w = z.shape[0] - 2 * radius, z.shape[1] - 2 * radius
            with np.errstate(all="ignore"):
                outs = kernel(z)
            y, x = np.divmod(np.arange(h * w, dtype=np.int32), w)
            cols = [pa.array(y + ty * tile, pa.int32()), pa.array(x + tx * tile, pa.int32())]
            for out, reach in zip(outs, reaches):
                cut = radius - reach
                good = eroded(ok[cut : ok.shape[0] - cut, cut : ok.shape[1] - cut], reach)
                cols.append(pa.array(np.ascontiguousarray(out, np.float32).ravel(), mask=~good.ravel()))
            yield pa.record_batch(cols, ["y", "x", *names])

    return raster._dealt(radius, tile).mapInArrow(run, "y int, x int, " + ", ".join(f"{n} float" for n in names))


def stencil_raster(raster: Raster, radius: int, kernel, tile: int = TILE) -> Raster:
    """A neighbourhood operation with one output."""
    return Raster(stencil(raster, ["v"], [radius], lambda z: [kernel(z)], tile), raster.width, raster.height, raster.grid)
