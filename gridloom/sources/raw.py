"""Headerless little-endian float32 rasters: one file, or a folder of strips.

A file of a cell grid is read by ranges of rows, a task each; nothing passes through the driver.
Writing makes a folder with one file for each strip of rows, written atomically by the task that
has it, and a manifest; ``join`` makes one file of it where a single one is wanted.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.raster import Raster, eroded
from gridloom.sources.store import put, reader, store_of

#: Cells that a task reads or writes at a time.
STRIP_CELLS = 1 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``); a local session without one gets /tmp, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster sees")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/gridloom-raster/{uuid.uuid4().hex}-{name}"


def valid_cells(data: np.ndarray, fill: float | None) -> np.ndarray:
    """Cells that are not the fill value, by equality; a NaN fill matches any NaN."""
    if fill is None:
        return np.ones(data.shape, bool)
    return ~np.isnan(data) if math.isnan(fill) else ~(data == np.float32(fill))


def _strips(height: int, width: int) -> int:
    return max(1, min(max(height, 1), STRIP_CELLS // max(width, 1)))


def read_raw(spark: SparkSession, path: str, width: int, height: int, fill: float | None = None, grid: Grid | None = None) -> Raster:
    """A raw file, or a folder of strips, as a raster. A short file is an error."""
    store, p = store_of(path)
    folder = store.get_file_info(p).type.name == "Directory"
    rows = _strips(height, width)
    if folder:
        with store.open_input_stream(f"{p}/manifest.json") as f:
            m = json.loads(f.read())
        if (m["width"], m["height"]) != (width, height):
            raise ValueError(f"the folder holds {m['width']} x {m['height']}")
        rows = m["rows"]

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                y0, y1 = k * rows, min(height, (k + 1) * rows)
                want = 4 * width * (y1 - y0)
                data = reader(f"{path}/strip-{k:08d}.f32")(0, want) if folder else reader(path)(4 * width * y0, want)
                if len(data) != want:
                    raise EOFError(f"{path} is short")
                z = np.frombuffer(data, "<f4")
                y, x = np.divmod(np.arange(len(z), dtype=np.int32), width)
                yield pa.record_batch([pa.array(y + y0, pa.int32()), pa.array(x, pa.int32()), pa.array(z, mask=~valid_cells(z, fill))], ["y", "x", "v"])

    n = -(-height // rows) if height and width else 0
    parts = spark.range(0, n, 1, max(1, min(n, 10_000)))
    return Raster(parts.mapInArrow(run, "y int, x int, v float"), width, height, grid)


def write_raw(r: Raster, path: str, fill: float | None = None) -> None:
    """Write a raster as a folder of strips. Invalid cells become ``fill``; without one they are an error."""
    store, p = store_of(path)
    store.create_dir(p, recursive=True)
    width, height, rows = r.width, r.height, _strips(r.height, r.width)
    strips = r.df.select(F.expr(f"cast(y div {rows} as int)").alias("ty"), F.lit(0).alias("tx"), "y", "x", "v").repartition("ty").sortWithinPartitions("ty")

    def run(batches):
        for k, z, ok in _whole_strips(batches, rows, width, height):
            if not ok.all():
                if fill is None:
                    raise ValueError("invalid cells need a fill value")
                z = np.where(ok, z, np.float32(fill))
            put(f"{path}/strip-{k:08d}.f32", z.astype("<f4").tobytes())
            yield pa.record_batch([pa.array([k], pa.int32())], ["k"])

    done = strips.mapInArrow(run, "k int").count()
    if done != (-(-height // rows) if width else 0):
        raise ValueError("rows are missing")
    put(f"{path}/manifest.json", json.dumps({"width": width, "height": height, "rows": rows, "fill": None if fill is None else str(fill)}).encode())


def _whole_strips(batches, rows: int, width: int, height: int):
    held, key = [], None

    def built(k, parts):
        n = min(rows, height - k * rows)
        z, ok = np.zeros((n, width), np.float32), np.zeros((n, width), bool)
        for y, x, v, good in parts:
            z[y - k * rows, x], ok[y - k * rows, x] = v, good
        return k, z, ok

    for b in batches:
        if not b.num_rows:
            continue
        ty, _, y, x = (b.column(i).to_numpy() for i in range(4))
        good, v = b.column(4).is_valid().to_numpy(zero_copy_only=False), b.column(4).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(ty[1:] != ty[:-1]) + 1).tolist()
        for a, z in zip([0, *cuts], [*cuts, len(ty)]):
            if ty[a] != key and held:
                yield built(key, held)
                held = []
            key = int(ty[a])
            held.append((y[a:z], x[a:z], v[a:z], good[a:z]))
    if held:
        yield built(key, held)


def join_strips(path: str, target: str) -> None:
    """One raw file of a folder of strips, streamed in order."""
    store, p = store_of(path)
    with store.open_input_stream(f"{p}/manifest.json") as f:
        m = json.loads(f.read())
    out_store, out = store_of(target)
    with out_store.open_output_stream(out) as f:
        for k in range(-(-m["height"] // m["rows"])):
            with store.open_input_stream(f"{p}/strip-{k:08d}.f32") as s:
                while chunk := s.read(1 << 22):
                    f.write(chunk)


def raw_map(spark: SparkSession, paths: list[str], width: int, height: int, target: str, radius: int, kernel, fill: float | None = None, out_fill: float = float("nan")) -> None:
    """An operation from raw files of one size to a folder of strips, without any shuffle.

    ``kernel`` gets a strip of each file with ``radius`` cells around it. Each task reads its rows and
    ``radius`` rows around them, so memory is one strip whatever the raster's size. A cell is valid
    where all cells within the radius are, in all files, the edge counting as invalid.
    """
    rows = _strips(height, width)
    store, p = store_of(target)
    store.create_dir(p, recursive=True)
    n = -(-height // rows)

    def run(batches):
        reads = [reader(p) for p in paths]
        for b in batches:
            for k in b.column(0).to_pylist():
                y0, y1 = k * rows, min(height, (k + 1) * rows)
                a, z = max(0, y0 - radius), min(height, y1 + radius)
                strips, ok = [], None
                for read in reads:
                    raw = read(4 * width * a, 4 * width * (z - a))
                    if len(raw) != 4 * width * (z - a):
                        raise EOFError("a raw file is short")
                    data = np.frombuffer(raw, "<f4").reshape(z - a, width)
                    if fill is not None:
                        good = valid_cells(data, fill)
                        ok = good if ok is None else ok & good
                    strips.append(np.pad(data, ((a - (y0 - radius), y1 + radius - z), (radius, radius))) if radius else data)
                with np.errstate(all="ignore"):
                    v = np.asarray(kernel(*strips), "<f4")
                if ok is not None:
                    good = eroded(np.pad(ok, ((a - (y0 - radius), y1 + radius - z), (radius, radius))), radius)
                    v = np.where(good, v, np.float32(out_fill))
                elif radius:
                    v = np.array(v)
                    v[:, :radius], v[:, width - radius :] = out_fill, out_fill
                    v[: max(0, radius - y0)], v[max(0, height - radius - y0) :] = out_fill, out_fill
                put(f"{target}/strip-{k:08d}.f32", v.astype("<f4", copy=False).tobytes())
                yield pa.record_batch([pa.array([k], pa.int64())], ["k"])

    spark.range(0, n, 1, max(1, min(n, 10_000))).mapInArrow(run, "k long").count()
    put(f"{target}/manifest.json", json.dumps({"width": width, "height": height, "rows": rows, "fill": str(out_fill)}).encode())


def raw_stencil(spark: SparkSession, path: str, width: int, height: int, target: str, radius: int, kernel, fill: float | None = None, out_fill: float = float("nan")) -> None:
    """``raw_map`` of one file."""
    raw_map(spark, [path], width, height, target, radius, kernel, fill, out_fill)


def raw_min_max(spark: SparkSession, path: str, width: int, height: int, fill: float | None = None):
    """One row (min, max, count) of a raw file, NaN-absorbing; a row for each strip meets in one aggregate."""
    rows = _strips(height, width)

    def run(batches):
        read = reader(path)
        for b in batches:
            for k in b.column(0).to_pylist():
                z = np.frombuffer(read(4 * width * k * rows, 4 * width * (min(height, (k + 1) * rows) - k * rows)), "<f4")
                z = z[valid_cells(z, fill)] if fill is not None else z
                lo, hi = (float(z.min()), float(z.max())) if len(z) else (None, None)
                yield pa.record_batch([pa.array([lo], pa.float32()), pa.array([hi], pa.float32()), pa.array([len(z)], pa.int64())], ["lo", "hi", "n"])

    n = -(-height // rows) if width and height else 0
    parts = spark.range(0, n, 1, max(1, min(n, 10_000))).mapInArrow(run, "lo float, hi float, n long")
    nan = F.lit(float("nan")).cast("float")
    none = F.max(F.isnan("lo").cast("int")) == 1
    return parts.agg(F.when(none, nan).otherwise(F.coalesce(F.min("lo"), nan)).alias("min"), F.when(none, nan).otherwise(F.coalesce(F.max("hi"), nan)).alias("max"), F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
