"""Zarr version 3 arrays as N-dimensional arrays and rasters: a task reads whole chunks.

Regular chunk grids with either key encoding; codecs bytes, gzip, zstd, crc32c and
sharding_indexed; integers of 8 to 64 bits and floats of 32 and 64. Elements equal to the fill
value are invalid unless it is to be ignored, compared in the array's own type.
"""

from __future__ import annotations

import gzip
import json
import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.grid import CRS, Grid
from gridloom.operators.ndarray import TYPES, NdArray
from gridloom.raster import Raster
from gridloom.sources.store import reader, store_of

#: The polynomial of CRC-32C, lowest bit first (a fixed value).
_POLYNOMIAL = 0x82F63B78
_LANE = 1 << 10


def _after_byte() -> np.ndarray:
    """The register after each byte, from 0."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


_BYTE = _after_byte()


def _through_zeros(c: np.ndarray, n: int) -> np.ndarray:
    """Registers after n zero bytes: the register's bits move independently, so n bytes are squarings of one."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = columns >> np.uint32(8) ^ _BYTE[columns & 255]
    apply = lambda m, v: np.bitwise_xor.reduce(np.where((v[..., None] >> np.arange(32, dtype=np.uint32)) & 1, m, np.uint32(0)), axis=-1)
    while n:
        if n & 1:
            c = apply(step, c)
        step, n = apply(step, step), n >> 1
    return c


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli): lanes of the data side by side, then folded in order."""
    lanes = len(data) // _LANE
    body = np.frombuffer(data, np.uint8, lanes * _LANE).reshape(lanes, _LANE)
    c = np.zeros(lanes, np.uint32)
    for k in range(_LANE):
        c = c >> np.uint32(8) ^ _BYTE[(c ^ body[:, k]) & 255]
    # pairs of lanes become one, the left one moved through the right one's length; an odd one leads, as zeros before it change nothing
    width = _LANE
    while len(c) > 1:
        if len(c) % 2:
            c = np.concatenate([np.zeros(1, np.uint32), c])
        c = _through_zeros(c[0::2], width) ^ c[1::2]
        width *= 2
    start = _through_zeros(np.full(1, 0xFFFFFFFF, np.uint32), lanes * _LANE)
    register = int((start ^ c)[0]) if lanes else int(start[0])
    for b in data[lanes * _LANE :]:
        register = register >> 8 ^ int(_BYTE[(register ^ b) & 255])
    return register ^ 0xFFFFFFFF


@dataclass
class ZarrArray:
    """An array's metadata."""

    uri: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    fill: object
    codecs: list
    separator: str
    prefix: str
    attributes: dict

    def key(self, index: tuple[int, ...]) -> str:
        parts = [self.prefix] * bool(self.prefix) + [str(i) for i in index]
        return f"{self.uri}/{self.separator.join(parts)}" if parts else f"{self.uri}/0"


def _fill(value, dtype: str):
    special = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
    if isinstance(value, str) and value.startswith("0x"):
        bits = int(value, 16)
        return np.array([bits], f"u{np.dtype(dtype).itemsize}").view(dtype)[0]
    return np.dtype(dtype).type(special.get(value, value))


def open_zarr(uri: str) -> ZarrArray:
    """Read ``zarr.json`` of an array."""
    read = reader(f"{uri.rstrip('/')}/zarr.json")
    m = json.loads(read(0, read.size))
    if m.get("zarr_format") != 3 or m.get("node_type") != "array":
        raise ValueError("not a Zarr version 3 array")
    if m["data_type"] not in TYPES:
        raise ValueError(f"data type {m['data_type']} is not supported")
    if m["chunk_grid"]["name"] != "regular":
        raise ValueError(f"chunk grid {m['chunk_grid']['name']} is not supported")
    key = m.get("chunk_key_encoding", {"name": "default"})
    default = key["name"] == "default"
    if not default and key["name"] != "v2":
        raise ValueError(f"chunk key encoding {key['name']} is not supported")
    separator = key.get("configuration", {}).get("separator", "/" if default else ".")
    _checked(m["codecs"])
    return ZarrArray(uri.rstrip("/"), tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), m["data_type"], _fill(m["fill_value"], m["data_type"]), m["codecs"], separator, "c" if default else "", m.get("attributes", {}))


def _checked(codecs: list) -> None:
    for c in codecs:
        if c["name"] not in ("bytes", "gzip", "zstd", "crc32c", "sharding_indexed", "transpose"):
            raise ValueError(f"codec {c['name']} is not supported")
        if c["name"] == "sharding_indexed":
            _checked(c["configuration"]["codecs"])
            _checked(c["configuration"].get("index_codecs", []))


def _without_codecs(data: bytes, codecs: list) -> bytes:
    """Undo the codecs from bytes to bytes."""
    for c in reversed(codecs):
        if c["name"] == "gzip":
            data = gzip.decompress(data)
        elif c["name"] == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif c["name"] == "crc32c":
            data, check = data[:-4], struct.unpack("<I", data[-4:])[0]
            if crc32c(data) != check:
                raise ValueError("a checksum doesn't fit")
    return data


def decoded(data: bytes, codecs: list, dtype: str, shape: tuple[int, ...], fill) -> np.ndarray:
    """A chunk's elements."""
    first = next(k for k, c in enumerate(codecs) if c["name"] in ("bytes", "sharding_indexed"))
    data = _without_codecs(data, codecs[first + 1 :])
    orders = [c["configuration"]["order"] for c in codecs[:first] if c["name"] == "transpose"]
    stored = shape
    for o in orders:
        stored = tuple(stored[k] for k in o)
    conf = codecs[first].get("configuration", {})
    if codecs[first]["name"] == "bytes":
        order = "<" if conf.get("endian", "little") == "little" else ">"
        a = np.frombuffer(data, np.dtype(dtype).newbyteorder(order)).astype(dtype).reshape(stored)
    else:
        inner = tuple(conf["chunk_shape"])
        grid = tuple(s // i for s, i in zip(stored, inner))
        n = math.prod(grid)
        index_codecs = conf.get("index_codecs", [{"name": "bytes"}, {"name": "crc32c"}])
        size = 16 * n + 4 * sum(c["name"] == "crc32c" for c in index_codecs)
        raw = data[-size:] if conf.get("index_location", "end") == "end" else data[:size]
        index = np.frombuffer(_without_codecs(raw, index_codecs), "<u8").reshape(n, 2)
        a = np.full(stored, fill, dtype)
        for k, (at, length) in enumerate(index.tolist()):
            if at == (1 << 64) - 1:
                continue
            where = np.unravel_index(k, grid)
            a[tuple(slice(w * i, (w + 1) * i) for w, i in zip(where, inner))] = decoded(data[at : at + length], conf["codecs"], dtype, inner, fill)
    for o in reversed(orders):
        a = a.transpose(np.argsort(o))
    return a


def _is_fill(a: np.ndarray, fill) -> np.ndarray:
    return np.isnan(a) if a.dtype.kind == "f" and math.isnan(float(fill)) else a == fill


def read_zarr(spark: SparkSession, uri: str, ignore_fill: bool = False, window: tuple[tuple[int, int], ...] | None = None) -> NdArray:
    """All dimensions of an array; chunks that nobody wrote read as the fill value.

    ``window`` has a range (first, end) for each dimension; only the chunks it touches are read, and places count from its start.
    """
    z = open_zarr(uri)
    window = window or tuple((0, s) for s in z.shape)
    if len(window) != len(z.shape) or any(not 0 <= a <= e <= s for (a, e), s in zip(window, z.shape)):
        raise ValueError("the window leaves the array")
    lead = tuple(a // c for (a, _), c in zip(window, z.chunks))
    grid = tuple(-(-e // c) - f if e > a else 0 for (a, e), c, f in zip(window, z.chunks, lead))
    n, rank, t = math.prod(grid), len(z.shape), TYPES[z.dtype][0]
    arrow = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0), "float": pa.float32(), "double": pa.float64()}[t]

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                at = tuple(int(i) + f for i, f in zip(np.unravel_index(k, grid), lead)) if rank else ()
                store, path = store_of(z.key(at))
                if store.get_file_info(path).type.name == "File":
                    read = reader(z.key(at))
                    a = decoded(read(0, read.size), z.codecs, z.dtype, z.chunks, z.fill)
                else:
                    a = np.full(z.chunks, z.fill, z.dtype)
                start = [max(0, w - i * c) for i, c, (w, _) in zip(at, z.chunks, window)]
                a = a[tuple(slice(f, min(c, e - i * c)) for f, i, c, (_, e) in zip(start, at, z.chunks, window))]
                ok = np.ones(a.shape, bool) if ignore_fill else ~_is_fill(a, z.fill)
                flat = a.ravel()
                place = [f + i * c - w for f, i, c, (w, _) in zip(start, at, z.chunks, window)]
                repeats = [math.prod(a.shape[d + 1 :]) for d in range(rank)]  # of each place along a dimension, and of the whole run of them
                where = [np.tile(np.repeat(np.arange(f, f + m, dtype=np.int32), r), a.size // max(1, m * r)) for f, m, r in zip(place, a.shape, repeats)]
                if t.startswith("decimal"):
                    import decimal

                    v = pa.array([decimal.Decimal(int(x)) if o else None for x, o in zip(flat, ok.ravel())], arrow)
                else:
                    v = pa.array(flat.astype(arrow.to_pandas_dtype()), arrow, mask=~ok.ravel())
                yield pa.record_batch([*(pa.array(w, pa.int32()) for w in where), v], [*(f"i{d}" for d in range(rank)), "v"])

    schema = ", ".join([*(f"i{d} int" for d in range(rank)), f"v {t}"])
    return NdArray(spark.range(0, n, 1, max(1, min(n, 10_000))).mapInArrow(run, schema), tuple(e - a for a, e in window), z.dtype)


def zarr_grid(z: ZarrArray) -> Grid:
    """The grid of the last two dimensions, from the array's attributes."""
    height, width = z.shape[-2:]
    crs, t = CRS(z.attributes.get("proj:code") or ""), z.attributes.get("spatial:transform")
    registration = z.attributes.get("spatial:registration") or "pixel"
    if registration not in ("pixel", "node"):
        raise ValueError(f"registration {registration} is neither pixel nor node")
    if t is None:
        return Grid(width, height, 1.0, 1.0, 0.0, 0.0, crs)
    if len(t) != 6:
        raise ValueError("a transform has six numbers")
    a, b, c, d, e, f = t
    if b or d:
        raise ValueError("a rotated or sheared transform is not supported")
    half = registration == "node"
    return Grid(width, height, a, e, c - a / 2 * half, f - e / 2 * half, crs)


def read_zarr_raster(spark: SparkSession, uri: str, index: tuple[int, ...] = (), ignore_fill: bool = False, window: tuple[int, int, int, int] | None = None) -> Raster:
    """The last two dimensions as a raster of float32; ``index`` fixes the others, ``window`` is (x, y, width, height).

    Only the chunks that index and window touch are read.
    """
    z = open_zarr(uri)
    if len(z.shape) < 2 or len(index) != len(z.shape) - 2:
        raise ValueError("a raster needs two dimensions, and an index for each other one")
    if any(not 0 <= i < n for i, n in zip(index, z.shape)):
        raise ValueError("the index leaves the array")
    grid = zarr_grid(z)
    x, y, w, h = window or (0, 0, grid.width, grid.height)
    grid = grid.window(x, y, w, h)
    a = read_zarr(spark, uri, ignore_fill, (*((i, i + 1) for i in index), (y, y + h), (x, x + w)))
    for _ in index:
        a = a.select(0, 0)
    df = a.df.select(F.col("i0").alias("y"), F.col("i1").alias("x"), F.col("v").cast("float").alias("v"))
    return Raster(df, w, h, grid)
