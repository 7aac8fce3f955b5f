"""GeoTIFF and Cloud Optimized GeoTIFF as rasters.

The driver reads the directories; each task reads and decodes rows of blocks by byte ranges, so
only the chosen band and level leave the store. Classic and BigTIFF, both byte orders, tiles and
strips, chunky and planar, integers of 8 to 32 bits and floats of 32 and 64; none, LZW, Deflate,
PackBits and Zstandard, with no, horizontal or floating-point predictor. Anything else is
refused by name.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from gridloom.grid import CRS, Grid
from gridloom.raster import Raster
from gridloom.sources.store import reader

# Fixed values of the format: tags, field types (struct code and size), compressions.
(SUBFILE, WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SUB_IFDS, FORMAT, PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA) = (
    254, 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 330, 339, 33550, 33922, 34264, 34735, 42113,
)
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
CODECS = {1: "none", 5: "LZW", 8: "Deflate", 32946: "Deflate", 32773: "PackBits", 50000: "ZSTD"}
REFUSED = {2: "CCITT RLE", 3: "CCITT T.4", 4: "CCITT T.6", 6: "old JPEG", 7: "JPEG", 34712: "JPEG 2000", 34887: "LERC", 34925: "LZMA", 50001: "WebP", 50002: "JPEG XL"}
GEOGRAPHIC_KEY, PROJECTED_KEY, RASTER_KEY, MODEL_KEY, PIXEL_IS_POINT, USER_DEFINED = 2048, 3072, 1025, 1024, 2, 32767
EPSILON32, MOST_BLOCK = 2.0**-23, 64 << 20


@dataclass
class Image:
    """One directory: an image's layout."""

    width: int
    height: int
    bands: int
    dtype: np.dtype
    codec: str
    predictor: int
    planar: bool
    block_w: int
    block_h: int
    offsets: list[int]
    counts: list[int]
    subfile: int
    reversed_bits: bool
    big: bool
    bits: int
    tags: dict = field(repr=False)

    @property
    def across(self) -> int:
        return -(-self.width // self.block_w)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_h)


@dataclass
class GeoTiff:
    """What the directories say: levels from full resolution down, their masks, NoData and grid."""

    uri: str
    levels: list[Image]
    masks: list[Image | None]
    nodata: float | None
    grid: Grid
    georeferenced: bool

    @property
    def bands(self) -> int:
        return self.levels[0].bands

    def level_grid(self, level: int) -> Grid:
        im, full = self.levels[level], self.levels[0]
        g = self.grid
        if not level or not self.georeferenced:
            return Grid(im.width, im.height, g.res_x, g.res_y, g.origin_x, g.origin_y, g.crs)
        return Grid(im.width, im.height, g.res_x * (full.width / im.width), g.res_y * (full.height / im.height), g.origin_x, g.origin_y, g.crs)


def _directories(read):
    """All directories: lists of tags, each with its values, in the order of the chain; SubIFDs of the first come after it."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    version = struct.unpack(order + "H", head[2:4])[0]
    if version not in (42, 43):
        raise ValueError(f"TIFF version {version} is not supported")
    wide = version == 43
    at = struct.unpack(order + ("Q" if wide else "I"), head[8:16] if wide else head[4:8])[0]

    def values(kind, count, raw):
        code = FIELD.get(kind)
        if code is None:
            return ()
        size = struct.calcsize(order + code) * count
        if size > 256 << 20:
            raise ValueError("a tag is too large")
        data = raw[:size] if size <= (8 if wide else 4) else read(struct.unpack(order + ("Q" if wide else "I"), raw)[0], size)
        if len(data) < size:
            raise ValueError("a tag lies outside the file")
        if kind == 2:
            return (data.split(b"\0")[0].decode("latin-1"),)
        if kind == 7:
            return (bytes(data),)
        got = struct.unpack(order + code * count, data)
        return got

    def one(at):
        n = struct.unpack(order + ("Q" if wide else "H"), read(at, 8 if wide else 2))[0]
        if n > 4096:
            raise ValueError("a directory is too large")
        entry, start = (20, at + 8) if wide else (12, at + 2)
        data = read(start, n * entry + (8 if wide else 4))
        tags = {}
        for k in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, k * entry)
            count = struct.unpack_from(order + ("Q" if wide else "I"), data, k * entry + 4)[0]
            tags[tag] = (kind, count, data[k * entry + (12 if wide else 8) : (k + 1) * entry])
        return {t: values(*v) for t, v in tags.items()}, struct.unpack_from(order + ("Q" if wide else "I"), data, n * entry)[0]

    out, seen = [], set()
    while at and at not in seen and len(out) < 1024:
        seen.add(at)
        try:
            tags, nxt = one(at)
        except (struct.error, ValueError):
            if not out:
                raise ValueError("the first directory can't be read") from None
            break
        out.append(tags)
        if len(out) == 1:
            for sub in tags.get(SUB_IFDS, ()):
                seen.add(sub)
                out.append(one(sub)[0])
        at = nxt
    return out, order == ">"


def _image(tags: dict, big: bool) -> Image:
    one = lambda tag, default: tags[tag][0] if tags.get(tag) else default
    width, height, bands = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    if not (width and height):
        raise ValueError("an image without size")
    bits, formats = set(tags.get(BITS, (1,))), set(tags.get(FORMAT, (1,)))
    if len(bits) != 1 or len(formats) != 1:
        raise ValueError("bands of different types are not supported")
    bits, fmt = bits.pop(), formats.pop()
    kinds = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8", (1, 1): "u1"}
    if (bits, fmt) not in kinds or (bits == 1 and not one(SUBFILE, 0) & 4):
        raise ValueError(f"{bits}-bit samples of format {fmt} are not supported")
    compression = one(COMPRESSION, 1)
    if compression not in CODECS:
        raise ValueError(f"compression {REFUSED.get(compression, compression)} is not supported")
    if one(PHOTOMETRIC, 1) == 6 or (one(PHOTOMETRIC, 1) in (5, 8, 32845) and bits == 8):
        raise ValueError(f"photometric interpretation {one(PHOTOMETRIC, 1)} is not supported")
    predictor = one(PREDICTOR, 1)
    if predictor not in (1, 2, 3) or (predictor == 3 and fmt != 3):
        raise ValueError(f"predictor {predictor} is not supported here")
    tiled = TILE_WIDTH in tags
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not (0 < bw * bh * max(bands, 1) <= MOST_BLOCK):
        raise ValueError("a block is too large")
    planar = one(PLANAR, 1) == 2 and bands > 1
    n = -(-width // bw) * -(-height // bh) * (bands if planar else 1)
    offsets = list(tags.get(TILE_OFFSETS) or tags.get(STRIP_OFFSETS) or ())
    counts = list(tags.get(TILE_COUNTS) or tags.get(STRIP_COUNTS) or ())
    if not counts and CODECS[compression] == "none":
        counts = [bw * bh * (1 if planar else bands) * bits // 8] * len(offsets)
    offsets, counts = (x[:n] + [0] * (n - len(x)) for x in (offsets, counts))
    dtype = np.dtype(kinds[bits, fmt]).newbyteorder(">" if big else "<")
    return Image(width, height, bands, dtype, CODECS[compression], predictor, planar, bw, bh, offsets, counts, one(SUBFILE, 0), one(FILL_ORDER, 1) == 2, big, bits, tags)


def _nodata_text(text: str) -> float | None:
    try:
        return float(text.strip().split()[0])
    except (ValueError, IndexError):
        return None


def _georeference(im: Image) -> tuple[Grid, bool]:
    scale, tie, matrix = (im.tags.get(t, ()) for t in (PIXEL_SCALE, TIEPOINT, TRANSFORM))
    keys = im.tags.get(GEO_KEYS, ())
    short = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    gt = None
    if len(scale) >= 2 and scale[0] and scale[1]:
        if len(tie) >= 6:
            sy = -abs(scale[1])
            gt = (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] - tie[1] * sy, 0.0, sy)
    elif len(matrix) == 16:
        gt = (matrix[3], matrix[0], matrix[1], matrix[7], matrix[4], matrix[5])
    code = {1: short.get(PROJECTED_KEY), 2: short.get(GEOGRAPHIC_KEY)}.get(short.get(MODEL_KEY)) or 0
    own = [k for k in short if (GEOGRAPHIC_KEY < k < 2062 and k != 2052 and k != 2054) or (PROJECTED_KEY < k < 3096 and k != 3076) or (short.get(MODEL_KEY) == 1 and k == GEOGRAPHIC_KEY)]
    crs = CRS(f"EPSG:{code}" if 0 < code < USER_DEFINED and not own and (gt or len(tie) < 6) else "")
    if gt is None:
        return Grid(im.width, im.height, 1.0, 1.0, 0.0, 0.0, crs), False
    if gt[2] or gt[4]:
        raise ValueError("a rotated or sheared geotransform is not supported")
    x, y = gt[0], gt[3]
    if short.get(RASTER_KEY) == PIXEL_IS_POINT:
        x, y = x - 0.5 * gt[1], y - 0.5 * gt[5]
    return Grid(im.width, im.height, gt[1], gt[5], x, y, crs), True


def open_geotiff(uri: str) -> GeoTiff:
    """Read a file's directories."""
    dirs, big = _directories(reader(uri))
    first = _image(dirs[0], big)
    levels, masks = [first], {}
    for tags in dirs[1:]:
        try:
            im = _image(tags, big)
        except ValueError:
            continue
        if im.subfile & 4:
            masks[im.width, im.height] = im
        elif im.subfile & 1 and im.bands == first.bands and im.dtype == first.dtype:
            levels.append(im)
    grid, ok = _georeference(first)
    text = first.tags.get(NODATA)
    return GeoTiff(uri, levels, [masks.get((im.width, im.height)) for im in levels], _nodata_text(text[0]) if text else None, grid, ok)


# decoding


def unpack_bits(data: bytes, want: int) -> bytes:
    """PackBits."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < want:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def unpack_lzw(data: bytes, want: int) -> bytes:
    """LZW with the code width growing one code early; the old style (lowest bits first) is told by its first bytes."""
    old = len(data) > 1 and data[0] == 0 and data[1] & 1
    out, table, width, prev = bytearray(), [], 9, None
    acc = bits = 0
    for byte in data:
        if old:
            acc |= byte << bits
        else:
            acc = acc << 8 | byte
        bits += 8
        if bits < width:
            continue
        if old:
            code, acc = acc & ((1 << width) - 1), acc >> width
        else:
            code = acc >> (bits - width)
            acc &= (1 << (bits - width)) - 1
        bits -= width
        if code == 257:
            break
        if code == 256:
            table, width, prev = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if not table:
            raise ValueError("LZW data without a clear code")
        if prev is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("a broken LZW code")
            entry = table[code] if code < len(table) else prev + prev[:1]
            table.append(prev + entry[:1])
        out += entry
        prev = entry
        if len(out) >= want:
            break
        if len(table) + (0 if old else 1) >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def decompressed(im: Image, data: bytes, want: int) -> bytes:
    """A block's bytes."""
    if im.reversed_bits:
        data = np.packbits(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).tobytes()
    if im.codec == "Deflate":
        out = zlib.decompressobj().decompress(data, want)
    elif im.codec == "LZW":
        out = unpack_lzw(data, want)
    elif im.codec == "PackBits":
        out = unpack_bits(data, want)
    elif im.codec == "ZSTD":
        import zstandard

        out = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    else:
        out = data
    return out[:want]


def block(im: Image, read, index: int, rows: int, band: int) -> np.ndarray | None:
    """One band of a block as (rows, block_w); None if the file doesn't have it."""
    if not im.counts[index] or not im.offsets[index]:
        return None
    samples = 1 if im.planar else im.bands
    if im.bits == 1:
        line = -(-im.block_w * samples // 8)
        raw = decompressed(im, read(im.offsets[index], im.counts[index]), line * rows)
        if len(raw) < line * rows:
            raise ValueError("a block is short")
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : im.block_w * samples].reshape(rows, im.block_w, samples)[:, :, 0]
    size = im.dtype.itemsize
    want = rows * im.block_w * samples * size
    raw = decompressed(im, read(im.offsets[index], im.counts[index]), want)
    if len(raw) < want:
        raise ValueError("a block is short")
    if im.predictor == 3:
        d = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, im.block_w * samples)
        d = np.ascontiguousarray(d.transpose(0, 2, 1))  # bytes of a sample side by side, highest first
        a = d.reshape(rows, -1).view(im.dtype.newbyteorder(">")).reshape(rows, im.block_w, samples)
    else:
        a = np.frombuffer(raw, im.dtype).reshape(rows, im.block_w, samples)
        if im.predictor == 2:
            whole = np.dtype(f"u{size}")
            a = np.cumsum(a.view(whole.newbyteorder(im.dtype.byteorder)).astype(whole), axis=1, dtype=whole).view(im.dtype.newbyteorder("="))
    return a[:, :, 0 if im.planar else band]


def no_data(v: float | None, dtype: np.dtype) -> float | None:
    """A NoData value as samples can hold it; None if they can't."""
    if v is None:
        return None
    if dtype.kind != "f":
        info = np.iinfo(dtype)
        return float(math.trunc(v)) if info.min <= v <= info.max else None
    if math.isnan(v) or dtype.itemsize == 8:
        return v
    top = float(np.finfo(np.float32).max)
    for edge in (top, -top):
        if abs(v - edge) < 1e-10 * top:
            v = edge
    with np.errstate(over="ignore"):
        return float(np.float32(v))


def is_no_data(a: np.ndarray, v: float | None) -> np.ndarray:
    """Samples that count as NoData: integers by equality, floats within a relative tolerance, any NaN for NaN."""
    if v is None:
        return np.zeros(a.shape, bool)
    if a.dtype.kind != "f":
        return a == int(v)
    if math.isnan(v):
        return np.isnan(a)
    kind = np.dtype(f"f{a.dtype.itemsize}").type
    a, n, e = a.astype(kind), kind(v), kind(EPSILON32)
    with np.errstate(all="ignore"):
        return (a == n) | (np.abs(a - n) < e * np.abs(a + n) * kind(2))


def _rows(im: Image, mask: Image | None, read, block_row: int, band: int, nodata: float | None, lo: int = 0, hi: int | None = None):
    """A row of blocks from block lo to block hi: float32 values and validity, from column lo * block_w on."""
    y0, h = block_row * im.block_h, min(im.block_h, im.height - block_row * im.block_h)
    rows = im.block_h if TILE_WIDTH in im.tags else h
    hi = im.across if hi is None else hi
    left, right = lo * im.block_w, min(im.width, hi * im.block_w)
    out, ok = np.zeros((h, im.width), np.float32), np.ones((h, im.width), bool)
    for bx in range(lo, hi):
        index = (band * im.down + block_row) * im.across + bx if im.planar else block_row * im.across + bx
        a = block(im, read, index, rows, band)
        x0, w = bx * im.block_w, min(im.block_w, im.width - bx * im.block_w)
        if a is None:
            out[:, x0 : x0 + w] = 0 if nodata is None else nodata
            ok[:, x0 : x0 + w] = nodata is None
            continue
        a = a[:h, :w]
        with np.errstate(over="ignore"):
            out[:, x0 : x0 + w] = a.astype(np.float32)
        ok[:, x0 : x0 + w] = ~is_no_data(a, nodata)
    if mask is not None:
        ok[:] = False
        for my in range(y0 // mask.block_h, -(-(y0 + h) // mask.block_h)):
            n = mask.block_h if TILE_WIDTH in mask.tags else min(mask.block_h, mask.height - my * mask.block_h)
            for bx in range(left // mask.block_w, -(-right // mask.block_w)):
                a = block(mask, read, my * mask.across + bx, n, 0)
                if a is None:
                    continue
                top, x0 = my * mask.block_h, bx * mask.block_w
                first, end, w = max(y0, top), min(y0 + h, top + n, mask.height), min(mask.block_w, mask.width - x0)
                ok[first - y0 : end - y0, x0 : x0 + w] = a[first - top : end - top, :w] != 0
    return out[:, left:right], ok[:, left:right]


def read_geotiff(spark: SparkSession, uri: str, band: int = 0, level: int = 0, window: tuple[int, int, int, int] | None = None) -> Raster:
    """A band (from 0) of a level (0: full resolution, then overviews) as a raster; a task for each row of blocks at most.

    ``window`` (x, y, width, height) is a raster of its own, like ``Raster.window``; only the blocks it touches are read.
    """
    f = open_geotiff(uri)
    if not 0 <= level < len(f.levels) or not 0 <= band < f.bands:
        raise ValueError(f"band {band} of {f.bands}, level {level} of {len(f.levels)}")
    im, mask = f.levels[level], f.masks[level]
    nodata = None if mask is not None else no_data(f.nodata, im.dtype)
    x0, y0, w, h = window or (0, 0, im.width, im.height)
    grid = f.level_grid(level).window(x0, y0, w, h)
    lo, hi = x0 // im.block_w, -(-(x0 + w) // im.block_w)

    def run(batches):
        read = reader(uri)
        for b in batches:
            for k in b.column(0).to_pylist():
                v, ok = _rows(im, mask, read, k, band, nodata, lo, hi)
                top, left = k * im.block_h, lo * im.block_w
                part = (slice(max(0, y0 - top), min(v.shape[0], y0 + h - top)), slice(x0 - left, x0 + w - left))
                v, ok = v[part], ok[part]
                y, x = np.divmod(np.arange(v.size, dtype=np.int32), max(w, 1))
                yield pa.record_batch([pa.array(y + max(0, top - y0), pa.int32()), pa.array(x, pa.int32()), pa.array(v.ravel(), mask=~ok.ravel())], ["y", "x", "v"])

    first, end = (y0 // im.block_h, -(-(y0 + h) // im.block_h)) if w and h else (0, 0)
    rows = spark.range(first, end, 1, max(1, min(end - first, 10_000)))
    return Raster(rows.mapInArrow(run, "y int, x int, v float"), w, h, grid)
