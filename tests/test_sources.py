import http.server
import json
import struct
import threading
import zlib

import numpy as np
import pytest
import zstandard

from gridloom.functions import kernels as k
from gridloom.operators import terrain
from gridloom.raster import Raster
from gridloom.sources import geotiff, raw, zarr
from gridloom.sources.store import reader
from gridloom.streaming.mosaic import SCHEMA, cell_stream, current_mosaic, start_mosaic
from tests.fixtures import ragged, ridges, same


def test_raw_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "STRIP_CELLS", 300)
    z, ok = ragged(40, 30)
    path = f"{tmp_path}/a.f32"
    np.where(ok, z, np.float32(-9999)).astype("<f4").tofile(path)
    got, valid = raw.read_raw(spark, path, 40, 30, fill=-9999).to_numpy()
    assert (valid == ok).all() and same(got[ok], z[ok])
    with pytest.raises(Exception, match="short"):
        raw.read_raw(spark, path, 40, 31).to_numpy()
    assert raw.valid_cells(np.array([0.0, -0.0, 1.0], np.float32), 0.0).tolist() == [False, False, True]
    assert raw.valid_cells(np.array([np.nan, 1.0], np.float32), float("nan")).tolist() == [False, True]


def test_raw_folder_and_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "STRIP_CELLS", 300)
    z, ok = ragged(40, 30)
    r = Raster.from_numpy(spark, z, ok)
    raw.write_raw(Raster(r.df.repartition(4), 40, 30), f"{tmp_path}/b", fill=-1)
    got, valid = raw.read_raw(spark, f"{tmp_path}/b", 40, 30, fill=-1).to_numpy()
    assert (valid == ok).all() and same(got[ok], z[ok])
    raw.join_strips(f"{tmp_path}/b", f"{tmp_path}/one.f32")
    assert same(np.fromfile(f"{tmp_path}/one.f32", "<f4").reshape(30, 40), np.where(ok, z, -1))
    with pytest.raises(Exception, match="fill"):
        raw.write_raw(r, f"{tmp_path}/c")


def test_raw_stencil_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "STRIP_CELLS", 300)
    z, ok = ragged(40, 30)
    path, s = f"{tmp_path}/a.f32", k.Scale(10.0)
    np.where(ok, z, np.float32(-9999)).astype("<f4").tofile(path)
    raw.raw_stencil(spark, path, 40, 30, f"{tmp_path}/s", 1, lambda a: k.slope(*k.horn(a, s), "degrees"), fill=-9999)
    got, valid = raw.read_raw(spark, f"{tmp_path}/s", 40, 30, fill=float("nan")).to_numpy()
    want, good = terrain.slope(Raster.from_numpy(spark, z, ok), 10).to_numpy()
    assert (valid == good).all() and same(got[good], want[good])


def test_raw_map_of_two_files_and_extremes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "STRIP_CELLS", 300)
    z, _ = ragged(40, 30)
    paths = [f"{tmp_path}/a.f32", f"{tmp_path}/b.f32"]
    z.tofile(paths[0]), np.roll(z, 1, 0).tofile(paths[1])
    raw.raw_map(spark, paths, 40, 30, f"{tmp_path}/s", 0, lambda a, b: a + b)
    assert same(raw.read_raw(spark, f"{tmp_path}/s", 40, 30).to_numpy()[0], z + np.roll(z, 1, 0))
    raw.raw_map(spark, paths[:1], 40, 30, f"{tmp_path}/m", 2, lambda a: k.box_mean(a, 2))
    got, valid = raw.read_raw(spark, f"{tmp_path}/m", 40, 30, fill=float("nan")).to_numpy()
    assert valid.sum() == 36 * 26 and valid[2:-2, 2:-2].all() and same(got[2:-2, 2:-2], k.box_mean(z, 2))
    row = raw.raw_min_max(spark, paths[0], 40, 30).first()
    assert (row["min"], row["max"], row["count"]) == (float(z.min()), float(z.max()), 1200)


# GeoTIFF


def lzw(data: bytes) -> bytes:
    """A plain encoder: codes grow one early, a clear code at the start."""
    out = bits = width = 0
    n, width, table = 0, 9, {bytes([i]): i for i in range(256)}
    out, n = 256, 9
    size, w = 258, b""

    def put(code):
        nonlocal out, n
        out, n = out << width | code, n + width

    for c in data:
        c = bytes([c])
        if w + c in table:
            w += c
            continue
        put(table[w])
        table[w + c] = size
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
        if size >= 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        w = c
    if w:
        put(table[w])
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
    put(257)
    return (out << (-n % 8)).to_bytes((n + 7) // 8, "big")


def packbits(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 100):
        part = data[i : i + 100]
        out += bytes([len(part) - 1]) + part if len(set(part)) > 1 or len(part) == 1 else bytes([257 - len(part)]) + part[:1]
    return bytes(out)


PACK = {1: lambda d: d, 5: lzw, 8: zlib.compress, 32773: packbits, 50000: lambda d: zstandard.compress(d)}


def tiff(images, order="<", big=False):
    """A file of images: dicts with data (h, w, bands), block (h, w) or None for one strip, compression, predictor, planar, tags."""
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for im in images:
        a = im["data"]
        h, w, bands = a.shape
        bh, bw = im.get("block") or (h, w)
        tiled, planar, size = bool(im.get("block")), im.get("planar", False), a.dtype.itemsize
        offsets, counts = [], []
        for band in range(bands if planar else 1):
            for y in range(0, h, bh):
                for x in range(0, w, bw):
                    b = a[y : y + bh, x : x + bw, band : band + 1] if planar else a[y : y + bh, x : x + bw]
                    if tiled:
                        b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)))
                    if im.get("absent") == (y // bh, x // bw):
                        offsets.append(0), counts.append(0)
                        continue
                    b = np.ascontiguousarray(b)
                    if im.get("predictor") == 2:
                        u = b.view(f"u{size}")
                        b = np.diff(u, axis=1, prepend=np.zeros_like(u[:, :1]))
                    raw_ = b.astype(b.dtype.newbyteorder(order)).tobytes()
                    if im.get("predictor") == 3:
                        rows = b.astype(b.dtype.newbyteorder(">")).reshape(b.shape[0], -1).view(np.uint8).reshape(b.shape[0], -1, size).transpose(0, 2, 1)
                        d = rows.reshape(b.shape[0], -1, b.shape[2])
                        raw_ = np.diff(d, axis=1, prepend=np.zeros_like(d[:, :1])).tobytes()
                    data = PACK[im.get("compression", 1)](raw_)
                    offsets.append(len(out)), counts.append(len(data))
                    out += data
        tags = {254: (4, [im.get("subfile", 0)]), 256: (4, [w]), 257: (4, [h]), 258: (3, [8 * size] * bands), 259: (3, [im.get("compression", 1)]), 262: (3, [1]), 277: (3, [bands]), 284: (3, [2 if planar else 1]),
                317: (3, [im.get("predictor", 1)]), 339: (3, [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * bands)}
        tags |= {322: (3, [bw]), 323: (3, [bh]), 324: (4, offsets), 325: (4, counts)} if tiled else {273: (4, offsets), 278: (3, [bh]), 279: (4, counts)}
        tags |= im.get("tags", {})
        body, extra = bytearray(), bytearray()
        start = len(out) + (len(out) % 2)
        out += b"\0" * (start - len(out))
        entry, word = (20, "Q") if big else (12, "I")
        after = start + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
        for tag, (kind, v) in sorted(tags.items()):
            data = v if isinstance(v, bytes) else struct.pack(order + {3: "H", 4: "I", 12: "d", 16: "Q"}[kind] * len(v), *v)
            n = len(v)
            room = 8 if big else 4
            if len(data) > room:
                cell = struct.pack(order + word, after + len(extra))
                extra += data + b"\0" * (len(data) % 2)
            else:
                cell = data.ljust(room, b"\0")
            body += struct.pack(order + "HH" + word, tag, kind, n) + cell
        out[link : link + (8 if big else 4)] = struct.pack(order + word, start)
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + body
        link = len(out)
        out += struct.pack(order + word, 0) + extra
    return bytes(out)


GEO = {33550: (12, [30.0, 30.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 1000.0, 2000.0, 0.0]), 34735: (3, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, 32633])}


def bands(dtype, h=29, w=37):
    rng = np.random.default_rng(1)
    if np.dtype(dtype).kind == "f":
        return (rng.normal(size=(h, w, 2)) * 100).astype(dtype)
    info = np.iinfo(dtype)
    return rng.integers(info.min, info.max, (h, w, 2), dtype, endpoint=True)


@pytest.mark.parametrize("compression", [1, 5, 8, 32773, 50000])
@pytest.mark.parametrize("layout", [{"block": (16, 16)}, {}, {"block": (16, 16), "planar": True}])
def test_geotiff_codecs_and_layouts(spark, tmp_path, compression, layout):
    a = bands("float32")
    predictor = 3 if compression in (5, 8, 50000) else 1
    path = f"{tmp_path}/a.tif"
    open(path, "wb").write(tiff([{"data": a, "compression": compression, "predictor": predictor, "tags": GEO, **layout}], order="<" if compression != 8 else ">", big=compression == 5))
    r = geotiff.read_geotiff(spark, path, band=1)
    got, ok = r.to_numpy()
    assert ok.all() and same(got, a[:, :, 1])
    assert (r.grid.origin_x, r.grid.origin_y, r.grid.res_y, r.grid.crs.name) == (1000.0, 2000.0, -30.0, "EPSG:32633")


@pytest.mark.parametrize("layout", [{"block": (16, 16)}, {"block": (16, 16), "planar": True}])
@pytest.mark.parametrize("window", [(17, 3, 9, 20), (0, 0, 37, 29), (31, 15, 6, 2), (5, 5, 0, 4)])
def test_a_geotiff_window_reads_its_blocks_alone(spark, tmp_path, layout, window):
    """The same cells and grid as a window of the whole; blocks that it does not touch may be broken."""
    a, path = bands("float32"), f"{tmp_path}/a.tif"
    mask = {"data": (np.indices((29, 37)).sum(0) % 5 > 0).astype("u1")[:, :, None] * np.uint8(255), "subfile": 4, "block": (16, 16)}
    open(path, "wb").write(tiff([{"data": a, "compression": 8, "predictor": 3, "tags": GEO, **layout}, mask]))
    x, y, w, h = window
    want = geotiff.read_geotiff(spark, path, band=1).window(x, y, w, h)
    (v, ok), grid = want.to_numpy(), want.grid
    content, im = bytearray(open(path, "rb").read()), geotiff.open_geotiff(path).levels[0]
    for k, (at, n) in enumerate(zip(im.offsets, im.counts)):
        by, bx = divmod(k % (im.down * im.across), im.across)
        if not (bx * 16 < x + w and x < bx * 16 + 16 and by * 16 < y + h and y < by * 16 + 16):
            content[at : at + n] = b"!" * n
    open(path, "wb").write(content)
    r = geotiff.read_geotiff(spark, path, band=1, window=window)
    got, valid = r.to_numpy()
    assert r.grid == grid and (valid == ok).all() and same(got[ok], v[ok]) and got.shape == (h, w)
    with pytest.raises(ValueError):
        geotiff.read_geotiff(spark, path, window=(30, 0, 8, 1))


@pytest.mark.parametrize("dtype", ["uint8", "int8", "uint16", "int16", "uint32", "int32", "float64"])
def test_geotiff_samples(spark, tmp_path, dtype):
    a = bands(dtype)
    path = f"{tmp_path}/a.tif"
    open(path, "wb").write(tiff([{"data": a, "compression": 8, "predictor": 1 if dtype == "float64" else 2, "block": (16, 32)}], order=">"))
    r = geotiff.read_geotiff(spark, path)
    got, ok = r.to_numpy()
    assert ok.all() and same(got, a[:, :, 0].astype(np.float32)) and r.grid.res_x == 1.0


def test_geotiff_nodata_overviews_masks_and_absent_blocks(spark, tmp_path):
    a = bands("int16")[:, :, :1]
    a[3, 4], a[20, 30] = 12, 12
    nodata = {42113: (2, b"12.5\0"), **GEO}
    path = f"{tmp_path}/a.tif"
    open(path, "wb").write(tiff([{"data": a, "block": (16, 16), "absent": (0, 1), "tags": nodata}, {"data": a[::2, ::2].copy(), "subfile": 1}]))
    f = geotiff.open_geotiff(path)
    assert len(f.levels) == 2 and f.nodata == 12.5 and f.georeferenced
    got, ok = geotiff.read_geotiff(spark, path).to_numpy()
    assert not ok[3, 4] and not ok[20, 30] and not ok[:16, 16:32].any() and ok[0, 0] and got[0, 0] == a[0, 0, 0]
    small = geotiff.read_geotiff(spark, path, level=1)
    assert (small.width, small.height) == (19, 15) and small.grid.res_x == pytest.approx(30 * 37 / 19)
    mask = (np.indices((29, 37, 1)).sum(0) % 3 > 0).astype(np.uint8) * 255
    open(path, "wb").write(tiff([{"data": a, "tags": nodata}, {"data": mask, "subfile": 4, "block": (16, 16)}]))
    assert (geotiff.read_geotiff(spark, path).to_numpy()[1] == (mask[:, :, 0] > 0)).all()


def test_nodata_rules():
    f4, i2 = np.dtype("float32"), np.dtype("int16")
    assert geotiff.no_data(40000, i2) is None and geotiff.no_data(-9999.9, i2) == -9999 and geotiff.no_data(float("nan"), i2) is None
    assert geotiff.no_data(1e39, f4) == float("inf") and geotiff.no_data(3.4028234663852886e38 * (1 + 1e-11), f4) == float(np.finfo(np.float32).max)
    a = np.array([-9999, np.nextafter(np.float32(-9999), np.float32(0)), -9998, np.nan], np.float32)
    assert geotiff.is_no_data(a, -9999.0).tolist() == [True, True, False, False] and geotiff.is_no_data(a, float("nan")).tolist() == [False, False, False, True]


def test_what_geotiff_refuses(tmp_path):
    a = bands("uint8")
    for change, what in (({259: (3, [7])}, "JPEG"), ({258: (3, [16] * 2), 339: (3, [3] * 2)}, "16-bit"), ({33550: (12, [0.0, 0.0, 0.0]), 34264: (12, [1.0, 2.0] + [0.0] * 14)}, "rotated")):
        path = f"{tmp_path}/x.tif"
        open(path, "wb").write(tiff([{"data": a, "tags": change}]))
        with pytest.raises(ValueError, match=what):
            geotiff.open_geotiff(path)
    open(path, "wb").write(b"no tiff at all, and then some")
    with pytest.raises(ValueError):
        geotiff.open_geotiff(path)


# HTTP


class Ranges(http.server.BaseHTTPRequestHandler):
    data, faults, tag, ranges = b"", 0, '"a"', True

    def do_GET(self):
        if Ranges.faults:
            Ranges.faults -= 1
            self.send_error(503)
            return
        a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        part = Ranges.data[a : b + 1]
        self.send_response(206 if Ranges.ranges else 200)
        self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(Ranges.data)}")
        self.send_header("ETag", Ranges.tag)
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Ranges.faults, Ranges.tag, Ranges.ranges = 0, '"a"', True
    yield f"http://127.0.0.1:{s.server_port}/x.tif"
    s.shutdown()


def test_http_ranges(spark, server):
    a = ridges(300, 200)[:, :, None]
    Ranges.data = tiff([{"data": a, "block": (64, 64), "tags": GEO}])
    Ranges.faults = 2
    got, ok = geotiff.read_geotiff(spark, server).to_numpy()
    assert ok.all() and same(got, a[:, :, 0])
    r = reader(server)
    n = r.requests
    assert r(10, 100) == Ranges.data[10:110] and r(5, 20) == Ranges.data[5:25] and r.requests == n and r(len(Ranges.data) - 3, 99) == Ranges.data[-3:]
    Ranges.tag = '"b"'
    with pytest.raises(OSError, match="changed"):
        r(100_000, 10)
    Ranges.ranges = False
    with pytest.raises(OSError, match="206"):
        reader(server)


# Zarr


def store(path, a, chunks, codecs, write, fill=0, attributes=None, key=None):
    path.mkdir(parents=True, exist_ok=True)
    meta = {"zarr_format": 3, "node_type": "array", "shape": a.shape, "data_type": str(a.dtype), "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": key or {"name": "default"}, "fill_value": fill, "codecs": codecs, "attributes": attributes or {}}
    (path / "zarr.json").write_text(json.dumps(meta))
    for at in np.ndindex(*(-(-s // c) for s, c in zip(a.shape, chunks))):
        part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
        part = np.pad(part, [(0, c - s) for c, s in zip(chunks, part.shape)], constant_values=part.dtype.type(0))
        data = write(at, part)
        if data is not None:
            sep = (key or {}).get("configuration", {}).get("separator", "/" if not key or key["name"] == "default" else ".")
            f = path / sep.join(["c"] * (not key or key["name"] == "default") + [str(i) for i in at])
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_bytes(data)


def test_zarr(spark, tmp_path):
    import gzip

    a = np.arange(2 * 5 * 7, dtype=np.int32).reshape(2, 5, 7)
    big = [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 5}}, {"name": "crc32c"}]

    def write(at, part):
        data = gzip.compress(part.astype(">i4").tobytes())
        return None if at == (1, 0, 1) else data + struct.pack("<I", zarr.crc32c(data))

    store(tmp_path / "a", a, (1, 3, 4), big, write, fill=8, attributes={"spatial:transform": [10.0, 0.0, 100.0, 0.0, -10.0, 200.0], "spatial:registration": "node", "proj:code": "EPSG:3035"})
    r = zarr.read_zarr_raster(spark, f"{tmp_path}/a", (1,))
    got, ok = r.to_numpy()
    assert ok[0, 0] and got[4, 3] == a[1, 4, 3] and not ok[:3, 4:].any() and (r.grid.origin_x, r.grid.origin_y, r.grid.crs.name) == (95.0, 205.0, "EPSG:3035")
    n = zarr.read_zarr(spark, f"{tmp_path}/a")
    assert n.shape == (2, 5, 7) and n.df.where("v is null").count() == 9 + 1
    assert zarr.read_zarr(spark, f"{tmp_path}/a", ignore_fill=True).df.where("v is null").count() == 0
    assert zarr.crc32c(b"123456789") == 0xE3069283


def test_a_zarr_window_reads_its_chunks_alone(spark, tmp_path):
    """Chunks outside the index and the window are broken files, which nothing opens."""
    a = np.arange(4 * 9 * 11, dtype=np.int32).reshape(4, 9, 11)
    needed = {(1, i, j) for i in (1, 2) for j in (0, 1)}
    store(tmp_path / "a", a, (2, 3, 4), [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}],
          lambda at, part: part.tobytes() + struct.pack("<I", zarr.crc32c(part.tobytes())) if at in needed else b"broken", fill=-1, attributes={"spatial:transform": [10.0, 0.0, 100.0, 0.0, -10.0, 200.0]})
    r = zarr.read_zarr_raster(spark, f"{tmp_path}/a", (3,), window=(2, 4, 5, 4))
    got, ok = r.to_numpy()
    assert ok.all() and (got == a[3, 4:8, 2:7]).all() and (r.grid.origin_x, r.grid.origin_y) == (120.0, 160.0)
    n = zarr.read_zarr(spark, f"{tmp_path}/a", window=((2, 4), (3, 3), (0, 4)))
    assert n.shape == (2, 0, 4) and n.df.count() == 0
    for bad in ({"index": (4,)}, {"index": (0,), "window": (8, 0, 4, 1)}):
        with pytest.raises(ValueError):
            zarr.read_zarr_raster(spark, f"{tmp_path}/a", **bad)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 3 * 1024 + 5, 7 * 1024, 70_001])
def test_crc32c_of_many_lanes(n):
    data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    c = 0xFFFFFFFF
    for b in data:  # bit by bit
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    assert zarr.crc32c(data) == c ^ 0xFFFFFFFF


@pytest.mark.parametrize("dtype, fill", [("float64", "NaN"), ("float32", 0.0), ("uint64", 2**63), ("int8", -1)])
def test_zarr_types_and_shards(spark, tmp_path, dtype, fill):
    rng = np.random.default_rng(2)
    a = (rng.random((8, 8)) * 100).astype(dtype)
    a[2, 3] = zarr._fill(fill, dtype)
    shard = [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 4], "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {}}], "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]}}]

    def write(at, part):
        body, index = b"", []
        for y, x in np.ndindex(2, 2):
            if (y, x) == (1, 1) and at == (1, 0):
                index += [2**64 - 1, 2**64 - 1]
                continue
            c = zstandard.compress(part[y * 2 : y * 2 + 2, x * 4 : x * 4 + 4].tobytes())
            index += [len(body), len(c)]
            body += c
        raw_ = struct.pack(f"<{len(index)}Q", *index)
        return body + raw_ + struct.pack("<I", zarr.crc32c(raw_))

    store(tmp_path / "s", a, (4, 8), shard, write, fill=fill, key={"name": "v2"})
    n = zarr.read_zarr(spark, f"{tmp_path}/s")
    rows = {(r["i0"], r["i1"]): r["v"] for r in n.df.collect()}
    assert rows[2, 3] is None and all(rows[6 + y, 4 + x] is None for y in (0, 1) for x in range(4))
    assert all(float(rows[p]) == float(a[p]) for p in rows if rows[p] is not None) and len(rows) == 64


def test_what_zarr_refuses(tmp_path):
    a = np.zeros((2, 2), np.float32)
    for codecs in ([{"name": "blosc"}],):
        store(tmp_path / "x", a, (2, 2), codecs, lambda at, p: b"")
        with pytest.raises(ValueError):
            zarr.open_zarr(f"{tmp_path}/x")
    store(tmp_path / "y", a, (2, 2), [{"name": "bytes"}], lambda at, p: p.tobytes(), attributes={"spatial:transform": [1, 1, 0, 0, 1, 0]})
    with pytest.raises(ValueError):
        zarr.zarr_grid(zarr.open_zarr(f"{tmp_path}/y"))


def test_streamed_mosaic(spark, tmp_path):
    for k, rows in enumerate([[(0, 0, 1.0, 0), (0, 1, 1.0, 0)], [(0, 0, 2.0, 1), (0, 1, None, 1)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        start_mosaic(cell_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert {(r.y, r.x): r.v for r in current_mosaic(spark, f"{tmp_path}/out").collect()} == {(0, 0): 2.0, (0, 1): 1.0}
