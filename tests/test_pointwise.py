import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import exact
from gridloom.grid import CRS, Grid
from gridloom.operators import algebra, transfer
from gridloom.raster import Raster
from tests.fixtures import SPECIAL, ragged, same

A, B = (x.astype(np.float32) for x in np.meshgrid(SPECIAL, SPECIAL))


def go(pick, a, b):
    out = pick(a, b)
    zero = (a == 0) & (b == 0)
    sign = (np.signbit(a) | np.signbit(b)) if pick is np.minimum else (np.signbit(a) & np.signbit(b))
    return np.where(zero, np.where(sign, np.float32(-0.0), np.float32(0)), out)


@pytest.mark.parametrize("op, want", [
    (algebra.add, np.add), (algebra.sub, np.subtract), (algebra.mul, np.multiply), (algebra.div, np.divide),
    (algebra.minimum, lambda a, b: go(np.minimum, a, b)), (algebra.maximum, lambda a, b: go(np.maximum, a, b)),
])
def test_binary_on_special_values(spark, op, want):
    got, ok = op(Raster.from_numpy(spark, A), Raster.from_numpy(spark, B)).to_numpy()
    with np.errstate(all="ignore"):
        assert ok.all() and same(got, want(A, B))


def test_validity_is_of_all_inputs(spark):
    z, ok = ragged()
    other = np.roll(ok, 5, 1)
    r = algebra.mul(Raster.from_numpy(spark, z, ok), Raster.from_numpy(spark, z, other))
    assert r.df.schema["v"].dataType.simpleString() == "float"
    got, valid = r.to_numpy()
    assert (valid == (ok & other)).all() and same(got[valid], (z * z)[valid])
    got, valid = algebra.mask(Raster.from_numpy(spark, z, ok), Raster.from_numpy(spark, z * np.float32(np.nan), other)).to_numpy()
    assert (valid == (ok & other)).all() and same(got[valid], z[valid])


def test_single_input_operations(spark):
    r = Raster.from_numpy(spark, SPECIAL[None, :])
    with np.errstate(all="ignore"):
        assert same(algebra.clamp(r, -1, 2).to_numpy()[0], np.minimum(np.maximum(SPECIAL, np.float32(-1)), np.float32(2))[None, :])
        assert same(algebra.square_root(r).to_numpy()[0], np.sqrt(SPECIAL)[None, :])
        assert same(algebra.absolute(r).to_numpy()[0], np.abs(SPECIAL)[None, :])
        assert same(transfer.rescale(r, 0.1, 3).to_numpy()[0], (SPECIAL * np.float32(0.1) + np.float32(3))[None, :])
    got = algebra.clamp(Raster.from_numpy(spark, np.array([[0, 5, 9]], np.float32)), 7, 3).to_numpy()[0]
    assert got.tolist() == [[3, 3, 3]]


def test_normalize(spark):
    z, ok = ragged()
    got, valid = algebra.normalize(Raster.from_numpy(spark, z, ok)).to_numpy()
    lo, hi = z[ok].min(), z[ok].max()
    assert (valid == ok).all() and same(got[ok], ((z - lo) / (hi - lo))[ok])
    flat, _ = algebra.normalize(Raster.from_numpy(spark, np.full((2, 2), 4, np.float32))).to_numpy()
    nan, _ = algebra.normalize(Raster.from_numpy(spark, np.array([[1, np.nan]], np.float32))).to_numpy()
    none, valid = algebra.normalize(Raster.from_numpy(spark, np.ones((1, 2), np.float32), np.zeros((1, 2), bool))).to_numpy()
    assert np.isnan(flat).all() and np.isnan(nan).all() and not valid.any()


def test_reclass_and_lookup(spark):
    v = np.array([[-5, 0, 0.5, 1, 1.5, 2, 99, np.nan, np.inf, -np.inf]], np.float32)
    got, _ = transfer.reclass(Raster.from_numpy(spark, v), [0, 1, 2], [10, 20, 30, 40]).to_numpy()
    assert same(got, [[10, 20, 20, 30, 30, 40, 40, np.nan, 40, 10]])
    got, _ = transfer.lookup(Raster.from_numpy(spark, v), [0, 1, 2], [5, 7, -3]).to_numpy()
    assert same(got, [[5, 5, 6, 7, 2, -3, -3, np.nan, -3, 5]])


def test_options_are_checked_at_once(spark):
    r = Raster.from_numpy(spark, np.ones((2, 2), np.float32))
    for bad in (lambda: transfer.reclass(r, [1], [1]), lambda: transfer.reclass(r, [2, 1], [1, 2, 3]), lambda: transfer.lookup(r, [], []), lambda: transfer.lookup(r, [1, 1], [1, 2]),
                lambda: transfer.lookup(r, [float("inf")], [1]), lambda: transfer.rescale_range(r, 1, 1, 0, 1), lambda: algebra.add(r, Raster.from_numpy(spark, np.ones((2, 3), np.float32))),
                lambda: r.window(1, 1, 2, 1), lambda: Grid(1, 1, 0.0, 1.0), lambda: Grid(2, 2).window(1, 0, 2, 1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        algebra.add(Raster(r.df, 2, 2, Grid(2, 2, crs=CRS("a"))), Raster(r.df.select("*"), 2, 2, Grid(2, 2, crs=CRS("b"))))


def test_raster_surface(spark):
    z, ok = ragged(20, 10)
    r = Raster.from_numpy(spark, z, ok, Grid(20, 10, 2.0, -2.0, 100.0, 50.0))
    w = r.window(3, 2, 5, 4)
    got, valid = w.to_numpy()
    assert same(got[valid], z[2:6, 3:8][valid]) and (w.grid.origin_x, w.grid.origin_y) == (106.0, 46.0)
    assert r.cell(3, 2).first().valid == ok[2, 3]
    r.validate()
    with pytest.raises(ValueError):
        Raster(r.df.where("x > 0"), 20, 10).validate()
    assert Raster(r.df.where("v is not null"), 20, 10).densified().df.count() == 200
    back, again = Raster.from_scanlines(r.scanlines(), 20, 10).to_numpy()
    assert (again == ok).all() and same(back[ok], z[ok])
    cleared, valid = r.set_valid(F.col("x") == 0, False).to_numpy()
    assert not valid[:, 0].any()
    edges, valid = r.nan_edges(2).to_numpy()
    assert valid[:2].all() and np.isnan(edges[:, -2:]).all() and same(edges[2:-2, 2:-2][ok[2:-2, 2:-2]], z[2:-2, 2:-2][ok[2:-2, 2:-2]])
    assert r.amplification(1, 5) == (6 + 6) * (6 + 7 + 7 + 6) / 200 and r.amplification(0) == 1.0
    tiles = {(t.ty, t.tx): np.frombuffer(t.data, "<f4") for t in r.tiles(1, 8).collect()}
    assert len(tiles) == 6 and len(tiles[0, 0]) == 100


def test_wrapped_integers(spark):
    df = spark.createDataFrame([(127, 1), (-128, -1), (300, 0)], "a int, b int")
    got = df.select(exact.wrapped(F.col("a") + F.col("b"), 8).cast("int").alias("s"), exact.wrapped(F.col("a") + F.col("b"), 8, False).cast("int").alias("u")).collect()
    assert [(r.s, r.u) for r in got] == [(-128, 128), (127, 127), (44, 44)]
