import math
import random

import numpy as np
import pytest

from gridloom.operators import reduce
from gridloom.operators.ndarray import NdArray, broadcast_shape
from gridloom.raster import Raster
from tests.fixtures import ragged


def raster(spark, values, ok=None):
    return Raster.from_numpy(spark, np.asarray([values], np.float32), None if ok is None else np.asarray([ok]))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_sums_are_exact_for_any_partitioning(spark, parts):
    rng = random.Random(2)
    v = np.array([rng.choice([-1, 1]) * 10 ** rng.uniform(-40, 30) for _ in range(5000)], np.float32)
    r = raster(spark, v)
    s = reduce.stats(Raster(r.df.repartition(parts), r.width, 1)).first()
    assert s["sum"] == math.fsum(map(float, v)) and s["count"] == 5000 and s["mean"] == math.fsum(map(float, v)) / 5000
    mean = math.fsum(map(float, v)) / 5000
    assert s["stddev"] == pytest.approx(math.sqrt(math.fsum((float(x) - mean) ** 2 for x in v) / 5000), rel=1e-12)


def test_special_sums(spark):
    inf = math.inf
    for values, want in (([1, inf], inf), ([inf, -inf], math.nan), ([1, math.nan], math.nan), ([-0.0, -0.0], -0.0), ([-0.0, 0.0], 0.0), ([3.4e38, 3.4e38], float(np.float32(3.4e38)) * 2)):
        got = reduce.exact_sum(raster(spark, values)).first()["sum"]
        assert (math.isnan(got) and math.isnan(want)) or (got == want and math.copysign(1, got) == math.copysign(1, want))


def test_empty_and_extremes(spark):
    none = raster(spark, [1, 2], [False, False])
    s = reduce.stats(none).first()
    assert (s["count"], s["sum"]) == (0, 0.0) and all(math.isnan(s[c]) for c in ("mean", "stddev", "min", "max"))
    m = reduce.min_max(raster(spark, [0.0, -0.0])).first()
    assert math.copysign(1, m["min"]) == -1 and math.copysign(1, m["max"]) == 1
    m = reduce.min_max(raster(spark, [1, math.nan, -3])).first()
    assert math.isnan(m["min"]) and math.isnan(m["max"]) and m["count"] == 3
    assert reduce.count(raster(spark, [1, math.nan, 2], [True, True, False])).first()["count"] == 2


def test_fast_statistics_are_close(spark):
    z, ok = ragged()
    a, b = reduce.stats(Raster.from_numpy(spark, z, ok)).first(), reduce.stats_fast(Raster.from_numpy(spark, z, ok)).first()
    assert a["count"] == b["count"] and a["sum"] == pytest.approx(b["sum"], rel=1e-12) and a["stddev"] == pytest.approx(b["stddev"], rel=1e-9)


def values(a: NdArray, fill=0):
    out, ok = np.full(a.shape, fill, object), np.zeros(a.shape, bool)
    for row in a.df.collect():
        if row["v"] is not None:
            at = tuple(row[k] for k in a.axes)
            out[at], ok[at] = row["v"], True
    return out, ok


@pytest.fixture(scope="module")
def stack(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(3, 4, 5)).astype(np.float32)
    ok = rng.random((3, 4, 5)) > 0.2
    ok[:, 1, 2] = False
    return data, ok, NdArray.from_numpy(spark, data, ok)


def test_views(stack):
    data, ok, a = stack
    for got, want, good in (
        (a.slice(1, 1, 3), data[:, 1:3], ok[:, 1:3]), (a.window((1, 0, 2), (2, 4, 3)), data[1:, :, 2:], ok[1:, :, 2:]), (a.select(0, 2), data[2], ok[2]),
        (a.transpose(), data.T, ok.T), (a.transpose(1, 2, 0), data.transpose(1, 2, 0), ok.transpose(1, 2, 0)), (a.reshape(6, 10), data.reshape(6, 10), ok.reshape(6, 10)),
        (a.expand_dims(1), data[:, None], ok[:, None]), (a.select(0, 0).broadcast_to(2, 4, 5), np.broadcast_to(data[0], (2, 4, 5)), np.broadcast_to(ok[0], (2, 4, 5))),
    ):
        v, valid = values(got)
        assert got.shape == want.shape and (valid == good).all() and (v[good] == want[good]).all()
    a.validate()
    with pytest.raises(ValueError):
        NdArray(a.df.where("i0 > 0"), a.shape).validate()
    assert a.at(0, 1, 2).first()["valid"] is False and len(a) == 60 and a.rank == 3


def test_broadcasting_arithmetic(spark, stack):
    data, ok, a = stack
    b = NdArray.from_numpy(spark, data[:, :1, :1], ok[:, :1, :1])
    v, valid = values(a.mul(b))
    good = ok & ok[:, :1, :1]
    assert (valid == good).all() and (v[good].astype(np.float32) == (data * data[:, :1, :1])[good]).all()
    v, _ = values(NdArray.from_numpy(spark, data[0, 0]).add(NdArray.from_numpy(spark, data[:, 0, 0].reshape(3, 1))))
    assert (v.astype(np.float32) == data[0, 0] + data[:, 0, 0].reshape(3, 1)).all()
    assert broadcast_shape((3, 1), (4,)) == (3, 4)
    for bad in (lambda: broadcast_shape((3,), (4,)), lambda: a.reshape(7), lambda: a.slice(0, 2, 9), lambda: a.select(1, 4), lambda: a.transpose(0, 0, 1), lambda: a.sum_over(), lambda: a.sum_over(0, 0), lambda: a.add(a.convert("int8"))):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("dtype", ["int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64"])
def test_integers_wrap(spark, dtype):
    info = np.iinfo(dtype)
    x = np.array([info.min, info.max, 1, 7, info.max // 3], dtype)
    y = np.array([info.max, info.max, info.max, info.max - 5, 11], dtype)
    a, b = NdArray.from_numpy(spark, x), NdArray.from_numpy(spark, y)
    with np.errstate(all="ignore"):
        for got, want in ((a.add(b), x + y), (a.sub(b), x - y), (a.mul(b), x * y), (a.minimum(b), np.minimum(x, y)), (a.maximum(b), np.maximum(x, y))):
            assert [int(v) for v in values(got)[0]] == want.tolist()


def test_conversions(spark):
    x = np.array([300, -129, 127, -1], np.int32)
    a = NdArray.from_numpy(spark, x)
    for dtype in ("int8", "uint8", "uint16", "int64", "float32", "uint64"):
        assert [float(v) for v in values(a.convert(dtype))[0]] == [float(v) for v in x.astype(dtype)]
    f = NdArray.from_numpy(spark, np.array([-1.7, 1.7, 300.5], np.float32))
    assert values(f.convert("int8"))[0].tolist() == [-1, 1, 44] and values(f.convert("int32"))[0].tolist() == [-1, 1, 300]
    assert values(a.fill(5))[0].tolist() == [5] * 4


def test_reductions(spark, stack):
    data, ok, a = stack
    masked = np.ma.array(data.astype(np.float64), mask=~ok)
    v, valid = values(a.sum_over(0, 2))
    assert valid.all() and np.allclose(v.astype(float), masked.sum((0, 2)))
    v, valid = values(a.mean_over(0))
    assert not valid[1, 2] and np.allclose(v[valid].astype(float), masked.mean(0)[valid].astype(float))
    v, valid = values(a.sum_over(0))
    assert valid.all() and v[1, 2] == 0
    for got, want in ((a.min_over(0), masked.min(0)), (a.max_over(0), masked.max(0))):
        v, valid = values(got)
        assert not valid[1, 2] and (v[valid].astype(np.float32) == want[valid].astype(np.float32)).all()
    assert values(a.count_over(0, 1, 2))[0].item() == ok.sum() and a.count_over(1, keepdims=True).shape == (3, 1, 5)
    total = values(a.sum_over(0, 1, 2))[0].item()
    assert total == math.fsum(data[ok].astype(float))


def test_raster_bridge(spark):
    z, ok = ragged(8, 6)
    r = Raster.from_numpy(spark, z, ok)
    back = NdArray.from_raster(r).to_raster()
    assert (back.width, back.height) == (8, 6) and back.df.where("v is null").count() == (~ok).sum()


def test_bins_hold_more_than_a_long_of_values():
    """Limb sums as 2^45 cells of the largest float would leave them: no LONG is near its end, and the total is exact."""
    n, top = 1 << 45, float(np.finfo(np.float32).max)
    u = reduce._UNITS[-1]
    sig = int(math.ldexp(top, -u))
    limbs = [sig & 8191, sig >> 13 & 8191, sig >> 26]
    row = {"bin": u, "n": n, "nan": 0, "pinf": 0, "ninf": 0, "mzero": 0, **{f"s{k}": x * n for k, x in enumerate(limbs)}}
    assert all(x * n < 2**62 for x in limbs) and reduce.finished_sum([row])[0] == top * float(n)


def test_split_is_exact_for_every_magnitude(spark):
    rng = np.random.default_rng(3)
    z = rng.integers(0, 2**32, 4000, dtype=np.uint32).view(np.float32)
    z = np.concatenate([z[np.isfinite(z)], np.float32([2.0**k for k in range(-149, 128)]), np.float32([1e-45, -1e-45, 3.4028235e38])])
    df = Raster.from_numpy(spark, z[None]).df
    got = reduce._split(df, "v", reduce.F.col("v") != 0)[0].where("v <> 0").select("v", "bin", "sig").collect()
    assert all(math.ldexp(r.sig, r.bin) == r.v and abs(r.sig) < 2**39 for r in got) and len(got) == int((z != 0).sum())
