"""N-dimensional arrays: rows (i0, ..., v) for every element, NULL where invalid; shapes are known to the driver."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import exact
from gridloom.operators.reduce import _extremes, grouped_sums
from gridloom.raster import Raster

#: Element types: Spark type, bits, signed; floats have no bits.
TYPES = {
    "int8": ("tinyint", 8, True), "int16": ("smallint", 16, True), "int32": ("int", 32, True), "int64": ("bigint", 64, True),
    "uint8": ("smallint", 8, False), "uint16": ("int", 16, False), "uint32": ("bigint", 32, False), "uint64": ("decimal(20,0)", 64, False),
    "float32": ("float", 0, True), "float64": ("double", 0, True),
}


def broadcast_shape(*shapes: tuple[int, ...]) -> tuple[int, ...]:
    """The common shape, aligned at the last axis; lengths agree or are 1."""
    rank = max(map(len, shapes), default=0)
    out = []
    for k in range(rank):
        sizes = {s[k - rank + len(s)] for s in shapes if k - rank + len(s) >= 0} - {1}
        if len(sizes) > 1:
            raise ValueError(f"shapes {shapes} don't broadcast")
        out.append(sizes.pop() if sizes else 1)
    return tuple(out)


class NdArray:
    """An array of one element type."""

    def __init__(self, df: DataFrame, shape: tuple[int, ...], dtype: str = "float32"):
        if dtype not in TYPES:
            raise ValueError(f"no element type {dtype}")
        self.df, self.shape, self.dtype = df, tuple(shape), dtype

    @property
    def rank(self) -> int:
        return len(self.shape)

    def __len__(self) -> int:
        return math.prod(self.shape)

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(self.rank)]

    @classmethod
    def filled(cls, spark: SparkSession, shape: tuple[int, ...], value=0, dtype: str = "float32", valid: bool = True) -> NdArray:
        """A constant array."""
        n = math.prod(shape)
        cols, left = [], n
        for k, size in enumerate(shape):
            left //= max(size, 1)
            cols.append(F.expr(f"cast((id div {max(left, 1)}) % {max(size, 1)} as int)").alias(f"i{k}"))
        v = F.lit(value if valid else None).cast(TYPES[dtype][0])
        return cls(spark.range(n).select(*cols, v.alias("v")), shape, dtype)

    @classmethod
    def from_numpy(cls, spark: SparkSession, data: np.ndarray, valid: np.ndarray | None = None) -> NdArray:
        """An array that passes through the driver."""
        number = Decimal if str(data.dtype) == "uint64" else lambda v: v
        rows = [(*map(int, at), None if valid is not None and not valid[at] else number(data[at].item())) for at in np.ndindex(data.shape)]
        schema = ", ".join([*(f"i{k} int" for k in range(data.ndim)), f"v {TYPES[str(data.dtype)][0]}"])
        return cls(spark.createDataFrame(rows, schema), data.shape, str(data.dtype))

    @classmethod
    def from_raster(cls, r: Raster) -> NdArray:
        return cls(r.df.select(F.col("y").alias("i0"), F.col("x").alias("i1"), "v"), (r.height, r.width))

    def to_raster(self) -> Raster:
        if self.rank != 2 or self.dtype != "float32":
            raise ValueError("a raster has two axes of float32")
        return Raster(self.df.select(F.col("i0").alias("y"), F.col("i1").alias("x"), "v"), self.shape[1], self.shape[0])

    def _with(self, df: DataFrame, shape, dtype: str | None = None) -> NdArray:
        return NdArray(df, shape, dtype or self.dtype)

    def at(self, *index: int) -> DataFrame:
        """One element: (v, valid)."""
        where = F.lit(True)
        for a, i, n in zip(self.axes, index, self.shape, strict=True):
            if not 0 <= i < n:
                raise ValueError("the index leaves the array")
            where = where & (F.col(a) == i)
        return self.df.where(where).select("v", F.col("v").isNotNull().alias("valid"))

    def validate(self) -> None:
        """Raise unless every element is there once."""
        inside = F.lit(True)
        for a, n in zip(self.axes, self.shape):
            inside = inside & F.col(a).between(0, n - 1)
        n, distinct, good = self.df.agg(F.count("*"), F.countDistinct(*self.axes) if self.axes else F.count("*"), F.count(F.when(inside, 1))).first()
        if not n == distinct == good == len(self):
            raise ValueError(f"{n} elements, {distinct} distinct, {good} inside, for shape {self.shape}")

    def slice(self, axis: int, start: int, end: int) -> NdArray:
        """A range of an axis, which stays."""
        if not 0 <= start <= end <= self.shape[axis]:
            raise ValueError("the slice leaves the array")
        a = f"i{axis}"
        df = self.df.where(F.col(a).between(start, end - 1)).withColumn(a, (F.col(a) - start).cast("int"))
        return self._with(df, (*self.shape[:axis], end - start, *self.shape[axis + 1 :]))

    def window(self, start: tuple[int, ...], shape: tuple[int, ...]) -> NdArray:
        """A block."""
        out = self
        for k, (s, n) in enumerate(zip(start, shape, strict=True)):
            out = out.slice(k, s, s + n)
        return out

    def select(self, axis: int, i: int) -> NdArray:
        """One index of an axis, which goes."""
        if not 0 <= i < self.shape[axis]:
            raise ValueError("the index leaves the array")
        keep = [k for k in range(self.rank) if k != axis]
        df = self.df.where(F.col(f"i{axis}") == i).select(*(F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(keep)), "v")
        return self._with(df, tuple(self.shape[k] for k in keep))

    def transpose(self, *perm: int) -> NdArray:
        """Axes in another order, reversed by default; only names change."""
        perm = perm or tuple(reversed(range(self.rank)))
        if sorted(perm) != list(range(self.rank)):
            raise ValueError("not a permutation of the axes")
        return self._with(self.df.select(*(F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(perm)), "v"), tuple(self.shape[k] for k in perm))

    def reshape(self, *shape: int) -> NdArray:
        """The same elements in row-major order under another shape."""
        if math.prod(shape) != len(self):
            raise ValueError("the shapes hold different numbers of elements")
        flat = F.lit(0).cast("long")
        for a, n in zip(self.axes, self.shape):
            flat = flat * n + F.col(a)
        left, cols = math.prod(shape), []
        df = self.df.select(flat.alias("flat"), "v")
        for k, n in enumerate(shape):
            left //= max(n, 1)
            cols.append(F.expr(f"cast((flat div {max(left, 1)}) % {max(n, 1)} as int)").alias(f"i{k}"))
        return self._with(df.select(*cols, "v"), shape)

    def expand_dims(self, axis: int) -> NdArray:
        """A new axis of length 1."""
        if not 0 <= axis <= self.rank:
            raise ValueError("no such place for an axis")
        cols = [F.col(f"i{k}").alias(f"i{k + (k >= axis)}") for k in range(self.rank)]
        cols.insert(axis, F.lit(0).alias(f"i{axis}"))
        return self._with(self.df.select(*cols, "v"), (*self.shape[:axis], 1, *self.shape[axis:]))

    def broadcast_to(self, *shape: int) -> NdArray:
        """Repeated along new axes and those of length 1."""
        if broadcast_shape(self.shape, shape) != tuple(shape):
            raise ValueError(f"{self.shape} doesn't broadcast to {shape}")
        out, new = self, len(shape) - self.rank
        for _ in range(new):
            out = out.expand_dims(0)
        df = out.df
        for k, n in enumerate(shape):
            if out.shape[k] == 1 and n != 1:
                df = df.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else df.where("false")
        return self._with(df.select(*(f"i{k}" for k in range(len(shape))), "v"), tuple(shape))

    def _binary(self, other: NdArray, op) -> NdArray:
        if self.dtype != other.dtype:
            raise ValueError("element types differ")
        shape = broadcast_shape(self.shape, other.shape)
        rank = len(shape)

        def placed(a: NdArray, name: str):
            off = rank - a.rank
            own = [k for k in range(rank) if k >= off and a.shape[k - off] != 1]
            return a.df.select(*(F.col(f"i{k - off}").alias(f"{name}{k}") for k in own), F.col("v").alias(name)), own

        (a, mine), (b, theirs) = placed(self, "a"), placed(other, "b")
        both = [k for k in mine if k in theirs]
        on = [F.col(f"a{k}") == F.col(f"b{k}") for k in both] or F.lit(True)
        # without a common axis every pair is an element of the result
        j = a.join(b, on) if both else a.crossJoin(F.broadcast(b) if len(other) <= 100_000 else b)
        cols = [F.col(f"a{k}" if k in mine else f"b{k}").alias(f"i{k}") if k in mine or k in theirs else F.lit(0).alias(f"i{k}") for k in range(rank)]
        return self._with(j.select(*cols, op(F.col("a"), F.col("b")).alias("v")), shape)

    def _arithmetic(self, other: NdArray, op) -> NdArray:
        spark_type, bits, signed = TYPES[self.dtype]
        if not bits:
            return self._binary(other, op)
        wide = lambda c: c.cast("decimal(20,0)")
        return self._binary(other, lambda a, b: exact.wrapped(op(wide(a), wide(b)), bits, signed).cast(spark_type))

    def add(self, other: NdArray) -> NdArray:
        """Sums; integers wrap."""
        return self._arithmetic(other, lambda a, b: a + b)

    def sub(self, other: NdArray) -> NdArray:
        return self._arithmetic(other, lambda a, b: a - b)

    def mul(self, other: NdArray) -> NdArray:
        """Products; integers wrap. 64-bit factors are reduced in two halves, so no product overflows."""
        spark_type, bits, signed = TYPES[self.dtype]
        if bits < 64:
            return self._arithmetic(other, lambda a, b: a * b)
        half = F.lit(1 << 32).cast("decimal(20,0)")

        def product(a, b):
            u = exact.wrapped(a, 64, False).cast("decimal(20,0)")
            w = exact.wrapped(b, 64, False).cast("decimal(20,0)")
            lo, hi = (w % half).cast("decimal(11,0)"), ((w - w % half) / half).cast("decimal(11,0)")
            ulo, uhi = (u % half).cast("decimal(11,0)"), ((u - u % half) / half).cast("decimal(11,0)")
            middle = ((ulo * hi).cast("decimal(22,0)") + (uhi * lo).cast("decimal(22,0)")) % half
            total = (ulo * lo).cast("decimal(38,0)") + (middle.cast("decimal(11,0)") * half.cast("decimal(11,0)")).cast("decimal(38,0)")
            return exact.wrapped(total, 64, signed).cast(spark_type)

        return self._binary(other, product)

    def minimum(self, other: NdArray) -> NdArray:
        return self._binary(other, exact.go_min if not TYPES[self.dtype][1] else lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)))

    def maximum(self, other: NdArray) -> NdArray:
        return self._binary(other, exact.go_max if not TYPES[self.dtype][1] else lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)))

    def convert(self, dtype: str) -> NdArray:
        """Another element type: integers wrap when they narrow, floats lose their fraction towards zero."""
        spark_type, bits, signed = TYPES[dtype]
        v = F.col("v")
        if bits:
            if not TYPES[self.dtype][1]:
                # out of range, as machine conversions give it: the least 64-bit integer
                d = v.cast("double")
                v = F.when(F.isnan(d) | (F.abs(d) >= 2.0**63), F.lit(-(2.0**63))).when(d >= 0, F.floor(d).cast("double")).otherwise(F.ceil(d).cast("double")).cast("decimal(38,0)")
            v = exact.wrapped(v, bits, signed)
        return self._with(self.df.select(*self.axes, v.cast(spark_type).alias("v")), self.shape, dtype)

    def copy(self) -> NdArray:
        return self._with(self.df, self.shape)

    def fill(self, value) -> NdArray:
        """All elements the same and valid."""
        return self._with(self.df.select(*self.axes, F.lit(value).cast(TYPES[self.dtype][0]).alias("v")), self.shape)

    def _kept(self, axes: tuple[int, ...], keepdims: bool) -> tuple[list[str], list, tuple[int, ...]]:
        if not axes or len(set(axes)) != len(axes) or not all(0 <= a < self.rank for a in axes):
            raise ValueError("axes must be distinct, within the rank, and at least one")
        keep = [k for k in range(self.rank) if k not in axes]
        if keepdims:
            return [f"i{k}" for k in keep], [F.col(f"i{k}") if k in keep else F.lit(0).alias(f"i{k}") for k in range(self.rank)], tuple(self.shape[k] if k in keep else 1 for k in range(self.rank))
        return [f"i{k}" for k in keep], [F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(keep)], tuple(self.shape[k] for k in keep)

    def _over(self, axes, keepdims, dtype, agg) -> NdArray:
        keys, cols, shape = self._kept(axes, keepdims)
        return self._with(agg(keys).select(*cols, "v"), shape, dtype)

    def count_over(self, *axes: int, keepdims: bool = False) -> NdArray:
        """Valid elements along axes."""
        return self._over(axes, keepdims, "int64", lambda k: self.df.groupBy(*k).agg(F.count("v").alias("v")))

    def sum_over(self, *axes: int, keepdims: bool = False) -> NdArray:
        """Exact sums, rounded once to DOUBLE; 0 for no valid element."""
        return self._over(axes, keepdims, "float64", lambda k: grouped_sums(self.df, k, False))

    def mean_over(self, *axes: int, keepdims: bool = False) -> NdArray:
        """Exact means, rounded once; invalid for no valid element."""
        return self._over(axes, keepdims, "float64", lambda k: grouped_sums(self.df, k, True))

    def _extreme(self, axes, keepdims, which: int) -> NdArray:
        if TYPES[self.dtype][1]:
            f = (F.min, F.max)[which]
            return self._over(axes, keepdims, self.dtype, lambda k: self.df.groupBy(*k).agg(f("v").alias("v")))
        return self._over(axes, keepdims, self.dtype, lambda k: self.df.groupBy(*k).agg(_extremes(F.col("v"))[which].cast(TYPES[self.dtype][0]).alias("v")))

    def min_over(self, *axes: int, keepdims: bool = False) -> NdArray:
        return self._extreme(axes, keepdims, 0)

    def max_over(self, *axes: int, keepdims: bool = False) -> NdArray:
        return self._extreme(axes, keepdims, 1)
